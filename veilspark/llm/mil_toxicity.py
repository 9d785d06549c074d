"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence has a logistic score from its words and their first letters; the document is toxic if any
sentence is: the scores are combined by noisy-or. Only document labels are known; the gradient of the noisy-or shares
a label out among the sentences. The fitted sentence scores then locate the offending sentences.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import fresh, lean, rows_by_bytes

SAMPLE = 4000  # labelled documents that are fitted on, at most
SAMPLE_BYTES = 20_000  # texts over this aren't taken into the sample
SCAN_BYTES = 4 << 20
MIN_DF = 6  # a word needs that many documents of the sample
PREFIXES = (4, 5)  # of longer words, as many first letters are features too
FLIPPED = 0.002  # share of labels that are taken to be wrong
RIDGE, STEPS, RATE = 1e-4, 150, 0.15
CACHE_WORDS = 150_000
_ENDS = re.compile(r"[.!?\n]+")
_WORD = re.compile(r"[^\W\d_]+")


def sentences(text: str | None) -> list[str]:
    """Stretches between . ! ? and line ends that hold a letter; none for null and empty texts."""
    return [s for s in _ENDS.split(text or "") if _WORD.search(s)]


def features(word: str) -> list[str]:
    """The word, and its prefixes as ``word*``."""
    return [word, *(f"{word[:k]}*" for k in PREFIXES if len(word) > k)]


class Model:
    """Weights of features, and the bias of a sentence. Some ten thousand features: those of a bounded sample."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias
        self.known: dict[str, float] = {}

    def logits(self, parts: list[str]) -> np.ndarray:
        """Of lower-case sentences: the bias and the weights of a sentence's distinct words."""
        words = [set(_WORD.findall(s)) for s in parts]
        known = self.known
        if len(known) > CACHE_WORDS:
            known.clear()
        for w in set().union(*words).difference(known):
            known[w] = sum(self.weights.get(f, 0.0) for f in features(w))
        return self.bias + np.array([sum(map(known.__getitem__, sorted(s))) for s in words])

    def sentence_scores(self, text: str | None) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logits([s.lower() for s in sentences(text)])))

    def score(self, text: str | None) -> float:
        """Noisy-or over all sentences; 0 where there is none."""
        return float(-np.expm1(-np.logaddexp(0, self.logits([s.lower() for s in sentences(text)])).sum()))


def fit(texts: list[str], labels: list[int]) -> Model:
    """Fit to documents and their labels; Adam on the likelihood of noisy-or with a share of flipped labels."""
    ids: dict[str, int] = {}
    known: dict[str, list[int]] = {}  # feature numbers of each word
    bags: list[list[np.ndarray]] = []
    for t in texts:
        bags.append([])
        for s in sentences(t):
            found: list[int] = []
            for w in sorted(set(_WORD.findall(s.lower()))):
                if w not in known:
                    known[w] = [ids.setdefault(f, len(ids)) for f in features(w)]
                found += known[w]
            bags[-1].append(np.array(found, np.int32))
    del known
    df = np.zeros(len(ids), np.int64)
    for bag in bags:
        if bag:
            df[np.unique(np.concatenate(bag))] += 1
    names = list(ids)
    kept = sorted((i for i in np.flatnonzero(df >= MIN_DF).tolist()), key=names.__getitem__)
    words = [names[i] for i in kept]
    column = np.full(len(ids), -1, np.int64)
    column[kept] = np.arange(len(kept))
    del ids, names
    if not words or not 0 < sum(labels) < len(labels):
        return Model({}, -20.0)
    each = [s for bag in bags for s in bag]
    doc = np.repeat(np.arange(len(bags)), list(map(len, bags)))
    n_sent = len(each)
    row, col = np.repeat(np.arange(n_sent), list(map(len, each))), column[np.concatenate(each)]
    row, col = row[col >= 0], col[col >= 0]
    y = np.array(labels, float)
    w, b = np.zeros(len(words)), -6.0
    m, v = np.zeros(len(words) + 1), np.zeros(len(words) + 1)
    for t in range(1, STEPS + 1):
        z = np.bincount(row, weights=w[col], minlength=n_sent) + b
        quiet = np.bincount(doc, weights=np.logaddexp(0, z), minlength=len(y))
        p = -np.expm1(-quiet)
        q = FLIPPED + (1 - 2 * FLIPPED) * p
        # d(-log likelihood)/d(quiet), through q and p = 1 - exp(-quiet)
        d_quiet = ((1 - y) / (1 - q) - y / q) * (1 - 2 * FLIPPED) * np.exp(-quiet)
        d_z = d_quiet[doc] / (1 + np.exp(-z))
        g = np.r_[np.bincount(col, weights=d_z[row], minlength=len(w)) / len(y) + RIDGE * w, d_z.sum() / len(y)]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w -= step[:-1]
        b -= step[-1]
    keep = np.abs(w) > 0.05
    return Model({words[i]: float(w[i]) for i in np.flatnonzero(keep)}, float(b))


def held_out(doc_id: Column, folds: int = 4, fold: int = 2) -> Column:
    """Rows whose crc32 of the id as text leaves ``fold``; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Model:
    """A model from labelled rows that aren't held out.

    The sample: the ``most`` labelled documents whose hashed ids are smallest, whose texts have SAMPLE_BYTES at most;
    of several labels or rows of an id the largest counts. These texts are the only ones that the driver sees. Labels
    that are null are no labels. Ids may be of any type. Without both labels the model scores every document next to 0."""
    known = labels.where("toxic IN (0, 1)").where(~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").alias("id_")).agg(F.max("toxic").alias("toxic_"))
    short = docs.where(F.octet_length("text") <= SAMPLE_BYTES).select(F.col("doc_id").alias("doc_"), F.col("text").alias("text_"))
    chosen = known.join(short.select("doc_").distinct(), F.col("id_") == F.col("doc_"), "left_semi").orderBy(F.xxhash64("id_"), "id_").limit(most)
    ids = chosen.collect()  # ``most`` rows of an id and a label
    if not ids:
        return Model({}, -20.0)
    frame = docs.sparkSession.createDataFrame([(r.id_, int(r.toxic_)) for r in ids], f"id_ {dict(known.dtypes)['id_']}, toxic_ int")
    sample = short.join(F.broadcast(frame), F.col("doc_") == F.col("id_")).groupBy("id_", "toxic_").agg(F.max("text_").alias("text_")).orderBy("id_").collect()
    return fit([r.text_ for r in sample], [r.toxic_ for r in sample])


def score(docs: DataFrame, model: Model, text: str = "text", column: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text in ``column`` (replaced if there). Null and empty texts have the score of no sentence, next to 0."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))
    rest = docs.drop(column)
    (hidden,) = fresh(rest, "scored_text")
    source = rest.withColumn(hidden, F.col(text).cast("string"))
    schema, names = rest.withColumn(column, F.lit(0.0)).schema, [*rest.columns, column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        for b in rows_by_bytes(batches, hidden, SCAN_BYTES):
            at = b.schema.get_field_index(hidden)
            scores = pa.array([model.score(t) for t in b.column(at).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(b.num_columns) if i != at] + [scores], names=names)

    return source.mapInArrow(lean(run), schema)


def locate(docs: DataFrame, model: Model, least: float = 0.3) -> DataFrame:
    """doc_id, sentence number from 0, sentence and score of every sentence with a score of ``least`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        for b in rows_by_bytes(batches, "text", SCAN_BYTES):
            out = []
            for doc, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                out += [(doc, k, s, p) for k, (s, p) in enumerate(zip(sentences(t), model.sentence_scores(t).tolist(), strict=True)) if p >= least]
            if out:
                ids, *rest = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(ids, b.column(0).type), *map(pa.array, rest)], names=["doc_id", "sentence_no", "sentence", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(lean(run), f"doc_id {kind}, sentence_no long, sentence string, score double")


def toxicity_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from a score of 0.3) of every row of ``docs``."""
    scored = score(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
