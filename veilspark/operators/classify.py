"""Sensitivity levels, data categories, rule features and an optional trained classifier."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.functions.frames import fresh, scratch
from veilspark.operators import detect
from veilspark.operators.patterns import EXPLANATIONS, compiled

# Words that decide the level, the first list that has one wins; else C1.
LEVEL_WORDS = {
    "C4": ["account", "balance", "transaction", "payment", "loan", "credit", "password", "token", "credential"],
    "C3": ["name", "address", "phone", "email", "ssn", "id"],
    "C2": ["salary", "income", "medical", "legal", "confidential"],
}
# Words of the categories, in the order in which they are listed.
CATEGORY_WORDS = {
    "financial": ["account", "balance", "transaction", "payment", "loan", "credit"],
    "pii": ["name", "address", "phone", "email", "ssn", "id", "passport"],
    "authentication": ["password", "token", "key", "credential", "auth"],
    "sensitive": ["salary", "income", "medical", "legal", "confidential"],
}
# Categories of detected types; dates of birth have none.
TYPE_CATEGORY = {
    "EMAIL": "pii", "PHONE_EU": "pii", "SSN_LIKE": "pii", "NATIONAL_ID": "pii",
    "IBAN": "financial", "ACCOUNT_NUM": "financial", "AMOUNT": "financial", "BIOMETRIC": "authentication",
}
# The four word groups of the rule features.
FEATURE_WORDS = [
    ["credit score", "income", "account balance", "masked pin", "biometric"],
    ["agreement", "supplier", "customer", "standing order", "payment order", "overdraft"],
    ["annual report", "pillar 3", "press", "newsroom", "full year results", "investor"],
    ["policy", "guideline", "standard", "sop", "governance", "raci", "deprecated", "retired"],
]
APPROVAL_ACTIONS = ("text_de_scrubbed", "file_de_scrubbed")


#: Digits of the hash by which a split's rows are counted first.
BIN_DIGITS = 16


def has_any(text: Column, words: list[str]) -> Column:
    """Whether a word is anywhere in the text, inside of other words too."""
    return _has_any(F.lower(text), words)


def _has_any(low: Column, words: list[str]) -> Column:
    out = F.contains(low, F.lit(words[0]))
    for w in words[1:]:
        out |= F.contains(low, F.lit(w))
    return out


def _lowered(text: Column, body) -> Column:
    """``body`` of the text in lower case, which is computed once for all words."""
    return F.get(F.transform(F.array(F.lower(text)), body), F.lit(0))


def keyword_level(text: Column) -> Column:
    def of(low: Column) -> Column:
        out = F.lit("C1")
        for level in reversed(LEVEL_WORDS):
            out = F.when(_has_any(low, LEVEL_WORDS[level]), level).otherwise(out)
        return out

    return _lowered(text, of)


def categories_of_text(text: Column) -> Column:
    return _lowered(text, lambda low: F.array_compact(F.array(*[F.when(_has_any(low, words), name) for name, words in CATEGORY_WORDS.items()])))


def categories_of_types(types: Column) -> Column:
    """A category for each distinct type that has one, sorted; one that several types share is repeated."""
    lookup = F.create_map(*[F.lit(x) for pair in TYPE_CATEGORY.items() for x in pair])
    return F.sort_array(F.array_compact(F.transform(F.array_distinct(types), lambda t: F.try_element_at(lookup, t))))


def data_categories(text: Column, detections: Column) -> Column:
    """From the detections if there are any, even if none has a category; else from the text."""
    return F.when(F.coalesce(F.size(detections), F.lit(0)) > 0, categories_of_types(F.transform(detections, lambda d: d["type"]))).otherwise(categories_of_text(text))


def needs_approval(action: Column, level: Column) -> Column:
    return F.coalesce(action.isin(*APPROVAL_ACTIONS), F.lit(False)) | F.coalesce(level.isin("C3", "C4"), F.lit(False))


def with_rule_features(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with ``out``, array<double> of 22: presence and count of each pattern, then the four word groups; null for a null text.

    One Arrow pass, to which only the texts go."""

    def of(texts: pa.Array) -> pa.Array:
        patterns, out = compiled(), []
        for t in (x.as_py() for x in texts):
            if t is None:
                out.append(None)
                continue
            low = t.lower()
            counts = [float(x) for n in detect.found(t, patterns) for x in (n > 0, n)]
            out.append(counts + [float(any(w in low for w in words)) for words in FEATURE_WORDS])
        return pa.array(out, pa.list_(pa.float64()))

    return df.withColumn(out, F.arrow_udf(of, "array<double>")(F.col(text).cast("string")))


def training_pipeline(kind: str = "logreg", ngram_max: int = 2, seed: int = 42):
    """Spark ML pipeline over columns text, features_rules (vector) and label (string): hashed n-grams with IDF, and the rules.

    A forest picks features at random, so that it gets a smaller hash space."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import IDF, HashingTF, NGram, RegexTokenizer, StringIndexer, VectorAssembler

    stages, parts = [RegexTokenizer(inputCol="text", outputCol="w1", pattern=r"\W+")], []
    for n in range(1, ngram_max + 1):
        if n > 1:
            stages.append(NGram(n=n, inputCol="w1", outputCol=f"w{n}"))
        stages += [HashingTF(inputCol=f"w{n}", outputCol=f"tf{n}", numFeatures=1 << (14 if kind == "logreg" else 9)), IDF(inputCol=f"tf{n}", outputCol=f"idf{n}")]
        parts.append(f"idf{n}")
    stages += [StringIndexer(inputCol="label", outputCol="label_index", stringOrderType="alphabetAsc"), VectorAssembler(inputCols=[*parts, "features_rules"], outputCol="features")]
    stages.append(LogisticRegression(labelCol="label_index", maxIter=30) if kind == "logreg" else RandomForestClassifier(labelCol="label_index", seed=seed, numTrees=60, maxDepth=8))
    return Pipeline(stages=stages)


def with_split(df: DataFrame, key: str, label: str = "label", test_size: float = 0.2, seed: int = 42, out: str = "test") -> DataFrame:
    """``df`` with a flag of the rows to test on: of each label the rounded share ``test_size``, by a hash of the key.

    A row's side follows from its key, the seed and the label's rows, so that it is the same under any partitioning and in any order; rows with one key and label stay
    together, on the side of the first. Each label's bound is found on a histogram of leading digits and then in one of its bins, so no label is sorted; one bound a label comes to the driver."""
    place, bin_ = fresh([*df.columns, out], "place", "bin")
    rows = df.withColumn(place, _place(key, seed))
    return rows.withColumn(out, _is_test(rows, place, bin_, label, test_size)).drop(place)


def _place(key: str, seed: int) -> Column:
    text = F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def _is_test(df: DataFrame, place: str, bin_: str, label: str, test_size: float) -> Column:
    """Whether a row of ``df``, which has its hash as ``place``, is tested on; ``bin_``: a name that is free."""
    rows = df.select(label, place, F.shiftright(place, 60 - BIN_DIGITS).alias(bin_))
    sizes = rows.groupBy(F.col(label).alias("l"), F.col(bin_).alias("b")).agg(F.count("*").alias("n"))
    upto = Window.partitionBy("l").orderBy("b")
    counted = sizes.withColumn("before", F.sum("n").over(upto) - F.col("n")).withColumn("want", F.floor(F.sum("n").over(Window.partitionBy("l")) * test_size + 0.5))
    cut = counted.where("before < want AND want <= before + n").select("l", "b", (F.col("want") - F.col("before")).cast("int").alias("left"))  # one a label
    edge = rows.join(F.broadcast(cut), F.col(label).eqNullSafe(F.col("l")) & (F.col(bin_) == F.col("b")))
    bounds = edge.groupBy("l", "left").agg(F.sort_array(F.collect_list(place)).alias("p")).select("l", F.element_at("p", F.col("left")).alias("bound")).collect()
    test = F.lit(False)
    for r in bounds:
        test = test | (F.col(label).eqNullSafe(F.lit(r.l)) & (F.col(place) <= r.bound))
    return test


def train(df: DataFrame, kind: str = "logreg", test_size: float = 0.2, ngram_max: int = 2, seed: int = 42, key: str = "text"):
    """Fit on a stratified split of (text, label) by ``key``; returns the model and predictions (actual, predicted, confidence) on the rest.

    Texts are read once: their rule features and hashed n-grams are written to the folder that driver and executors share, and everything that is fitted
    reads them there. The folder is the caller's, as the predictions are still to be read from it."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.functions import array_to_vector

    data = df.select("text", "label", _place(key, seed).alias("place"))
    data = with_rule_features(data, "text", "rules").withColumn("features_rules", array_to_vector("rules"))
    stages, hashed = training_pipeline(kind, ngram_max, seed).getStages(), []
    for s in stages:
        if _reads_text(s):
            data = s.transform(data)
            hashed += [s.getOutputCol()] if s.hasParam("numFeatures") else []
    path = scratch(df.sparkSession, "features")
    data.select("label", "place", "features_rules", *hashed).write.parquet(path)
    data = df.sparkSession.read.parquet(path)
    data = data.withColumn("test", _is_test(data, "place", "bin", "label", test_size))
    rows, fitted = data.where("NOT test"), []
    for s in stages:
        fitted.append(s.fit(rows) if hasattr(s, "fit") else s)
        if not _reads_text(s) and s is not stages[-1]:
            rows = fitted[-1].transform(rows)
    model = PipelineModel(fitted)
    return model, predictions(data.where("test"), model)


def _reads_text(stage) -> bool:
    """Whether a stage is one of those that lead from the text to its hashed n-grams, which nothing is fitted for."""
    from pyspark.ml.feature import HashingTF, NGram, RegexTokenizer

    return isinstance(stage, RegexTokenizer | NGram | HashingTF)


def predictions(rows: DataFrame, model) -> DataFrame:
    """actual, predicted and confidence of rows with label, features_rules and text, or the text's hashed n-grams instead of it."""
    from pyspark.ml.functions import vector_to_array

    names = next(s.labels for s in model.stages if hasattr(s, "labels"))
    name = F.element_at(F.array(*map(F.lit, names)), F.col("prediction").cast("int") + 1)
    for stage in model.stages:
        known = hasattr(stage, "labels") or (_reads_text(stage) and "text" not in rows.columns)
        rows = rows if known else stage.transform(rows)
    return rows.select(F.col("label").alias("actual"), name.alias("predicted"), F.array_max(vector_to_array("probability")).alias("confidence"))


def load(path: str):
    """A fitted pipeline that was saved with ``model.write().overwrite().save(path)``."""
    from pyspark.ml import PipelineModel

    return PipelineModel.load(path)


def classified(df: DataFrame, model, text: str = "text") -> DataFrame:
    """``df`` with prediction, probabilities (map by label), confidence (the highest of them) and explanation."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    names = F.array(*map(F.lit, next(s.labels for s in model.stages if hasattr(s, "labels"))))
    columns = df.columns
    data = df.select(F.struct(*columns).alias("row_"), F.col(text).alias("text"), F.lit("").alias("label"))
    data = with_rule_features(data, "text", "rules").select("row_", "text", "label", array_to_vector("rules").alias("features_rules"))
    for stage in model.stages:
        data = data if hasattr(stage, "labels") else stage.transform(data)
    p = vector_to_array("probability")
    prediction = F.element_at(names, F.col("prediction").cast("int") + 1)
    words = F.create_map(*[F.lit(x) for pair in EXPLANATIONS.items() for x in pair])
    out = data.select("row_", prediction.alias("p_"), F.map_from_arrays(names, p).alias("m_"), F.array_max(p).alias("c_"))
    kept = [F.col("row_")[c].alias(c) for c in columns if c not in ("prediction", "probabilities", "confidence", "explanation")]
    return out.select(*kept, F.col("p_").alias("prediction"), F.col("m_").alias("probabilities"), F.col("c_").alias("confidence"), F.coalesce(F.try_element_at(words, F.col("p_")), F.lit("")).alias("explanation"))


def operation_level(text: Column, model_level: Column | None = None) -> Column:
    """Level of an operation: the model's, if there is one and the text isn't empty; else the words'."""
    words = keyword_level(F.coalesce(text, F.lit("")))
    return words if model_level is None else F.when(text != "", F.coalesce(model_level, words)).otherwise(words)
