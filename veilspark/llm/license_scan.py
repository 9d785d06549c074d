"""License scans by a positional index of rare words. DataFrame functions only.

Templates are the sentences that licences are known by. Their words are indexed with their places, and weighed by how rare
they are in the corpus. A file that holds all words of some template's key phrases is looked up: the template's rarest
words that the file has are found in it, each place gives the place at which the template would begin, and where enough
different words agree on it (give or take a few words put in or left out) the template is aligned. It counts once its key
phrases, whole and in place, are verified there. Beside this, fixed base phrases are counted wherever they stand.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm.common import stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Base phrases and the labels they give.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Label, sentence of the licence or of its notice, and the phrases of it that must be there ("|" between).
TEMPLATES = (
    ("agpl-3", "GNU Affero General Public License, version 3", "gnu affero general public license|version 3"),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License", "apache license version 2 0|except in compliance with the license"),
    ("apache-2", "SPDX-License-Identifier: Apache-2.0", "spdx license identifier apache 2 0"),
    ("bsd-2", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. This software is provided by", "redistributions in binary form must reproduce the above copyright notice|provided with the distribution this software is provided"),
    ("bsd-3", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "neither the name|may be used to endorse or promote products derived from this software"),
    ("bsl-1", "Boost Software License - Version 1.0 - August 17th, 2003", "boost software license version 1 0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", "creative commons attribution 4 0 international license"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "creative commons attribution sharealike 4 0 international license"),
    ("cc0", "Creative Commons Zero: the person who associated a work with this deed has dedicated the work to the public domain", "has dedicated the work to the public domain"),
    ("epl-2", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "eclipse public license 2 0"),
    ("gpl-2", "GNU General Public License as published by the Free Software Foundation; either version 2 of the License", "gnu general public license as published by the free software foundation|version 2"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3", "gnu general public license version 3"),
    ("gpl-3", "GNU General Public License as published by the Free Software Foundation, either version 3 of the License", "gnu general public license as published by the free software foundation|version 3"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl-3", "GNU Lesser General Public License, version 3", "gnu lesser general public license|version 3"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction", "permission is hereby granted free of charge|to deal in the software without restriction"),
    ("mit", "Released under the terms of the MIT License", "terms of the mit license"),
    ("mit", "SPDX-License-Identifier: MIT", "spdx license identifier mit"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "mozilla public license v 2 0"),
    ("unlicense", "This is free and unencumbered software released into the public domain", "free and unencumbered software released into the public domain"),
    ("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software", "without any express or implied warranty in no event will the authors be held liable"),
)
RARE = 8  # of a template's rarest words that a file is looked up by
AGREE = 0.5  # share of their weight that must agree on a place
SLACK = 8  # words that may be put in or left out between two of them


def words_of(text: str) -> list[str]:
    return [w for w in re.split(GAP, text.translate(str.maketrans(UPPER, LOWER))) if w]


def words(text: Column) -> Column:
    """Lower-cased (A-Z) words of a text; none for null."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), GAP, -1), lambda w: w != "")


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, though it is used in functions of elements."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _starts(w: Column, phrase: str) -> Column:
    """Places where the phrase's words stand consecutively."""
    parts = phrase.split(" ")

    def here(x: Column, i: Column) -> Column:
        fits = x == parts[0]
        for k, p in enumerate(parts[1:], 1):
            fits = fits & (F.get(w, i + k) == p)
        return F.when(fits, i)

    rare = F.forall(F.array(*map(F.lit, parts)), lambda p: F.array_contains(w, p))
    return F.when(rare, F.filter(F.transform(w, here), lambda i: i.isNotNull())).otherwise(F.array().cast("array<int>"))


def template_rows(templates: tuple) -> list[tuple]:
    """template, label, n (words), places (word -> places), phrases, needed (the phrases' words)."""
    out = []
    for t, (label, sentence, phrases) in enumerate(templates):
        places: dict[str, list[int]] = {}
        for i, w in enumerate(words_of(sentence)):
            places.setdefault(w, []).append(i)
        known = phrases.split("|")
        needed = sorted({w for p in known for w in p.split(" ")})
        if not set(needed) <= set(places):
            raise ValueError(f"a key phrase isn't in its template: {phrases}")
        out.append((t, label, sum(map(len, places.values())), places, known, needed))
    return out


def _base(starts: list[Column]) -> Column:
    every = F.flatten(F.array(*starts))
    labels = F.filter(F.array(*[F.when(F.size(s) > 0, label) for s, label in zip(starts, BASE.values(), strict=True)]), lambda x: x.isNotNull())
    return F.struct(F.size(every).cast("long").alias("n_base"), F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"), labels.alias("base"))


def lookups(docs: DataFrame, rows: list[tuple]) -> DataFrame:
    """All documents with a row number, their words' number, what the base phrases give, the index's words that they hold,
    the templates whose key phrases' words they all hold, and their words if there is such a template. Written once: texts are read in this pass only."""
    vocabulary = F.array(*map(F.lit, sorted({w for r in rows for w in r[3]})))
    needed = [F.array(*map(F.lit, r[5])) for r in rows]

    def facts(w: Column) -> Column:
        return _let(F.array_intersect(vocabulary, w), lambda s: F.struct(F.size(w).cast("long").alias("n_words"), _base([_starts(w, p) for p in BASE]).alias("b"), s.alias("held"), w.alias("words"), fits(s).alias("templates")))

    def fits(s: Column) -> Column:
        every = [F.when(F.size(F.array_except(x, s)) == 0, r[0]) for r, x in zip(rows, needed, strict=True)]
        return F.filter(F.array(*every), lambda x: x.isNotNull())

    seen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _let(words(F.col("text")), facts).alias("f"))
    keep = F.when(F.size("f.templates") > 0, F.col("f.words")).alias("words")
    return stage(seen.select(F.monotonically_increasing_id().alias("row"), "doc_id", "f.n_words", "f.b.*", "f.held", "f.templates", keep), "licence-words")


def index(spark: SparkSession, seen: DataFrame, rows: list[tuple]) -> DataFrame:
    """The templates with their words by rarity in all files (ties by the word): template, label, n, phrases, rarest (word, weight, places).

    As many rows as there are templates; the counts of their words come to the driver."""
    n = seen.count()
    df = {r.word: r.n for r in seen.select(F.explode("held").alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()}
    weight = lambda w: math.log((n + 1) / (df.get(w, 0) + 1)) + 1
    lits = lambda x: F.array(*map(F.lit, x))
    out = []
    for t, label, size, places, phrases, _ in rows:
        rarest = [F.struct(F.lit(w).alias("word"), F.lit(weight(w)).alias("weight"), lits(places[w]).alias("places")) for w in sorted(places, key=lambda w: (df.get(w, 0), w))]
        out.append(F.struct(F.lit(t).alias("template"), F.lit(label).alias("label"), F.lit(size).alias("n"), lits(phrases).alias("phrases"), F.array(*rarest).alias("rarest")))
    return spark.range(1).select(F.inline(F.array(*out)))


def aligned(seen: DataFrame, templates: DataFrame, rare: int = RARE, agree: float = AGREE, slack: int = SLACK) -> DataFrame:
    """row, template, label, score and starts (where the template would begin, in steps of ``slack``): enough of the rarest words agree."""
    files = seen.where(F.size("templates") > 0).select("row", "held", "words", F.explode("templates").alias("template")).join(F.broadcast(templates), "template")
    picked = F.slice(F.filter("rarest", lambda r: F.array_contains("held", r["word"])), 1, rare)
    files = files.select("row", "template", "label", "words", picked.alias("rarest")).withColumn("total", F.aggregate("rarest", F.lit(0.0), lambda a, r: a + r["weight"]))
    known = files.withColumn("names", F.transform("rarest", lambda r: r["word"]))
    hits = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("word"), i.alias("at"))), lambda h: F.array_contains("names", h["word"]))
    hits = known.select("row", "template", "label", "total", "rarest", F.explode(hits).alias("hit"))
    posting = hits.select("row", "template", "label", "total", F.col("hit.at").alias("at"), F.explode(F.filter("rarest", lambda r: r["word"] == F.col("hit.word"))).alias("r"))
    begins = posting.select("row", "template", "label", "total", F.col("r.word").alias("word"), F.col("r.weight").alias("weight"), F.explode(F.transform("r.places", lambda p: F.col("at") - p)).alias("begin"))
    step = F.floor(F.col("begin") / slack)
    near = begins.withColumn("step", F.explode(F.array(step, step - 1)))  # a step and the next: places up to ``slack`` words apart share one
    by_word = near.groupBy("row", "template", "label", "total", "step", "word").agg(F.max("weight").alias("weight"))
    found = by_word.groupBy("row", "template", "label", "total", "step").agg(F.sum("weight").alias("w")).where(F.col("w") >= agree * F.col("total"))
    score = F.round(F.max(F.col("w") / F.col("total")), 6)
    return found.groupBy("row", "template", "label").agg(score.alias("score"), F.collect_list("step").alias("steps"))


def verified(found: DataFrame, seen: DataFrame, templates: DataFrame, slack: int = SLACK) -> DataFrame:
    """row, label and score of aligned templates whose key phrases all stand where the template does."""
    files = seen.where(F.size("templates") > 0).select(F.col("row").alias("r_"), "words")
    rows = found.join(F.broadcast(templates.select(F.col("template").alias("t_"), "n", "phrases")), F.col("template") == F.col("t_")).join(files, F.col("row") == F.col("r_"))

    def at(step: Column) -> Column:
        first = F.greatest(step * slack - slack, F.lit(0)).cast("int")
        last = (step * slack + F.col("n") + 3 * slack).cast("int")
        place = F.concat(F.lit(" "), F.array_join(F.slice(F.col("words"), first + 1, F.greatest(last - first, F.lit(0))), " "), F.lit(" "))
        return _let(place, lambda p: F.forall("phrases", lambda x: F.contains(p, F.concat(F.lit(" "), x, F.lit(" ")))))

    return rows.where(F.exists("steps", at)).select("row", "label", "score")


def scan(docs: DataFrame, templates: tuple = TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score for every row of ``docs`` (doc_id, text).

    ``base_labels`` are those of the base phrases, ``labels`` these and the verified templates' ones: distinct, sorted and joined by
    commas, empty if there are none. ``score``: the highest share of weight with which a verified template's words agree; 1 where
    there is none but a base phrase, else 0. Null and empty texts have no words; whole texts are searched, and every place of a
    phrase counts; rows that repeat are scanned each; other columns don't matter; an empty table gives no rows.

    Texts are read in one pass without a shuffle. Only files that hold every key word of a template go on, in a table that is
    written; what is shuffled are places of rare words by file and template, and a row of labels for each file."""
    spark = docs.sparkSession
    rows = template_rows(templates)
    seen = lookups(docs, rows)
    table = index(spark, seen, rows)
    labels = verified(aligned(seen, table), seen, table).groupBy(F.col("row").alias("r_")).agg(F.collect_set("label").alias("found"), F.max("score").alias("best"))
    both = seen.select("row", "doc_id", "n_words", "n_base", "first_word", "last_word", "base").join(stage(labels, "licence-labels"), F.col("row") == F.col("r_"), "left")
    joined = lambda a: F.array_join(F.array_sort(a), ",")
    every = F.array_union(F.col("base"), F.coalesce("found", F.array().cast("array<string>")))
    score = F.coalesce("best", F.when(F.col("n_base") > 0, 1.0).otherwise(0.0))
    return both.select("doc_id", "n_words", "n_base", "first_word", "last_word", joined(F.col("base")).alias("base_labels"), joined(every).alias("labels"), score.alias("score"))


def _oracle() -> str:
    text = lambda x: "'" + x.replace("'", "''") + "'"
    rows = template_rows(TEMPLATES)
    values = lambda pairs: ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else text(x) for x in p) + ")" for p in pairs)
    postings = values((t, w, i) for t, _, _, places, _, _ in rows for w, at in places.items() for i in at)
    base = " UNION ALL ".join(f"SELECT rid, {text(label)} AS label, i - 1 AS spot FROM w, unnest(range(1, len(words) + 1)) AS u(i) WHERE " + " AND ".join(f"words[i + {k}] = {text(p)}" for k, p in enumerate(phrase.split(" "))) for phrase, label in BASE.items())
    return rf"""
WITH w AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
base AS ({base}),
b AS (SELECT rid, count(*) AS n_base, min(spot) AS first_word, max(spot) AS last_word FROM base GROUP BY rid),
t(template, label, n) AS (VALUES {values((r[0], r[1], r[2]) for r in rows)}),
phrase(template, phrase) AS (VALUES {values((r[0], p) for r in rows for p in r[4])}),
needed(template, word) AS (VALUES {values((r[0], x) for r in rows for x in r[5])}),
post(template, word, place) AS (VALUES {postings}),
held AS (SELECT DISTINCT rid, word FROM (SELECT rid, unnest(words) AS word FROM w) SEMI JOIN post USING (word)),
df AS (SELECT word, count(rid) AS n FROM (SELECT DISTINCT word FROM post) LEFT JOIN held USING (word) GROUP BY word),
weight AS (SELECT word, n, ln(((SELECT count(*) FROM w) + 1) / (n + 1)::DOUBLE) + 1 AS weight FROM df),
size AS (SELECT template, count(*) AS size FROM needed GROUP BY template),
cand AS (SELECT rid, template FROM held JOIN needed USING (word) JOIN size USING (template) GROUP BY rid, template, size HAVING count(*) = size),
rare AS (SELECT rid, template, word, weight FROM cand JOIN (SELECT DISTINCT template, word FROM post) USING (template) JOIN held USING (rid, word) JOIN weight USING (word) QUALIFY row_number() OVER (PARTITION BY rid, template ORDER BY n, word) <= {RARE}),
total AS (SELECT rid, template, sum(weight) AS total FROM rare GROUP BY ALL),
places AS (SELECT rid, words[i] AS word, i - 1 AS spot FROM w SEMI JOIN cand USING (rid), unnest(range(1, len(words) + 1)) AS u(i)),
begins AS (SELECT rid, template, word, weight, floor((spot - place) / {SLACK}::DOUBLE)::BIGINT AS step FROM rare JOIN post USING (template, word) JOIN places USING (rid, word)),
steps AS (SELECT rid, template, step, sum(weight) AS weight FROM (SELECT DISTINCT * FROM (SELECT * FROM begins UNION ALL SELECT rid, template, word, weight, step - 1 FROM begins)) GROUP BY ALL),
found AS (SELECT rid, template, step, weight / total AS score FROM steps JOIN total USING (rid, template) WHERE weight >= {AGREE}::DOUBLE * total),
ok AS (SELECT rid, template FROM found JOIN t USING (template) JOIN w USING (rid) JOIN phrase USING (template) GROUP BY rid, template, step
       HAVING bool_and(contains(' ' || array_to_string(words[greatest(step * {SLACK} - {SLACK}, 0) + 1 : step * {SLACK} + n + 3 * {SLACK}], ' ') || ' ', ' ' || phrase || ' '))),
m AS (SELECT rid, label, score FROM found JOIN (SELECT DISTINCT * FROM ok) USING (rid, template) JOIN t USING (template)),
best AS (SELECT rid, round(max(score), 6) AS best FROM m GROUP BY rid),
bl AS (SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS x FROM base GROUP BY rid),
al AS (SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS x FROM (SELECT rid, label FROM base UNION SELECT rid, label FROM m) GROUP BY rid)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word, coalesce(bl.x, '') AS base_labels, coalesce(al.x, '') AS labels, coalesce(best, CASE WHEN n_base > 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS score
FROM w LEFT JOIN b USING (rid) LEFT JOIN best USING (rid) LEFT JOIN bl USING (rid) LEFT JOIN al USING (rid)
"""


ORACLE_SQL = _oracle()
