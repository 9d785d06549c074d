"""Sharding by a two-pass external shuffle.

Pass one scatters whole records into buckets by seeded hashes: the shard by a hash that only doc_id and the number of
shards decide, the bucket within the shard by a second hash of the record. Each shard has as many buckets as its own
bytes need, so that a bucket fits in memory. Pass two orders each bucket by a Fisher-Yates shuffle with the bucket's own
seed; buckets are numbered, and a bucket's number is its task. A record's slot is its place in its bucket plus the sizes
of the shard's buckets before it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.llm.common import KeyFilter, fresh, group_starts, lean, stage, whole_groups

BUCKET_BYTES = 16 << 20
SEED = 20240229
TASKS = 50_000  # of the second pass, at most; where there are more buckets, a task has as many in a row as any other, and takes them one by one


def key_shard(key: Column, shards: int, seed: int = SEED) -> Column:
    """Rendezvous hashing: the shard whose hash with ``key`` is highest; with one more shard a key stays or goes to the new one.

    A null key is hashed as such and has a shard like any other."""
    scores = [F.struct(F.xxhash64(key, F.lit(seed), F.lit(i)).alias("h"), F.lit(-i).alias("i")) for i in range(shards)]
    return (-F.greatest(*scores)["i"]).cast("int") if shards > 1 else F.lit(0)


def fisher_yates(n: int, seed: int) -> np.ndarray:
    """A permutation of n: numpy's shuffle is Fisher and Yates's, from the last place downwards."""
    order = np.arange(n)
    np.random.Generator(np.random.PCG64(seed & (2**64 - 1))).shuffle(order)
    return order


def shuffled(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text", seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``docs`` whole, with shard, bucket and slot (gapless from 0 in each shard, in shuffled order); such columns of ``docs`` are replaced.

    Law ``key``: only the key and ``shards`` decide a row's shard. Rows of one key share a shard but not a bucket: the
    bucket hash takes in the text and the other columns. Rows alike in all columns are interchangeable; where there are
    more of them than fit in a bucket, they are collapsed into one row with their number and dealt evenly to all
    buckets of their shard. Null keys and texts are hashed as nulls. An empty table gives no rows. The number of
    buckets follows from the bytes of all texts in a shard, so that a task holds one bucket of about ``bucket_bytes``,
    or a longer text alone; the bytes of each shard are all that the driver sees."""
    source = docs.drop("shard", "bucket", "slot")
    size, h1, h2, copies, begin = fresh(source, "record_bytes", "record_hash", "record_hash_2", "copies", "begin")
    # maps have no hash; a null must not hash as nothing
    parts = [x for c, t in source.dtypes for x in ((F.to_json(F.struct(F.col(f"`{c}`"))) if "map<" in t else F.col(f"`{c}`")), F.col(f"`{c}`").isNull())]
    rows = source.withColumn("shard", key_shard(F.col(key), shards, seed)).withColumns({h1: F.xxhash64(F.lit(seed + 1), *parts), h2: F.xxhash64(F.lit(seed + 2), *parts)})
    weight = F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + 8
    alike = rows.select("shard", h1, h2, weight.alias(size)).groupBy("shard", h1, h2).agg(F.sum(size).alias(size), F.count("*").alias(copies))
    alike = stage(alike, "records")
    total = {r["shard"]: r[size] for r in alike.groupBy("shard").agg(F.sum(size).alias(size)).collect()}
    buckets = [max(1, math.ceil(total.get(s, 0) / bucket_bytes)) for s in range(shards)]
    n_buckets = F.element_at(F.array(*[F.lit(b) for b in buckets]), F.col("shard") + 1)
    hot = (F.col(copies) > 1) & (F.col(size) > bucket_bytes)
    many = alike.where(hot).select(F.col(h1).alias(f"{h1}_k"), F.col(h2).alias(f"{h2}_k"))
    same = (F.col(h1) == F.col(f"{h1}_k")) & (F.col(h2) == F.col(f"{h2}_k"))

    def evenly(df: DataFrame) -> DataFrame:
        """Rows that stand for ``copies`` ones, dealt to all buckets of their shard."""
        out = df.withColumn("bucket", F.explode(F.sequence(F.lit(0), n_buckets - 1)))
        share = F.floor(F.col(copies) / n_buckets) + (F.col("bucket") < F.col(copies) % n_buckets).cast("long")
        return out.withColumn(copies, share).where(F.col(copies) > 0)

    usual, one = rows, None
    if not many.isEmpty():
        (flag,) = fresh(rows, "collapsed")
        marked = KeyFilter(many, f"{h1}_k", f"{h2}_k").flagged(rows, flag, h1, h2)
        unsure = marked.where(F.col(flag)).drop(flag)
        usual = marked.where(~F.col(flag)).drop(flag).union(unsure.join(many, same, "left_anti"))
        one = unsure.join(many, same, "left_semi").groupBy(h1, h2).agg(F.first(F.struct(*[F.col(f"`{c}`") for c in rows.columns])).alias("r"), F.count("*").alias("n"))
        one = evenly(one.select("r.*", F.col("n").alias(copies)))
    place = F.pmod(F.col(h1), n_buckets).cast("int")
    usual = usual.withColumn("bucket", place).withColumn(copies, F.lit(1).cast("long"))
    dealt = usual if one is None else usual.unionByName(one)
    w = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = [x.select("shard", "bucket", copies) for x in (alike.where(~hot).withColumn("bucket", place), evenly(alike.where(hot)))]
    begins = counts[0].union(counts[1]).groupBy("shard", "bucket").agg(F.sum(copies).alias("rows"))  # a row for each bucket
    begins = begins.select("shard", "bucket", F.coalesce(F.sum("rows").over(w), F.lit(0)).alias(begin), F.lit(0).cast("long").alias(copies))
    # where a bucket begins travels to it as a row without a record
    dealt = dealt.withColumn(begin, F.lit(None).cast("long")).unionByName(begins, allowMissingColumns=True)
    schema = dealt.select(*[F.col(f"`{c}`") for c in source.columns], "shard", "bucket", F.lit(0).cast("long").alias("slot")).schema

    def order(table: pa.Table) -> pa.Table:
        """A bucket's records, shuffled: they come sorted by their hashes, so that the order in which they arrived doesn't count."""
        shard, bucket = table.column("shard")[0].as_py(), table.column("bucket")[0].as_py()
        lead = pc.max(table.column(begin)).as_py()
        table = table.filter(pc.greater(table.column(copies), 0))
        table = table.take(pa.array(np.repeat(np.arange(table.num_rows), table.column(copies).to_numpy())))
        place = np.empty(table.num_rows, np.int64)
        place[fisher_yates(table.num_rows, seed * 1_000_003 + shard * 65_537 + bucket)] = np.arange(table.num_rows)
        return table.drop_columns([h1, h2, copies, begin]).append_column("slot", pa.array(place + lead))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = ["shard", "bucket"]
        for table in whole_groups(batches, keys, most=bucket_bytes):
            starts = group_starts(table, keys)
            for lo, hi in zip(starts[:-1], starts[1:], strict=True):
                yield from order(table.slice(lo, hi - lo)).select(schema.names).to_batches()

    tasks = min(sum(buckets), TASKS)
    before = F.element_at(F.array(*[F.lit(b).cast("long") for b in np.cumsum([0, *buckets[:-1]]).tolist()]), F.col("shard") + 1)
    number = F.floor((before + F.col("bucket")) * tasks / sum(buckets)).cast("int")
    return dealt.repartitionById(tasks, number).sortWithinPartitions("shard", "bucket", h1, h2).mapInArrow(lean(run), schema)


def write_shards(docs: DataFrame, path: str, shards: int, **options) -> None:
    """Write the shuffled shards below ``path``, one folder a shard, rows in slot order within each file."""
    out = shuffled(docs, shards, **options)
    out.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)  # a task has whole buckets already


def shard_digest(docs: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (with one more shard) of every row."""
    rows = shuffled(docs, shards)
    return rows.select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"), F.crc32(F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))).alias("text_crc32"),
        F.lit("key").alias("law"), "shard", "slot", key_shard(F.col("doc_id"), shards + 1).alias("grown_shard"),
    )
