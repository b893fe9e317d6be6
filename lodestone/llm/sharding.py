"""Operator 1: shards of near-equal bytes by sampled splitters and range partition.

Law ``bytes``: records are ordered by (key, row hash). A size-weighted sample of
that composite key gives quantile boundaries; records are range-partitioned by
them, every range is measured exactly, ranges above twice the mean are
subdivided by a second sample taken inside them, and prefix sums over the ranges
place each record on the byte axis, which is cut into equal shards. So shard
sizes differ by about one record, however skewed keys or sizes are: a key that
holds many rows is split by the row hash and, for identical rows, by a salt.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import boxed, fields_of, range_index, stage

#: Rows that a fine range should hold, and bounds on the number of ranges.
ROWS_PER_RANGE, LEAST_RANGES, MOST_RANGES = 200_000, 96, 4096
#: Sampled keys for each range boundary.
PER_CUT = 24


def utf8_size(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus 8 for the id."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long")


def _sample(df: DataFrame, keys: list[str], size: str, n: int) -> list[tuple]:
    """``n`` composite keys drawn with chances in proportion to size (exponential keys), sorted.

    At most ``n`` short rows reach the driver. The draw hashes the row, so that reruns agree.
    """
    u = (F.pmod(F.xxhash64(F.lit(17), *keys), F.lit(1 << 52)) + 1) / F.lit(float((1 << 52) + 2))
    picked = df.select(*keys, (-F.log(u) / F.col(size)).alias("_w")).orderBy("_w").limit(n)
    return sorted((tuple(r)[:-1] for r in picked.collect()), key=lambda t: tuple((v is not None, v) for v in t))


def longs(values: list[int]) -> Column:
    return F.expr(f"array({', '.join(f'{v}L' for v in values)})")


def _quantiles(sample: list[tuple], parts: int) -> list[tuple]:
    if not sample or parts < 2:
        return []
    cuts = [sample[len(sample) * i // parts] for i in range(1, parts)]
    return list(dict.fromkeys(cuts))


def shard_by_bytes(df: DataFrame, key: str, size: Column, n_shards: int = 24) -> DataFrame:
    """Give every row of ``df`` a ``size``, a ``shard`` (0 to n_shards - 1) and a ``slot``.

    All columns of ``df`` are kept; the new columns replace columns of the same
    name. Slots are gapless from 0 within a shard, in key order. A row's place
    is decided by the middle of its bytes on the byte axis. Defined cases: a
    null key sorts first; rows that repeat are told apart by a salt and all
    kept; sizes below 1 count as 1 on the axis; an empty table gives no rows.
    """
    spark = df.sparkSession
    order, z = ["_key", "_hash", "_salt"], "_size"
    fields = [c for c in df.columns if c.lower() not in ("size", "shard", "slot")]
    keyed = boxed(
        df, fields, size=size.cast("long"), _key=F.col(key), _hash=F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]),
        _salt=F.xxhash64(F.monotonically_increasing_id()), _size=F.greatest(size.cast("long"), F.lit(1)),
    )
    rows = stage(keyed, "shard-rows")
    at, types = [F.col(c) for c in order], [dict(rows.dtypes)[c] for c in order]
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum(z), F.lit(0))).first()
    if not n:
        return df.select(*fields).withColumns({"size": F.lit(0).cast("long"), "shard": F.lit(0), "slot": F.lit(0).cast("long")}).limit(0)

    wanted = max(LEAST_RANGES, min(MOST_RANGES, math.ceil(n / ROWS_PER_RANGE)))
    cuts = _quantiles(_sample(rows, order, z, wanted * PER_CUT), wanted)

    def measured(cuts: list[tuple]) -> list:
        r = rows.select(range_index(at, types, cuts).alias("_r"), z)
        return r.groupBy("_r").agg(F.sum(z).alias("b"), F.count("*").alias("c")).orderBy("_r").collect()

    ranges = measured(cuts)
    mean = total / wanted
    over = [r for r in ranges if r["b"] > 2 * mean and r["c"] > 1]
    if over:  # subdivide overfull ranges by samples taken inside them
        inside = rows.where(range_index(at, types, cuts).isin([r["_r"] for r in over]))
        more = math.ceil(sum(r["b"] for r in over) / mean)
        key_of = lambda t: tuple((v is not None, v) for v in t)
        cuts = sorted({*cuts, *_quantiles(_sample(inside, order, z, more * PER_CUT), 2 * more)}, key=key_of)
        ranges = measured(cuts)

    at_bytes, at_rows, base = 0, 0, {}
    for r in ranges:
        base[r["_r"]] = (at_bytes, at_rows)
        at_bytes, at_rows = at_bytes + r["b"], at_rows + r["c"]
    byte_base = longs([base.get(i, (0, 0))[0] for i in range(len(cuts) + 1)])
    row_base = longs([base.get(i, (0, 0))[1] for i in range(len(cuts) + 1)])

    # Only keys and sizes are sorted; the rows themselves are joined to their places.
    inside = Window.partitionBy("_r").orderBy(*order)
    placed = (
        rows.select(*order, z).withColumn("_r", range_index(at, types, cuts))
        .withColumns({
            "_b": F.sum(z).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
            "_n": F.row_number().over(inside),
        })
        .withColumn("_b", F.element_at(byte_base, F.col("_r") + 1) + F.col("_b"))
        .withColumn("_n", F.element_at(row_base, F.col("_r") + 1) + F.col("_n"))
        .withColumn("shard", F.least(F.lit(n_shards - 1), F.floor((F.col("_b") - F.col(z) / 2.0) * n_shards / F.lit(float(total)))).cast("int"))
    )
    placed = stage(placed.select(F.col("_hash").alias("_h"), F.col("_salt").alias("_s"), "shard", "_n"), "shard-placed")
    starts = {r["shard"]: r["n"] for r in placed.groupBy("shard").agg(F.min("_n").alias("n")).collect()}
    start = longs([starts.get(i, 0) for i in range(n_shards)])
    both = rows.join(placed, (F.col("_hash") == F.col("_h")) & (F.col("_salt") == F.col("_s")))
    return both.select(*fields_of(fields), "size", "shard", (F.col("_n") - F.element_at(start, F.col("shard") + 1)).alias("slot"))


def shard_documents(docs: DataFrame, n_shards: int = 24) -> DataFrame:
    """Documents with ``size``, ``shard`` and ``slot``; the key is ``doc_id``."""
    return shard_by_bytes(docs, "doc_id", utf8_size(F.col("text")), n_shards)


def write_shards(sharded: DataFrame, path: str) -> None:
    """Write a sharded table as one folder for each shard, in slot order.

    Rows are dealt by (shard, block of slots), so that no task holds a whole shard.
    """
    block = (F.col("slot") / 1_000_000).cast("long")
    (sharded.withColumn("_block", block).repartition("shard", "_block").sortWithinPartitions("shard", "slot")
     .drop("_block").write.partitionBy("shard").parquet(path))


def op1_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    digest = docs.select(
        "doc_id",
        utf8_size(F.col("text")).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).cast("long").alias("text_crc32"),
    )
    out = shard_by_bytes(digest, "doc_id", F.col("size"), 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
