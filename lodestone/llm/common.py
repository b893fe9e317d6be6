"""Helpers shared by the training-data operators: staging, keys, range search."""

from __future__ import annotations

import math
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of characters other than space, TAB, LF, VT, FF, CR.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
#: Bytes of a row group of staged tables: a task holds one in memory while it writes.
ROW_GROUP = 16 << 20


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Where it is unset a local session (as in tests) gets a temporary folder; on
    a cluster that is an error, since executors don't share one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"{tempfile.gettempdir()}/checkpoints"
    return f"{base.rstrip('/')}/lodestone"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def settings(spark: SparkSession, **values: str):
    """The session with these settings (``__`` stands for a dot); what was set before is put back."""
    before = {}
    for key, value in values.items():
        key = key.replace("__", ".")
        before[key] = spark.conf.get(key, None)
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def worker_batches(spark: SparkSession, rows: int = 2000, size: int = 4 << 20):
    """Bound the rows and bytes of an Arrow batch that Python workers get from the actions inside."""
    return settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch=str(rows), spark__sql__execution__arrow__maxBytesPerBatch=str(size))


def stage(df: DataFrame, name: str, rows: int = 2000, by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back.

    Cuts the lineage in a way that survives lost executors: the files are in the
    shared store. Spark deletes the shuffle files of the write when it ends.
    ``rows``: most rows of an Arrow batch that a Python worker gets meanwhile; the
    session's own settings are put back. ``by``: a column of few values that get a
    folder each, so that they can be read and dropped apart.
    """
    spark, schema = df.sparkSession, df.schema
    path = scratch_path(spark, name)
    with worker_batches(spark, rows), settings(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
        writer = df.write.option("parquet.block.size", ROW_GROUP)
        (writer.partitionBy(by) if by else writer).parquet(path)
    return spark.read.schema(schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that no later plan reads."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def drop_staged(*tables: DataFrame) -> None:
    """Delete the folders that hold files of these tables returned by ``stage``; no later plan may read them."""
    for df in tables:
        for f in {x.rpartition("/")[0] for x in df.inputFiles()}:
            if "/lodestone/" in f:
                drop_path(df.sparkSession, f)


def n_words(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.when(text.isNull(), F.lit(0)).otherwise(F.regexp_count(text, F.lit(WORD))).cast("long")


def range_index(keys: list[Column], types: list[str], cuts: list[tuple]) -> Column:
    """Index of the range that holds a composite key: how many cuts are at or below it.

    Two-level search, so a row is compared with about 2 * sqrt(len(cuts)) cuts.
    ``cuts`` is sorted; its size is bounded by the caller's parameters.
    """
    if not cuts:
        return F.lit(0)
    key = F.struct(*[k.alias(f"c{i}") for i, k in enumerate(keys)])

    def text(v: object, t: str) -> str:
        if v is None:
            return f"cast(null as {t})"
        return f"cast(cast(X'{str(v).encode().hex()}' as string) as {t})"

    def array(some: list[tuple]) -> str:
        return f"array({', '.join('struct(' + ', '.join(f'{text(v, t)} as c{i}' for i, (v, t) in enumerate(zip(c, types))) + ')' for c in some)})"

    if len(cuts) <= 16:
        return F.size(F.filter(F.expr(array(cuts)), lambda c: c <= key))
    step = math.isqrt(len(cuts) - 1) + 1
    blocks = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    heads = F.expr(array([b[0] for b in blocks]))
    rest = F.expr(f"array({', '.join(map(array, blocks))})")
    block = F.size(F.filter(heads, lambda c: c <= key))
    inside = F.size(F.filter(F.element_at(rest, F.greatest(block, F.lit(1))), lambda c: c <= key))
    return F.when(block == 0, F.lit(0)).otherwise((block - 1) * step + inside)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once: a lambda variable is not copied into inner lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def is_held_out(doc_id: Column, of: int, rest: int) -> Column:
    """crc32(doc_id as text) mod ``of`` is ``rest``; a null id is the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % of == rest


def boxed(df: DataFrame, fields: list[str] | None = None, **keys: Column) -> DataFrame:
    """``_row`` holds the fields (all columns by default), beside it the given keys: names of ``df`` can't clash with an operator's own."""
    row = F.struct(*[F.col(f"`{c}`") for c in (df.columns if fields is None else fields)])
    return df.select(row.alias("_row"), *[v.alias(k) for k, v in keys.items()])


def beside_text(df: DataFrame, **keys: Column) -> DataFrame:
    """``boxed`` with all columns but ``text``, which stands beside them: so a row carries it once."""
    return boxed(df, [c for c in df.columns if c != "text"], text=F.col("text"), **keys)


def fields_of(names: list[str], **changed: Column) -> list[Column]:
    """The named fields of ``_row``; those in ``changed`` are replaced."""
    return [changed.get(c, F.col("_row")[c]).alias(c) for c in names]
