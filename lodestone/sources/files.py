"""Corpus files as rows: recursive scan, dispatch by extension, decoding."""

from __future__ import annotations

import tempfile
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators.structural import LANGUAGES

#: Strategies by extension; a configured extension that isn't listed is plain text. A later registration of an extension wins.
STRATEGIES = {".md": "markdown", ".lean": "lean", **{e: "code" for some in LANGUAGES.values() for e in some}, ".py": "python"}


def registry(strategies: dict[str, str] | None = None) -> tuple[Column, Column]:
    """Strategy and language of ``ext``, null where it isn't listed.

    Expressions and not a table to join with, so a filter by strategy is applied before a file's content is made.
    """
    language = {e: name for name, some in LANGUAGES.items() for e in some} | {".lean": "lean"}
    listed = strategies or STRATEGIES
    of = lambda table: F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), F.col("ext"))
    return of(listed), F.when(of(listed).isNotNull(), of(language))


def dispatch(files: DataFrame, strategies: dict[str, str] | None = None, fallback: str | None = "plaintext") -> DataFrame:
    """``files`` with strategy and language by ``ext``; without a fallback other files are left out."""
    strategy, language = registry(strategies)
    out = files.withColumns({"strategy": F.coalesce(strategy, F.lit(fallback)), "language": language})
    return out if fallback else out.where("strategy is not null")


def of_columns(rows: DataFrame, path: Column, content: Column) -> DataFrame:
    """Files from a table: any path and text columns."""
    base = rows.select(path.alias("source_path"), content.alias("content"))
    return base.withColumn("file_name", X.base_name(F.col("source_path"))).withColumn("ext", F.lower(X.suffix(F.col("file_name"))))


def read_files(spark: SparkSession, folder: str, extensions: list[str]) -> DataFrame:
    """Files below ``folder`` with a configured extension: source_path (relative), file_name, ext, content, error.

    The extension filter is on the path, before contents are read. Bytes that
    are no UTF-8 are an error in Markdown, whose ``content`` is then null;
    elsewhere they are replaced by U+FFFD.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    root = folder.rstrip("/").split("://")[-1]
    rel = F.regexp_replace(F.url_decode(F.replace(F.col("path"), F.lit("+"), F.lit("%2B"))), rf"^.*?\Q{root}\E/", "")
    named = raw.select(rel.alias("source_path"), "content").withColumn("file_name", X.base_name(F.col("source_path")))
    named = named.withColumn("ext", F.lower(X.suffix(F.col("file_name")))).where(F.col("ext").isin(*extensions))
    good = F.is_valid_utf8(F.col("content").cast("string"))
    text = F.make_valid_utf8(F.col("content").cast("string"))
    strict = F.col("ext") == ".md"
    return named.select(
        "source_path", "file_name", "ext", F.when(~strict | good, text).alias("content"),
        F.when(strict & ~good, F.lit("not valid UTF-8")).alias("error"),
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share; a temporary one in a local session that has none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"{tempfile.gettempdir()}/checkpoints"
    return base.rstrip("/")


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000, size: int = 4 << 20):
    """Bound the rows and bytes of the Arrow batches that Python workers get from the actions inside; the session's settings are put back."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows, "spark.sql.execution.arrow.maxBytesPerBatch": size}
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, str(value))
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def path_order(path: Column) -> Column:
    """Sorts paths by their components."""
    return F.split(path, "/")
