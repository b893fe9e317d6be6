"""Labelled queries, line weights, and the stored pointer index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone import schemas as S
from lodestone.functions import text as X


def load_dataset(spark: SparkSession, path: str) -> DataFrame:
    """corpus_dir, query_id, query, tool, decisive_spans, supportive_spans of a JSON file; an unknown tool raises when read.

    A dataset without queries gives no rows.
    """
    raw = spark.read.schema(S.GOLDEN).option("multiLine", "true").json(path)
    rows = raw.select("corpus_dir", F.explode("queries").alias("q"))
    tool = F.coalesce(F.col("q.tool"), F.lit("search_documents"))
    checked = F.when(tool.isin(*S.TOOLS), tool).otherwise(F.raise_error(F.concat(F.lit("unknown tool: "), tool)))
    none = F.array().cast(f"array<{S.SPAN}>")
    return rows.select(
        "corpus_dir", F.col("q.id").alias("query_id"), "q.query", checked.alias("tool"),
        F.coalesce("q.decisive_spans", none).alias("decisive_spans"), F.coalesce("q.supportive_spans", none).alias("supportive_spans"),
    )


def gold_spans(dataset: DataFrame) -> DataFrame:
    """A row for each span that has a range: query_id, grade, span_id, file, start_line, end_line."""
    def graded(column: str, grade: int):
        return F.transform(column, lambda s, i: F.struct(F.lit(grade).alias("grade"), i.alias("span_id"), s["file"].alias("file"), s["start_line"].alias("start_line"), s["end_line"].alias("end_line")))

    both = F.concat(graded("decisive_spans", S.DECISIVE), graded("supportive_spans", S.SUPPORTIVE))
    return dataset.select("query_id", F.explode(both).alias("s")).select("query_id", "s.*").where("start_line is not null and end_line is not null")


def line_weights(files: DataFrame) -> DataFrame:
    """basename, line_no, tokens of every line; of files with one basename the last by path counts."""
    last = files.groupBy("file_name").agg(F.max_by("source_path", F.split("source_path", "/")).alias("_last"))
    one = files.join(last.withColumnRenamed("file_name", "_name"), (F.col("source_path") == F.col("_last")) & (F.col("file_name") == F.col("_name")), "left_semi")
    rows = one.select("file_name", F.posexplode(_split_lines(F.col("content"))).alias("at", "line"))
    return rows.select(F.col("file_name").alias("basename"), (F.col("at") + 1).alias("line_no"), X.n_tokens(F.col("line")).alias("tokens"))


def line_counts(files: DataFrame) -> DataFrame:
    """basename, counts: tokens of a file's lines in one array; of files with one basename the last by path counts. Only counts are shuffled."""
    rows = files.select("file_name", F.split("source_path", "/").alias("_path"), F.transform(_split_lines(F.col("content")), X.n_tokens).alias("counts"))
    return rows.groupBy(F.col("file_name").alias("basename")).agg(F.max_by("counts", "_path").alias("counts"))


def _split_lines(text):
    """Lines at every boundary that Python's ``splitlines`` knows."""
    return X.file_lines(F.regexp_replace(X.unified(text), r"[\x0B\x0C\x1C-\x1E\x85  ]", "\n"))


def save_index(entries: DataFrame, path: str) -> None:
    entries.select(*S.INDEX_ENTRY.fieldNames()).write.mode("overwrite").json(path)


def load_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.INDEX_ENTRY).json(path)
