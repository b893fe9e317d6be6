"""Plain text: paragraphs gathered up to the largest size, then small chunks joined forward."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone import schemas as S
from lodestone.functions import text as X
from lodestone.operators.markdown import gather, merge_heads


def paragraphs(lines: Column, file_name: Column) -> Column:
    """(title, start_line, end_line, text) of every run of lines that aren't blank."""

    def cut(full: Column) -> Column:
        at = lambda i: F.element_at(full, i)
        size = F.size(full)
        numbers = F.when(size > 0, F.sequence(F.lit(1), F.greatest(size, F.lit(1)))).otherwise(F.array().cast("array<int>"))
        starts = F.filter(numbers, lambda i: at(i) & F.when(i > 1, ~at(F.greatest(i - 1, F.lit(1)))).otherwise(True))
        stops = F.filter(numbers, lambda i: at(i) & F.when(i < size, ~at(F.least(i + 1, size))).otherwise(True))
        return F.transform(F.arrays_zip(starts.alias("s"), stops.alias("e")), lambda r: F.struct(
            file_name.alias("title"), r["s"].alias("start_line"), r["e"].alias("end_line"), X.strip(X.joined(lines, r["s"], r["e"])).alias("text")))

    return X.let(F.transform(lines, lambda x: ~X.blank(x)), cut)


def fill_heads(chunks: Column, most: int) -> Column:
    """Places where a chunk begins when paragraphs are gathered while their range stays within ``most`` lines."""
    start = F.struct(F.array().cast("array<int>").alias("heads"), F.lit(0).alias("from"), F.lit(0).alias("i"))

    def step(a: Column, c: Column) -> Column:
        new = (F.size(a["heads"]) == 0) | (F.lit(most > 0) & (c["end_line"] - a["from"] + 1 > most))
        return F.struct(
            F.when(new, F.concat(a["heads"], F.array(a["i"] + 1))).otherwise(a["heads"]).alias("heads"),
            F.when(new, c["start_line"]).otherwise(a["from"]).alias("from"), (a["i"] + 1).alias("i"),
        )

    return F.aggregate(chunks, start, step, lambda a: a["heads"])


def plaintext_chunks(files: DataFrame, least: int = S.MIN_LINES, most: int = S.MAX_LINES) -> DataFrame:
    """Chunks of ``files``. A paragraph over ``most`` lines stays whole; repeated paragraphs keep the first one's start."""
    lines = files.select("source_path", "file_name", X.file_lines(F.col("content")).alias("_lines"))
    filled = X.let(paragraphs(F.col("_lines"), F.col("file_name")), lambda p: X.let(fill_heads(p, most), lambda h: gather(p, h)))
    merged = filled if least <= 0 else X.let(filled, lambda c: X.let(merge_heads(c, least, False), lambda h: gather(c, h)))
    rows = lines.select("source_path", "file_name", F.explode(merged).alias("c"))
    return rows.select("source_path", "file_name", F.col("c.title").alias("section_title"), "c.start_line", "c.end_line", "c.text", F.lit("plaintext").alias("chunk_type"))
