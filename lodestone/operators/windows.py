"""Fixed line windows and whole files: one row in, one row for each window out, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone import schemas as S
from lodestone.functions import text as X


def line_windows(text: Column, window: int = S.WINDOW_LINES, max_chars: int | None = None) -> Column:
    """Array of (text, start_line, end_line); blank windows are left out, a capped text keeps its whole range."""

    def cut(lines: Column) -> Column:
        starts = F.when(F.size(lines) > 0, F.sequence(F.lit(1), F.greatest(F.size(lines), F.lit(1)), F.lit(window))).otherwise(F.array().cast("array<int>"))
        part = lambda s: X.strip(X.joined(lines, s, F.least(s + window - 1, F.size(lines))))
        capped = lambda t: t if max_chars is None else F.substring(t, 1, max_chars)
        rows = F.transform(starts, lambda s: F.struct(capped(part(s)).alias("text"), s.alias("start_line"), F.least(s + window - 1, F.size(lines)).alias("end_line")))
        return F.filter(rows, lambda r: r["text"] != "")

    return X.let(X.file_lines(text), cut)


def window_chunks(files: DataFrame, window: int = S.WINDOW_LINES, max_chars: int | None = None) -> DataFrame:
    """Chunks of ``files`` (source_path, file_name, content)."""
    rows = files.select("source_path", "file_name", F.explode(line_windows(F.col("content"), window, max_chars)).alias("c"))
    title = F.concat_ws(":", "file_name", F.col("c.start_line").cast("string"))
    return rows.select("source_path", "file_name", title.alias("section_title"), "c.*", F.lit("plaintext").alias("chunk_type"))


def whole_files(files: DataFrame) -> DataFrame:
    """One chunk for each file; its text is capped for embedding, its range is the file's."""
    return window_chunks(files, S.WHOLE_FILE, S.WHOLE_FILE_CHARS)
