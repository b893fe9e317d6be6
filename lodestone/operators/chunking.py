"""All files to chunks and index entries: dispatch, parse, errors as rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone import schemas as S
from lodestone.config import ProjectConfig
from lodestone.functions import text as X
from lodestone.operators.lean import parse_lean
from lodestone.operators.markdown import markdown_chunks, markdown_entries, term_entries
from lodestone.operators.parsing import parsed_files
from lodestone.operators.plaintext import plaintext_chunks
from lodestone.operators.python_code import parse_python
from lodestone.operators.structural import parse_code
from lodestone.operators.windows import window_chunks
from lodestone.sources.files import STRATEGIES, dispatch

PARSERS = {"python": parse_python, "lean": parse_lean, "code": parse_code}


@dataclass
class Chunked:
    """Frames of one corpus; all are lazy."""

    chunks: DataFrame
    entries: DataFrame
    errors: DataFrame


def complete(chunks: DataFrame) -> DataFrame:
    """All chunk columns in their order; those that a chunker doesn't give are null, density is 0."""
    have = set(chunks.columns)
    zero = {"math_density": F.lit(0.0)}
    return chunks.select(*[(F.col(f.name) if f.name in have else zero.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name) for f in S.CHUNK])


def _code_chunks(parsed: DataFrame) -> DataFrame:
    kind = F.lit("code")
    own = X.chunk_id(F.col("source_path"), kind, F.col("start_line"), F.col("end_line"), F.col("name"))
    parent = X.chunk_id(F.col("source_path"), kind, F.col("parent_start"), F.col("parent_end"), F.col("parent_name"))
    return parsed.where("text is not null").select(
        "text", "file_name", "section_title", "start_line", "end_line", "source_path", own.alias("chunk_id"), kind.alias("chunk_type"),
        "language", F.col("name").alias("symbol_name"), F.col("kind").alias("symbol_type"), F.when(F.col("parent_start").isNotNull(), parent).alias("parent_id"),
    )


def _lean_terms(files: DataFrame, entries: DataFrame, terms: list[str]) -> DataFrame:
    """Key-term entries of Lean files; concepts already declared in a file of that name are skipped."""
    known = entries.groupBy("file_path").agg(F.collect_set(F.lower("concept")).alias("_known")).withColumnRenamed("file_path", "_path")
    rows = files.join(known, F.col("source_path") == F.col("_path"), "left").withColumn("_lines", X.file_lines(F.col("content")))
    found = term_entries(F.col("_lines"), terms, F.coalesce("_known", F.array().cast("array<string>")))
    return rows.select("source_path", "file_name", F.explode(found).alias("e")).select("e.concept", "file_name", F.col("source_path").alias("file_path"), "e.start_line", "e.end_line", "e.entry_type")


def chunk_files(files: DataFrame, config: ProjectConfig | None = None, strategies: dict[str, str] | None = None, keep: Callable[[DataFrame, str], DataFrame] | None = None) -> Chunked:
    """Chunks, pointer-index entries and errors of ``files`` (source_path, file_name, ext, content[, error]).

    Order within a file is by start line. Only Markdown and Lean files are
    searched for key terms. ``keep`` writes a frame and reads it back: with it code
    is parsed once for chunks, entries and errors, without it once for each that is asked for.
    """
    config = config or ProjectConfig()
    routed = dispatch(files if "error" in files.columns else files.withColumn("error", F.lit(None).cast("string")), strategies)
    good = routed.where("error is null")
    of = lambda *names: good.where(F.col("strategy").isin(*names))
    parsed = parsed_files(of(*PARSERS), PARSERS, config.code_chunk_min_lines, config.code_chunk_max_lines)
    parsed = keep(parsed, "parsed") if keep else parsed
    plain = plaintext_chunks(of("plaintext"), config.min_chunk_lines, config.max_chunk_lines)
    plain = plain.withColumn("chunk_id", X.chunk_id(F.col("source_path"), F.col("chunk_type"), F.col("start_line"), F.col("end_line"), F.lit(None)))
    chunks = complete(markdown_chunks(of("markdown"), config.min_chunk_lines, config.max_chunk_lines)).unionByName(complete(plain)).unionByName(complete(_code_chunks(parsed)))
    listed = (strategies or STRATEGIES).values()  # a strategy that no extension has needs no pass over the files
    for name, *cut in (("line-based",), ("whole-file", S.WHOLE_FILE, S.WHOLE_FILE_CHARS)):
        chunks = chunks.unionByName(complete(window_chunks(of(name), *cut))) if name in listed else chunks
    code = parsed.where("text is null and error is null").select(
        F.col("name").alias("concept"), "file_name", F.col("source_path").alias("file_path"), "start_line", "end_line", F.col("kind").alias("entry_type"))
    entries = markdown_entries(of("markdown"), config.key_terms).unionByName(code)
    if config.key_terms:
        lean = of("lean")
        entries = entries.unionByName(_lean_terms(lean, code.where(F.lower("file_name").endswith(".lean")), config.key_terms))
    errors = routed.where("error is not null").select("source_path", "error").unionByName(parsed.where("error is not null").select("source_path", "error"))
    return Chunked(chunks, entries, errors)
