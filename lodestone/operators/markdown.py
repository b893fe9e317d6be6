"""Markdown: sections, merging of small and splitting of large ones, and the pointer-index scan.

Everything runs inside a row: a file is an array of lines, a section is a pair
of places in it, folds carry line numbers only, and texts are joined once at
the end. So there is no shuffle and no Python worker, however large the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone import schemas as S
from lodestone.functions import text as X

# Kinds of formal objects, and how far one may reach.
FORMAL_KINDS = ["Definition", "Theorem", "Proposition", "Corollary", "Lemma", "Remark", "Example"]
FORMAL_REACH = 50
FORMAL = rf"(?iU)\*\*({'|'.join(FORMAL_KINDS)}){X.WS}+([\d.]+)(?:\*\*|{X.WS})"


def _ends(starts: Column, last: Column) -> Column:
    """For ordered starts, the place before the next one."""
    return F.transform(starts, lambda s, i: F.when(i + 1 < F.size(starts), F.element_at(starts, F.least(i + 2, F.size(starts))) - 1).otherwise(last))


def _numbers(lines: Column, keep) -> Column:
    """Numbers (from 1) of the lines that ``keep`` holds for."""
    marked = F.transform(lines, lambda x, i: F.when(keep(x), i + 1))
    return F.filter(marked, lambda i: i.isNotNull())


def sections(lines: Column, file_name: Column) -> Column:
    """Pass 1: (title, start_line, end_line, text) from each header to before the next; text before the first header bears the file's name."""

    def cut(starts: Column) -> Column:
        rows = F.transform(F.arrays_zip(starts.alias("s"), _ends(starts, F.size(lines)).alias("e")), lambda r: F.struct(
            F.when(X.is_header(F.element_at(lines, r["s"])), X.header_title(F.element_at(lines, r["s"]))).otherwise(file_name).alias("title"),
            r["s"].alias("start_line"), r["e"].alias("end_line"), X.strip(X.joined(lines, r["s"], r["e"])).alias("text"),
        ))
        return F.filter(rows, lambda r: r["text"] != "")

    heads = _numbers(lines, X.is_header)
    starts = F.when(F.size(lines) == 0, F.array().cast("array<int>")).otherwise(F.array_distinct(F.concat(F.array(F.lit(1)), heads)))
    return X.let(starts, cut)


def merge_heads(chunks: Column, least: int, backward: bool) -> Column:
    """Places where a merged chunk begins: while what has been gathered is under ``least`` lines, the next joins it.

    ``backward``: a last chunk that is still small joins the one before it.
    """
    start = F.struct(F.array().cast("array<int>").alias("heads"), F.lit(0).alias("from"), F.lit(0).alias("to"), F.lit(0).alias("i"))

    def step(a: Column, c: Column) -> Column:
        joins = (F.size(a["heads"]) > 0) & (a["to"] - a["from"] + 1 < least)
        return F.struct(
            F.when(joins, a["heads"]).otherwise(F.concat(a["heads"], F.array(a["i"] + 1))).alias("heads"),
            F.when(joins, a["from"]).otherwise(c["start_line"]).alias("from"), c["end_line"].alias("to"), (a["i"] + 1).alias("i"),
        )

    def done(a: Column) -> Column:
        small = F.lit(backward) & (F.size(a["heads"]) > 1) & (a["to"] - a["from"] + 1 < least)
        return F.when(small, F.slice(a["heads"], 1, F.greatest(F.size(a["heads"]) - 1, F.lit(0)))).otherwise(a["heads"])

    return F.aggregate(chunks, start, step, done)


def gather(chunks: Column, heads: Column) -> Column:
    """Chunks joined by runs that begin at ``heads``: the first's title and start, the last's end, texts parted by a blank line."""
    ends = _ends(heads, F.size(chunks))
    return F.transform(F.arrays_zip(heads.alias("s"), ends.alias("e")), lambda r: F.struct(
        F.element_at(chunks, r["s"])["title"].alias("title"), F.element_at(chunks, r["s"])["start_line"].alias("start_line"),
        F.element_at(chunks, r["e"])["end_line"].alias("end_line"),
        F.array_join(F.transform(F.slice(chunks, r["s"], r["e"] - r["s"] + 1), lambda c: c["text"]), "\n\n").alias("text"),
    ))


def merge_small(chunks: Column, least: int = S.MIN_LINES) -> Column:
    """Pass 2."""
    return chunks if least <= 0 else X.let(chunks, lambda c: X.let(merge_heads(c, least, True), lambda h: gather(c, h)))


def cut_places(lines: Column, most: int) -> Column:
    """Greedy cuts at the last safe blank line within ``most`` lines of a part's start, else at the first one after.

    Places count from 0. Safe: not inside a $$ block. At most one cut for each
    blank line, so the fold runs over those.
    """
    marked = F.aggregate(
        lines, F.struct(F.lit(False).alias("inside"), F.array().cast("array<int>").alias("safe"), F.lit(0).alias("i")),
        lambda a, x: X.let(a["inside"] != X.starts_display(x), lambda inside: F.struct(
            inside.alias("inside"),
            F.when(X.blank(x) & ~inside, F.concat(a["safe"], F.array(a["i"]))).otherwise(a["safe"]).alias("safe"), (a["i"] + 1).alias("i"),
        )),
        lambda a: a["safe"],
    )

    def cuts(safe: Column) -> Column:
        def step(a: Column, _: Column) -> Column:
            near = F.array_max(F.filter(safe, lambda s: (s > a["start"]) & (s <= a["start"] + most)))
            at = F.coalesce(near, F.array_min(F.filter(safe, lambda s: s > a["start"])))
            at = F.when(a["start"] + most < F.size(lines), at)
            return F.struct(F.coalesce(at + 1, a["start"]).alias("start"), F.when(at.isNotNull(), F.concat(a["cuts"], F.array(at))).otherwise(a["cuts"]).alias("cuts"))

        return F.aggregate(safe, F.struct(F.lit(0).alias("start"), F.array().cast("array<int>").alias("cuts")), step, lambda a: a["cuts"])

    return X.let(marked, cuts)


def split_large(chunks: Column, most: int = S.MAX_LINES) -> Column:
    """Pass 3: later parts repeat the section's title; a chunk without safe blank lines stays whole."""
    if most <= 0:
        return chunks

    def parts(c: Column, lines: Column, cuts: Column) -> Column:
        starts = F.concat(F.array(F.lit(0)), F.transform(cuts, lambda x: x + 1))
        stops = F.concat(cuts, F.array(F.size(lines)))
        rows = F.transform(F.arrays_zip(starts.alias("s"), stops.alias("e")), lambda r: F.struct(
            X.strip(X.joined(lines, r["s"] + 1, r["e"])).alias("text"), (c["start_line"] + r["s"]).alias("start_line"),
            F.when(r["e"] < F.size(lines), c["start_line"] + r["e"] - 1).otherwise(c["end_line"]).alias("end_line"),
        ))
        full = F.filter(rows, lambda r: r["text"] != "")
        named = F.transform(full, lambda r, i: F.struct(
            c["title"].alias("title"), r["start_line"].alias("start_line"), r["end_line"].alias("end_line"),
            F.when(i > 0, F.concat(F.lit("## "), c["title"], F.lit(" (continued)\n\n"), r["text"])).otherwise(r["text"]).alias("text"),
        ))
        return F.when((F.size(cuts) == 0) | (F.size(full) == 0), F.array(c)).otherwise(named)

    def one(c: Column) -> Column:
        lines = F.split(c["text"], "\n", -1)
        return F.when(
            c["end_line"] - c["start_line"] + 1 > most,
            X.let(lines, lambda x: F.when(F.size(x) > most, X.let(cut_places(x, most), lambda p: parts(c, x, p))).otherwise(F.array(c))),
        ).otherwise(F.array(c))

    return F.flatten(F.transform(chunks, one))


def markdown_chunks(files: DataFrame, least: int = S.MIN_LINES, most: int = S.MAX_LINES) -> DataFrame:
    """Chunks of ``files`` (source_path, file_name, content) with their math density."""
    lines = files.select("source_path", "file_name", X.file_lines(F.col("content")).alias("_lines"))
    made = lines.select("source_path", "file_name", F.explode(split_large(merge_small(sections(F.col("_lines"), F.col("file_name")), least), most)).alias("c"))
    return made.select(
        "source_path", "file_name", F.col("c.title").alias("section_title"), "c.start_line", "c.end_line", "c.text",
        X.math_density(F.col("c.text")).alias("math_density"), F.lit("markdown").alias("chunk_type"),
    )


def section_entries(lines: Column) -> Column:
    """(concept, start_line, end_line, entry_type, at) of each titled section, up to before the next header of any level."""
    heads = _numbers(lines, X.is_header)
    return X.let(heads, lambda h: F.transform(F.arrays_zip(h.alias("s"), _ends(h, F.size(lines)).alias("e")), lambda r: F.struct(
        X.strip(X.header_title(F.element_at(lines, r["s"]))).alias("concept"), r["s"].alias("start_line"), r["e"].alias("end_line"), F.lit("section").alias("entry_type"),
    )))


def formal_entries(lines: Column) -> Column:
    """Bold numbered definitions, theorems and the like, at most one for each line.

    One ends before the next header, or before the first blank line at least
    two lines on that is neither the last line nor followed by $$, or after
    FORMAL_REACH lines.
    """

    def end_of(i: Column) -> Column:
        """i: the object's line from 1, so places after it (from 0) begin at i."""
        stop = F.least(i + FORMAL_REACH, F.size(lines))
        ahead = F.when(stop > i, F.sequence(i, F.greatest(stop - 1, i))).otherwise(F.array().cast("array<int>"))
        line = lambda j: F.element_at(lines, j + 1)
        ends = F.filter(ahead, lambda j: X.is_header(line(j)) | (
            X.blank(line(j)) & (j > i + 1) & (j + 1 < F.size(lines)) & ~X.starts_display(F.coalesce(F.try_element_at(lines, j + 2), F.lit("")))))
        return F.coalesce(F.array_min(ends), F.greatest(stop, i))

    found = _numbers(lines, lambda x: F.regexp_like(x, F.lit(FORMAL)) & ~X.is_header(x))
    kind, number = (lambda x, g=g: F.regexp_extract(x, FORMAL, g) for g in (1, 2))
    return F.transform(found, lambda i: F.struct(
        F.concat(kind(F.element_at(lines, i)), F.lit(" "), number(F.element_at(lines, i))).alias("concept"), i.alias("start_line"),
        end_of(i).alias("end_line"), F.lower(kind(F.element_at(lines, i))).alias("entry_type"),
    ))


def term_entries(lines: Column, terms: list[str], known: Column) -> Column:
    """The first line of each key term with a few lines around it, unless a concept of that name is ``known`` (lower case).

    The terms are a project's settings, so their number is bounded.
    """
    none = F.array().cast("array<struct<concept:string,start_line:int,end_line:int,entry_type:string>>")
    out = none
    for term in dict.fromkeys(terms):
        low = F.lit(term.lower())
        first = F.array_min(_numbers(lines, lambda x: F.contains(F.lower(x), low)))  # noqa: B023  used at once
        entry = F.struct(F.lit(term).alias("concept"), F.greatest(first - 2, F.lit(1)).alias("start_line"), F.least(first + 10, F.size(lines)).alias("end_line"), F.lit("term").alias("entry_type"))
        taken = F.array_contains(known, term.lower()) | F.exists(out, lambda e: F.lower(e["concept"]) == low)  # noqa: B023
        out = F.when(first.isNotNull() & ~taken, F.concat(out, F.array(entry))).otherwise(out)
    return out


def with_terms(entries: Column, lines: Column, terms: list[str]) -> Column:
    if not terms:
        return entries
    return X.let(entries, lambda e: F.concat(e, term_entries(lines, terms, F.transform(e, lambda x: F.lower(x["concept"])))))


def markdown_entries(files: DataFrame, terms: list[str] | None = None) -> DataFrame:
    """Pointer-index entries of Markdown ``files``."""
    lines = files.select("source_path", "file_name", X.file_lines(F.col("content")).alias("_lines"))
    both = F.concat(section_entries(F.col("_lines")), formal_entries(F.col("_lines")))
    rows = lines.select("source_path", "file_name", F.explode(with_terms(both, F.col("_lines"), terms or [])).alias("e"))
    return rows.select("e.concept", "file_name", F.col("source_path").alias("file_path"), "e.start_line", "e.end_line", "e.entry_type")
