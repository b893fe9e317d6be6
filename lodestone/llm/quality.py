"""Operator 10: cross-document line frequency, native DataFrame operations only.

Lines are normalised (A-Z lower case, digits to 0, inner and outer white space
squeezed) and hashed; for every (host, line) the documents that carry it are
counted. Lines in more than the limit of their host's documents are boilerplate
and removed; a document that keeps too little of its words is rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import SPACES, beside_text, fields_of, let, n_words, stage

#: A line is removed when it is in more than LINE_DOCS documents of its host and in more than this share of them.
LINE_DOCS, LINE_SHARE = 10, 0.01
#: A document is depleted when under this share of its words, or fewer than 10 words, are left.
LEAST_LEFT, LEAST_WORDS = 0.5, 10
#: For the n-gram rule.
WINDOW, REPEAT_PERCENT = 5, 20
SYMBOLS = "#*$%&|<>"


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def repeat_words(hashes: Column, window: int = WINDOW) -> Column:
    """Words covered by windows that are found twice or more, from the array of window hashes.

    Documents with no repeated window stop at a set comparison. In the others
    the windows are sorted by (hash, place), so equal ones are neighbours; their
    places are sorted again and each adds its words up to the next.
    """

    def places(s: Column) -> Column:
        same = lambda a, b: F.element_at(s, a)["h"] == F.element_at(s, b)["h"]
        hit = F.filter(s, lambda x, i: F.when(i + 1 < F.size(s), same(i + 1, F.least(i + 2, F.size(s)))).otherwise(False) | F.when(i > 0, same(i + 1, F.greatest(i, F.lit(1)))).otherwise(False))
        return F.array_sort(F.transform(hit, lambda x: x["i"]))

    def covered(p: Column) -> Column:
        return F.aggregate(
            p, F.struct(F.lit(0).alias("n"), F.lit(-window).alias("last")),
            lambda a, x: F.struct((a["n"] + F.least(F.lit(window), x - a["last"])).alias("n"), x.alias("last")),
            lambda a: a["n"],
        )

    def found(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda v, i: F.struct(v.alias("h"), i.alias("i"))))
        return F.when(F.size(h) == F.size(F.array_distinct(h)), F.lit(0)).otherwise(let(pairs, lambda s: covered(places(s))))

    return let(hashes, found).cast("long")


def window_hashes(words: Column, window: int = WINDOW) -> Column:
    """Hashes of all windows of word hashes; none if there are fewer words."""
    return let(words, lambda w: F.when(
        F.size(w) >= window,
        F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (window - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, window))),
    ).otherwise(F.array().cast("array<bigint>")))


def normal_line(line: Column) -> Column:
    low = F.translate(line, "ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789", "abcdefghijklmnopqrstuvwxyz000000000")
    return F.regexp_replace(F.regexp_replace(low, r"[\x20\x09-\x0D]+", " "), "^ | $", "")


def text_figures(docs: DataFrame) -> DataFrame:
    """``docs`` plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and _lines (hash and words of each distinct line)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    word_lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(_without(x, SPACES)) > 0)
    base = docs.withColumns({"_words": F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w)), "_raw": word_lines})
    base = base.withColumn("_windows", window_hashes(F.col("_words")))
    lines = F.transform("_raw", lambda x: F.struct(F.xxhash64(normal_line(x)).alias("h"), n_words(x).cast("int").alias("w")))
    return base.select(
        *docs.columns,
        F.size("_words").cast("long").alias("n_words"),
        F.length(_without(text, SPACES)).cast("long").alias("word_chars"),
        (F.length(text) - F.length(_without(text, SYMBOLS))).cast("long").alias("n_symbols"),
        (F.size("_raw") - F.size(F.array_distinct("_raw"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("_windows")).alias("n_repeat_words"),
        lines.alias("_lines"),
    )


def frequent_lines(figures: DataFrame, host: str, least_docs: int, share: float) -> DataFrame:
    """(host, line hash) in over ``least_docs`` documents and over ``share`` of the host's documents."""
    counts = figures.select(F.col(host).alias("_host"), F.explode(F.array_distinct(F.transform("_lines", lambda x: x["h"]))).alias("_h"))
    counts = counts.groupBy("_host", "_h").agg(F.count("*").alias("_df")).where(F.col("_df") > least_docs)
    hosts = figures.groupBy(F.col(host).alias("_host2")).agg(F.count("*").alias("_docs"))
    both = counts.join(hosts, counts["_host"].eqNullSafe(hosts["_host2"]))
    return both.where(F.col("_df") > F.col("_docs") * share).select("_host", "_h", "_df")


def _figures(docs: DataFrame, host: str) -> DataFrame:
    return stage(text_figures(docs.select("doc_id", host, "text")).withColumn("_id", F.xxhash64("text")).drop("text"), "quality-figures")


def _verdicts(figures: DataFrame, often: DataFrame, host: str, least_left: float) -> DataFrame:
    lines = figures.select("doc_id", "_id", F.col(host).alias("_own"), F.explode("_lines").alias("_l"))
    hit = lines.join(often, lines["_own"].eqNullSafe(often["_host"]) & (lines["_l"]["h"] == often["_h"]))
    # Rows that repeat have equal lines: the mean over them is each row's own figure.
    hit = hit.groupBy(F.col("doc_id").alias("_d"), F.col("_id").alias("_t"), F.col("_own")).agg(F.sum("_l.w").alias("_gone"))
    copies = figures.groupBy(F.col("doc_id").alias("_d2"), F.col("_id").alias("_t2"), F.col(host).alias("_own2")).agg(F.count("*").alias("_copies"))
    hit = hit.join(copies, hit["_d"].eqNullSafe(copies["_d2"]) & (hit["_t"] == copies["_t2"]) & hit["_own"].eqNullSafe(copies["_own2"]))
    hit = hit.select("_d", "_t", "_own", (F.col("_gone") / F.col("_copies")).cast("long").alias("_gone"))
    out = figures.join(hit, figures["doc_id"].eqNullSafe(hit["_d"]) & (figures["_id"] == hit["_t"]) & figures[host].eqNullSafe(hit["_own"]), "left")
    gone = F.coalesce("_gone", F.lit(0))
    left = F.col("n_words") - gone
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    depleted = (gone > 0) & ((left < least_left * F.col("n_words")) | (left < LEAST_WORDS))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return out.select("doc_id", host, *names, gone.cast("long").alias("n_removed_words"), failed.alias("base_failed"), (~failed & ~depleted).alias("kept"), "_id")


def line_rules(docs: DataFrame, host: str = "source", least_docs: int = LINE_DOCS, share: float = LINE_SHARE, least_left: float = LEAST_LEFT) -> DataFrame:
    """Verdicts of the rules: columns doc_id and ``host``, the figures, n_removed_words, base_failed and kept.

    Each row of ``docs`` is a document, repeated rows too. Defined cases: a null
    text has no words and fails the base; null hosts form one host; the host's
    size is its number of rows; very long texts are handled whole; no rows give
    no rows. A document whose lines all stay keeps its words.
    """
    figures = _figures(docs, host)
    return _verdicts(figures, frequent_lines(figures, host, least_docs, share), host, least_left).drop("_id")


def clean_documents(docs: DataFrame, host: str = "source", least_docs: int = LINE_DOCS, share: float = LINE_SHARE) -> DataFrame:
    """``docs`` without their frequent lines, and without the documents that ``line_rules`` rejects.

    A host's frequent lines are one array: each stands in over ``share`` of the
    host's documents, so there are at most (mean lines of a document) / share.
    """
    figures = _figures(docs, host)
    often = stage(frequent_lines(figures, host, least_docs, share), "quality-often")
    verdict = _verdicts(figures, often, host, LEAST_LEFT).where("kept").select(F.col("doc_id").alias("_kd"), F.col("_id").alias("_kt"), F.col(host).alias("_kh"))
    keyed = beside_text(docs, _doc=F.col("doc_id"), _th=F.xxhash64("text"), _own=F.col(host))
    kept = keyed.join(verdict, F.col("_doc").eqNullSafe(F.col("_kd")) & (F.col("_th") == F.col("_kt")) & F.col("_own").eqNullSafe(F.col("_kh")), "left_semi")
    by_host = often.groupBy("_host").agg(F.collect_set("_h").alias("_often"))
    joined = kept.join(by_host, F.col("_own").eqNullSafe(F.col("_host")), "left")
    lines = F.filter(F.split("text", "\n", -1), lambda x: ~F.array_contains(F.coalesce("_often", F.array().cast("array<bigint>")), F.xxhash64(normal_line(x))))
    return joined.select(*fields_of(docs.columns, text=F.array_join(lines, "\n")))


def op10_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return line_rules(docs).drop("source")
