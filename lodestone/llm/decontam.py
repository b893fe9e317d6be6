"""Operator 4: benchmark decontamination by template windows, native DataFrame operations only.

Texts become templates: numbers, names (capitalised words inside a sentence) and
units (unit words after a number) turn into typed placeholders, other words are
lower-cased and bare of outer punctuation. Windows of WINDOW template tokens are
hashed and joined with those of the benchmark. Matches are counted by document,
item and offset; where enough windows of an item stand at one offset, the values
in the slots are compared: a re-parameterised copy maps each value of the item
to one value of its own, and different values to different ones, but for a few
slots (SLACK); where nearly all slots are as in the item, it is a plain copy.

Items of fewer than WINDOW tokens, and items whose windows are all poor in words,
are looked for by their own forms instead: "What is 12 times 7?" is a leak as it
stands, but with other numbers it is not. Items of fewer than LEAST_ITEM tokens
("Yes") would match any text, so they are not looked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import boxed, fields_of, let, stage
from lodestone.llm.exchange import NO_ID

WINDOW = 8
#: A window of an item is looked for only if so many of its tokens are no placeholders.
LEAST_WORDS = 4
#: A match needs so many tokens in windows at one offset, or this share of the item's windows.
LEAST_TOKENS, LEAST_SHARE = 13, 0.6
#: Items with fewer tokens are not looked for.
LEAST_ITEM = 4
#: Share of the distinct slot pairs that may break the one-to-one rule; share of equal slots that makes a copy.
SLACK, SAME = 0.15, 0.8
#: Benchmark windows up to which they are broadcast (16 bytes each and some overhead); more are joined by shuffle.
BROADCAST_WINDOWS = 500_000
UNITS = (
    "%|percent|mm|cm|m|km|meter|meters|metre|metres|kilometers|miles|mile|inch|inches|feet|foot|ft|yards|mg|g|kg|gram|grams|kilograms|ton|tons|"
    "pound|pounds|lb|lbs|oz|ounces|ml|l|liter|liters|litre|litres|gallon|gallons|s|sec|second|seconds|min|minute|minutes|h|hour|hours|day|days|"
    "week|weeks|month|months|year|years|dollar|dollars|euro|euros|cent|cents|usd|eur|mph|kmh|degrees|degree|watts|kw|volts|hz|bytes|kb|mb|gb"
).split("|")
NUMBER, NAME, UNIT = "\u0002n", "\u0002p", "\u0002u"
START = "\u0001"
SPACE = r"\x20\x09-\x0D"


def raw_tokens(text: Column) -> Column:
    """Words without outer punctuation; the first of a sentence is marked by a leading START."""
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), rf'(^|[.!?]["\x27)\]]*[{SPACE}]+|[\n\r][{SPACE}]*)(?=[^{SPACE}])', f"$1{START}")
    bare = F.regexp_replace(marked, rf'[.,;:!?)\]}}"]+(?![^{SPACE}])|(?<![^{SPACE}{START}])["(\[{{]+', "")
    return F.filter(F.split(bare, f"[{SPACE}]+"), lambda w: (w != "") & (w != START))


def _core(w: Column) -> Column:
    return F.when(w.startswith(START), F.substring(w, 2, 1 << 30)).otherwise(w)


def _is_number(w: Column) -> Column:
    """A digit leads, perhaps after a sign or currency mark."""
    first = lambda i: (F.substring(w, i, 1) >= "0") & (F.substring(w, i, 1) <= "9")
    return F.when(w >= ":", F.substring(w, 1, 1).isin("€", "£") & first(2)).otherwise(first(1) | (F.substring(w, 1, 1).isin("$", "-", "+", ".") & first(2)))


def template(raw: Column) -> Column:
    """Template tokens of raw tokens, one for one."""

    def token(r: Column, w: Column, i: Column) -> Column:
        first = F.substring(w, 1, 1)
        capital = F.when((w < "[") | (w > "~"), (first != F.lower(first)) & ~w.startswith(START)).otherwise(F.lit(False))
        low = F.lower(_core(w))
        unit = low.isin(UNITS) & (i > 0)
        return (
            F.when(_is_number(_core(w)), F.lit(NUMBER))
            .when(capital, F.lit(NAME))
            .when(F.when(unit, _is_number(_core(F.element_at(r, F.greatest(i, F.lit(1)))))).otherwise(F.lit(False)), F.lit(UNIT))
            .otherwise(low)
        )

    return let(raw, lambda r: F.transform(r, lambda w, i: token(r, w, i)))


def _windows(hashes: Column, size: int, seed: int) -> Column:
    """(place, hash) of every window of ``size`` tokens; places from 0."""
    return let(hashes, lambda h: F.when(
        F.size(h) >= size,
        F.transform(F.sequence(F.lit(1), F.greatest(F.size(h) - size + 1, F.lit(1))), lambda i: F.struct((i - 1).alias("at"), F.xxhash64(F.lit(seed), F.lit(size), F.slice(h, i, size)).alias("hash"))),
    ).otherwise(F.array().cast("array<struct<at:int,hash:bigint>>")))


def _hashes(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.xxhash64(t))


def _placeholder(t: Column) -> Column:
    return t.startswith("\u0002")


#: Seeds of window hashes: of templates, and of the words' own forms.
TEMPLATE, OWN = 0, 1


def own_forms(raw: Column) -> Column:
    return F.transform(raw, lambda w: F.lower(_core(w)))


def item_windows(items: DataFrame) -> DataFrame:
    """``item_id, seed, size, n_windows, place, hash``: template windows of an item, or windows of its own forms where it has too few words for these."""
    base = items.select("item_id", raw_tokens(F.col("text")).alias("_raw")).where(F.size("_raw") >= LEAST_ITEM)
    base = base.withColumns({"_t": template(F.col("_raw")), "_o": own_forms(F.col("_raw"))}).withColumn("size", F.least(F.size("_t"), F.lit(WINDOW)))
    at = F.sequence(F.lit(1), F.size("_t") - F.col("size") + 1)
    rich = F.filter(at, lambda i: F.size(F.filter(F.slice("_t", i, F.col("size")), lambda t: ~_placeholder(t))) >= LEAST_WORDS)
    base = base.withColumn("_rich", F.when(F.size("_t") < WINDOW, F.array().cast("array<int>")).otherwise(rich))
    base = base.withColumn("seed", F.when(F.size("_rich") > 0, F.lit(TEMPLATE)).otherwise(F.lit(OWN)))
    base = base.withColumns({"_at": F.when(F.size("_rich") > 0, F.col("_rich")).otherwise(at), "_h": _hashes(F.when(F.size("_rich") > 0, F.col("_t")).otherwise(F.col("_o")))})
    rows = F.transform("_at", lambda i: F.struct((i - 1).alias("place"), F.xxhash64(F.col("seed"), F.col("size"), F.slice("_h", i, F.col("size"))).alias("hash")))
    return base.select("item_id", "seed", "size", F.size("_at").alias("n_windows"), F.explode(rows).alias("_r")).select("item_id", "seed", "size", "n_windows", "_r.place", "_r.hash")


def matches(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``_doc, _th, item_id, shift, matched, n_windows, size, lo, hi``: windows of an item found at one offset of a document.

    Texts are taken apart once, whatever the sizes of windows that are looked for.
    """
    wanted = stage(item_windows(items), "template-items")
    kinds = sorted((r[0], r[1]) for r in wanted.select("seed", "size").distinct().collect())  # at most 2 * WINDOW
    if not kinds:
        return docs.sparkSession.createDataFrame([], f"_doc long, _th long, item_id {dict(items.dtypes)['item_id']}, shift int, matched long, n_windows int, size int, lo int, hi int")
    small = wanted.count() <= BROADCAST_WINDOWS
    keyed = docs.select(F.coalesce(F.col("doc_id"), F.lit(NO_ID)).cast("long").alias("_doc"), F.xxhash64("text").alias("_th"), raw_tokens(F.col("text")).alias("_raw"))

    def windows(raw: Column) -> Column:
        hashes = {seed: _hashes(template(raw) if seed == TEMPLATE else own_forms(raw)) for seed, _ in kinds}
        return F.concat(*[let(h, lambda x: F.concat(*[_windows(x, size, seed) for s, size in kinds if s == seed])) for seed, h in hashes.items()])  # noqa: B023

    rows = keyed.select("_doc", "_th", F.explode(let(F.col("_raw"), windows)).alias("_w")).select("_doc", "_th", F.col("_w.at").alias("_at"), F.col("_w.hash").alias("hash"))
    found = rows.join(F.broadcast(wanted) if small else wanted, "hash").select("_doc", "_th", "item_id", "n_windows", "size", "place", (F.col("_at") - F.col("place")).alias("shift"))
    # Rows that repeat a document repeat its windows: places are counted once.
    got = found.groupBy("_doc", "_th", "item_id", "shift").agg(F.size(F.collect_set("place")).cast("long").alias("matched"), F.max("n_windows").alias("n_windows"), F.max("size").alias("size"), F.min("place").alias("lo"), F.max("place").alias("hi"))
    return got.where((F.col("matched") + F.col("size") - 1 >= LEAST_TOKENS) | (F.col("matched") >= LEAST_SHARE * F.col("n_windows")))


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``_doc, _th, item_id, n_windows, n_matched, n_slots, n_changed``: documents that hold an item, perhaps with other values.

    Of several offsets of an item in a document the one with most windows
    counts. Defined cases: null texts and items and items of under LEAST_ITEM
    tokens hold nothing; repeated rows of a
    document count once, items that repeat match alike; null ids are kept; very
    long texts are matched whole; an empty benchmark or corpus gives no rows.
    """
    found = stage(matches(docs, items), "template-matches")
    texts = items.select(F.col("item_id").alias("_item"), raw_tokens(F.col("text")).alias("_ri")).withColumn("_ti", template(F.col("_ri")))
    keyed = docs.select(F.coalesce(F.col("doc_id"), F.lit(NO_ID)).cast("long").alias("_d"), F.xxhash64("text").alias("_t"), F.col("text"))
    ids = found.select(F.col("_doc").alias("_d0"), F.col("_th").alias("_t0")).distinct()
    held = keyed.join(ids, (F.col("_d") == F.col("_d0")) & (F.col("_t") == F.col("_t0")), "left_semi").dropDuplicates(["_d", "_t"])
    held = stage(held.select("_d", "_t", raw_tokens(F.col("text")).alias("_rd")).withColumn("_td", template(F.col("_rd"))), "template-texts")
    both = found.join(held, (F.col("_doc") == F.col("_d")) & (F.col("_th") == F.col("_t"))).join(texts, F.col("item_id").eqNullSafe(F.col("_item")))
    places = F.sequence(F.col("lo") + 1, F.col("hi") + F.col("size"))
    slots = F.transform(
        F.filter(places, lambda i: _placeholder(F.element_at("_ti", i)) & (F.element_at("_ti", i) == F.try_element_at("_td", i + F.col("shift")))),
        lambda i: F.struct(F.lower(_core(F.element_at("_ri", i))).alias("a"), F.lower(_core(F.element_at("_rd", i + F.col("shift")))).alias("b")),
    )
    both = both.withColumn("_slots", slots)
    pairs = F.size(F.array_distinct("_slots"))
    sides = [F.size(F.array_distinct(F.col(f"_slots.{f}"))) for f in "ab"]
    one_to_one = 2 * pairs - sides[0] - sides[1] <= SLACK * pairs
    copied = F.size(F.filter("_slots", lambda s: s["a"] == s["b"])) >= SAME * F.size("_slots")
    good = both.where(one_to_one | copied)
    best = F.max(F.struct(F.col("matched").alias("n_matched"), F.col("n_windows"), F.size("_slots").alias("n_slots"), F.size(F.filter("_slots", lambda s: s["a"] != s["b"])).alias("n_changed"))).alias("_b")
    return good.groupBy("_doc", "_th", "item_id").agg(best).select("_doc", "_th", "item_id", "_b.*")


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item."""
    bad = leaks(docs, items).select(F.col("_doc").alias("_b"), F.col("_th").alias("_t")).distinct()
    keyed = boxed(docs, _doc=F.coalesce(F.col("doc_id"), F.lit(NO_ID)).cast("long"), _th=F.xxhash64("text"))
    kept = keyed.join(bad, (F.col("_doc") == F.col("_b")) & (F.col("_th") == F.col("_t")), "left_anti")
    return kept.select(*fields_of(docs.columns))


def op4_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    out = leaks(docs, items)
    return out.select(F.when(F.col("_doc") != NO_ID, F.col("_doc")).alias("doc_id"), "item_id", "n_windows", "n_matched", "n_slots", "n_changed")
