"""Operator 6: MinHash near-dedup by tensored banding.

A document's minhashes form two small collections of bundles, A and B. The key
of table (i, j) combines bundle A_i with bundle B_j, so SIDE * SIDE tables need
2 * SIDE bundles instead of SIDE * SIDE: the minhash work falls to about its
square root. Two documents of Jaccard similarity s miss each other in all tables
with a chance under 2 * (1 - s^ROWS)^SIDE, 4e-4 at s = 0.8 and 2e-5 at s = 0.85.

1. Documents with equal shingle sets form a class and go on as one.
2. Bundles that one class alone has lead nowhere: only combinations of shared
   bundles become table rows.
3. Members of a bucket (a table key that several classes have) are compared with
   a leader: in some buckets with the member that meets or is linked with most
   others (an original is, whose copies are alike to it alone), in others with
   the first in one of ORDERS random orders. A class asks at most ASKED leaders
   in a turn. That joins nearly all that belongs together; turns end when few
   of the asked are linked.
4. Then every pair that shares a bucket and whose ends are still in different
   components is compared, so no link depends on a leader. One side of such a
   pair is outside its bucket's largest component, and the pair is taken up in
   the first bucket that it shares only.

Inside that join pairs are dropped whose sizes are too far apart, whose odd
sketches differ in more bits than their sets may differ in shingles (a bound
without errors), or whose minhashes agree too seldom (of texts at 0.8 one in
three million); all others are confirmed on full sets. Every step is a keyed aggregate or an inner join on the
bucket, so crowded buckets are pre-aggregated and their joins split by Spark.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm import textnp
from lodestone.llm.common import boxed, drop_staged, fields_of, stage
from lodestone.llm.exchange import NO_ID, ids_repeat, keyed_texts

SHINGLE, PERCENT = 5, 80
#: Bundles in each collection and minhashes in each bundle.
SIDE, ROWS = 12, 3
HASHES = 2 * SIDE * ROWS
#: Longs that hold four bits of every minhash, and how many of these have to agree: 59 +- 3.3 are expected at 0.8.
SIGNATURE, AGREE = -(-HASHES // 16), 42
#: Orders by which buckets choose their leaders; leaders that a class asks in a turn; share of links among the asked below which turns end.
ORDERS, ASKED, WORTH = 8, 8, 0.1
U = textnp.U
SEEDS = (textnp.mix(np.arange(1, HASHES + 1, dtype=U) * textnp.MUL) >> U(32)).astype(np.uint32) | np.uint32(1)
PACKED = [f"p{i}" for i in range(SIDE)]
SIGNS = [f"g{i}" for i in range(SIGNATURE)]
#: Longs of a set's odd sketch: each shingle flips one of their bits.
SKETCH = [f"o{i}" for i in range(8)]


def shingle_sets(texts: list[bytes | None], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Document number and hash of every distinct shingle, sorted; a shorter text with words is one shingle."""
    buf, bounds = textnp.joined(texts)
    at, h = textnp.words(buf)
    doc = np.searchsorted(bounds, at, "right") - 1
    n = np.bincount(doc, minlength=len(texts))
    m = len(h) - k + 1
    if m > 0:
        i = np.flatnonzero(doc[:m] == doc[k - 1 :])
        found = textnp.combine(*[h[i + j] for j in range(k)])
        d = doc[i]
    else:
        found, d = np.zeros(0, U), np.zeros(0, np.int64)
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        first = np.searchsorted(doc, short)
        one = np.concatenate([textnp.combine(*h[a : a + n[s], None]) for s, a in zip(short, first)])
        found, d = np.concatenate([found, one]), np.concatenate([d, short])
    order = np.lexsort((found, d))
    found, d = found[order], d[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (d[1:] != d[:-1])
    return d[new], found[new]


def minhashes(d: np.ndarray, x: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents that have shingles, and their minhashes."""
    has = np.flatnonzero(np.bincount(d, minlength=docs))
    starts = np.searchsorted(d, has)
    out = np.empty((len(has), HASHES), np.uint32)
    x = (x >> U(32)).astype(np.uint32)
    for r in range(HASHES if len(has) else 0):
        out[:, r] = np.minimum.reduceat(x * SEEDS[r], starts)
    return has, out


def signatures(low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bundles (A_i above B_i in a long, for each i) and the four-bit signature of minhashes."""
    wide = low.astype(U)
    bundle = textnp.combine(*[wide[:, r::ROWS] for r in range(ROWS)]) >> U(32)
    packed = bundle[:, :SIDE] << U(32) | bundle[:, SIDE:]
    bits = np.zeros((len(low), SIGNATURE * 16), U)
    bits[:, :HASHES] = textnp.mix(wide + np.arange(HASHES, dtype=U)) >> U(60)
    signs = np.zeros((len(low), SIGNATURE), U)
    for k in range(16):
        signs |= bits[:, k::16] << U(4 * k)
    return packed, signs


def odd_sketches(d: np.ndarray, x: np.ndarray, docs: int) -> np.ndarray:
    """For each document 64 * len(SKETCH) bits: the parity of its shingles of each hash class."""
    width = 64 * len(SKETCH)
    place = d * width + (textnp.mix(x ^ U(9)) >> U(32)).astype(np.int64) % width
    bits = (np.bincount(place, minlength=docs * width) & 1).astype(np.uint8)
    return np.packbits(bits).view(U).reshape(docs, len(SKETCH))


KEPT = [*PACKED, *SIGNS, *SKETCH]
FIGURES = ", ".join(f"{c} long" for c in ["id", "n", "s1", "s2", *KEPT])


def set_figures(docs: DataFrame, k: int) -> DataFrame:
    """For each row its id, number of shingles, set hash (s1, s2), bundles and signature."""

    def run(batches):
        for b in batches:
            ids, texts = b.column(0).to_numpy(), b.column(1).cast(pa.binary()).to_pylist()
            for lo, hi in textnp.groups([len(t or b"") for t in texts], 1 << 20):
                d, x = shingle_sets(texts[lo:hi], k)
                has, low = minhashes(d, x, hi - lo)
                out = np.zeros((hi - lo, 2 + len(KEPT)), U)
                if len(has):
                    starts = np.searchsorted(d, has)
                    s1, s2 = (textnp.mix(np.add.reduceat(textnp.mix(x ^ U(c)), starts)) for c in (3, 5))
                    out[has] = np.concatenate([s1[:, None], s2[:, None], *signatures(low), odd_sketches(d, x, hi - lo)[has]], 1)
                cols = [ids[lo:hi], np.bincount(d, minlength=hi - lo), *out.view(np.int64).T]
                yield pa.record_batch([pa.array(c, pa.int64()) for c in cols], ["id", "n", "s1", "s2", *KEPT])

    return keyed_texts(docs, False).select("_doc", "text").mapInArrow(run, FIGURES)


def full_sets(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """``id, words_set``: full shingle sets of the documents in ``ids``."""
    rows = keyed_texts(docs, False).join(ids.select(F.col("id").alias("_id")), F.col("_doc") == F.col("_id"), "left_semi").select("_doc", "text")

    def run(batches):
        for b in batches:
            ids, texts = b.column(0).to_numpy(), b.column(1).cast(pa.binary()).to_pylist()
            for lo, hi in textnp.groups([len(t or b"") for t in texts], 1 << 20):
                d, x = shingle_sets(texts[lo:hi], k)
                has = np.unique(d)
                cut = np.searchsorted(d, np.append(has, hi - lo))
                sets = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(x.view(np.int64)))
                yield pa.record_batch([pa.array(ids[lo:hi][has], pa.int64()), sets], ["id", "words_set"])

    return rows.mapInArrow(run, "id long, words_set array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets have the similarity."""
    left = sets.select(F.col("id").alias("a"), F.col("words_set").alias("_x"))
    right = sets.select(F.col("id").alias("b"), F.col("words_set").alias("_y"))
    n, m = F.size("_x"), F.size("_y")
    inter = F.size(F.array_intersect("_x", "_y"))
    sized = pairs.join(left, "a").join(right, "b").where((100 * n >= percent * m) & (100 * m >= percent * n))
    return sized.where(100 * inter >= percent * (n + m - inter)).select("a", "b")


def classes_of(figures: DataFrame) -> DataFrame:
    """A row for each distinct set: s1, s2, the smallest id that has it, its size, bundles and signature."""
    same = [F.first(c).alias(c) for c in ["n", *KEPT]]
    return figures.where("n > 0").groupBy("s1", "s2").agg(F.min("id").alias("id"), *same)


def table_rows(classes: DataFrame) -> DataFrame:
    """``ka, kb, id, s1``: a row for each table in which a class shares both bundles with others.

    A key is a bundle under its number (A before B), so (ka, kb) names the table and the bucket.
    """
    half = [[F.shiftrightunsigned(c, 32) for c in PACKED], [F.col(c).bitwiseAND(F.lit(0xFFFFFFFF)) for c in PACKED]]
    keys = [F.lit((side * SIDE + i) << 32).bitwiseOR(v) for side in (0, 1) for i, v in enumerate(half[side])]
    rows = classes.select("id", "s1", F.explode(F.array(*keys)).alias("k"))
    shared = rows.groupBy("k").agg(F.count("*").alias("_c")).where("_c > 1").select(F.col("k").alias("_k"))
    held = rows.join(shared, F.col("k") == F.col("_k"), "left_semi").groupBy("id", "s1").agg(F.collect_list("k").alias("_all"))
    middle = F.lit(SIDE << 32)
    a = held.select("id", "s1", "_all", F.explode(F.filter("_all", lambda k: k < middle)).alias("ka"))
    return a.select("ka", F.explode(F.filter("_all", lambda k: k >= middle)).alias("kb"), "id", "s1")


def led_pairs(members: DataFrame, turn: int = 0) -> DataFrame:
    """Pairs (a, b) of members of a bucket with its leader, if they are of another component (``root``).

    A bucket's leader is its member of the largest ``rank``, or the first in a
    random order that the bucket's key names. Of its leaders a member is compared
    with the ASKED that it meets most often.
    """
    order = F.pmod(F.xxhash64(F.lit(turn), "ka", "kb"), F.lit(ORDERS))
    turned = F.when(order == 0, F.col("rank")).otherwise(F.xxhash64(order, F.lit(turn), "id"))
    leader = F.max(F.struct(turned.alias("by"), F.col("id").alias("lead"), F.col("root").alias("lead_root")))
    led = members.groupBy("ka", "kb").agg(F.min("root").alias("_lo"), F.max("root").alias("_hi"), leader.alias("_l")).where("_lo < _hi")
    led = led.select(F.col("ka").alias("_ka"), F.col("kb").alias("_kb"), "_l.lead", "_l.lead_root")
    met = members.join(led, (F.col("ka") == F.col("_ka")) & (F.col("kb") == F.col("_kb"))).where("root <> lead_root")
    met = met.groupBy("id", "lead").agg(F.count("*").alias("times"))
    best = met.groupBy("id").agg(F.slice(F.sort_array(F.collect_list(F.struct("times", "lead")), False), 1, ASKED).alias("_l"))
    return best.select("id", F.explode("_l.lead").alias("_b")).select(F.greatest("id", "_b").alias("a"), F.least("id", "_b").alias("b")).distinct()


def mixed_members(tables: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows of ``tables`` in buckets that hold several components, with their ``root``."""
    rooted = tables.join(roots.select(F.col("id").alias("_r"), "root"), F.col("id") == F.col("_r"), "left").select(*tables.columns, F.coalesce("root", "id").alias("root"))
    mixed = rooted.groupBy("ka", "kb").agg(F.min("root").alias("_lo"), F.max("root").alias("_hi")).where("_lo < _hi").select(F.col("ka").alias("_ka"), F.col("kb").alias("_kb"))
    return rooted.join(mixed, (F.col("ka") == F.col("_ka")) & (F.col("kb") == F.col("_kb")), "left_semi")


def agreement(left: list[str], right: list[str]) -> Column:
    """How many four-bit fields of two signatures are equal."""

    def unlike(x: Column) -> Column:
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        return F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))

    return F.lit(HASHES) - reduce(lambda a, b: a + b, [unlike(F.col(a).bitwiseXOR(F.col(b))) for a, b in zip(left, right)])


def differing(left: list[str], right: list[str]) -> Column:
    """Bits in which two odd sketches differ: no more than the shingles that one set alone has."""
    return reduce(lambda a, b: a + b, [F.bit_count(F.col(a).bitwiseXOR(F.col(b))) for a, b in zip(left, right)])


def first_shared(side: int) -> Column:
    """Number of the first bundle of a collection that both rows have."""
    out = F.lit(None).cast("int")
    for i in reversed(range(SIDE)):
        x = F.col(PACKED[i]).bitwiseXOR(F.col(f"_{PACKED[i]}"))
        out = F.when((F.shiftrightunsigned(x, 32) if side == 0 else x.bitwiseAND(F.lit(0xFFFFFFFF))) == 0, F.lit(i)).otherwise(out)
    return out


def unlinked_pairs(mixed: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """All pairs (a, b) that share a bucket, are of different components and may be alike.

    ``mixed`` has ka, kb, id, s1 and root of the members of buckets with several components.
    """
    by_root = mixed.groupBy("ka", "kb", "root").agg(F.count("*").alias("_c"))
    big = by_root.groupBy(F.col("ka").alias("_ka"), F.col("kb").alias("_kb")).agg(F.max(F.struct("_c", "root"))["root"].alias("big"))
    own = mixed.join(classes.select(F.col("id").alias("_i"), F.col("s1").alias("_s"), "n", *KEPT), (F.col("id") == F.col("_i")) & (F.col("s1") == F.col("_s")))
    own = own.join(big, (F.col("ka") == F.col("_ka")) & (F.col("kb") == F.col("_kb"))).select("ka", "kb", "id", "root", "big", "n", *KEPT)
    own = stage(own, "near-own")
    other = own.drop("big").select(*[F.col(c).alias(f"_{c}") for c in own.columns if c != "big"])
    near = (
        (F.col("ka") == F.col("_ka")) & (F.col("kb") == F.col("_kb")) & (F.col("root") != F.col("_root"))
        & ((F.col("_root") == F.col("big")) | (F.col("id") > F.col("_id")))
        & (100 * F.col("n") >= percent * F.col("_n")) & (100 * F.col("_n") >= percent * F.col("n"))
        & ((100 + percent) * differing(SKETCH, [f"_{c}" for c in SKETCH]) <= (100 - percent) * (F.col("n") + F.col("_n")))
        & (agreement(SIGNS, [f"_{c}" for c in SIGNS]) >= AGREE)
        & (first_shared(0) == F.shiftrightunsigned("ka", 32).cast("int")) & (first_shared(1) == F.shiftrightunsigned("kb", 32).cast("int") - SIDE)
    )
    met = own.where("root <> big").join(other, near)
    return met.select(F.greatest("id", "_id").alias("a"), F.least("id", "_id").alias("b")).distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31)))).first())


def components(links: DataFrame) -> DataFrame:
    """``id, root`` for every linked node: the smallest id of its component.

    Large-star: a node's larger neighbours go to its smallest neighbour;
    small-star: its smaller ones do. Both keep components; in a few rounds
    every node points at its root. Rounds are written to the shared folder.
    """
    edges = stage(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    mark = _mark(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("_m")).select(F.col("u").alias("_u"), F.least("u", "_m").alias("_m"))
        large = both.where("v > u").join(low, F.col("u") == F.col("_u")).select(F.col("v").alias("u"), F.col("_m").alias("v"))
        top = both.where("v < u").groupBy("u").agg(F.min("v").alias("_m")).where("_m is not null")
        large = stage(large.unionByName(top.select("u", F.col("_m").alias("v"))).where("u > v").distinct(), "cc-large")
        low = large.groupBy("u").agg(F.min("v").alias("_m")).select(F.col("u").alias("_u"), "_m")
        small = large.join(low, F.col("u") == F.col("_u")).select(F.col("v").alias("u"), F.col("_m").alias("v")).where("u > v")
        small = small.unionByName(low.select(F.col("_u").alias("u"), F.col("_m").alias("v")))
        new = stage(small.distinct(), "cc-small")
        drop_staged(large)
        drop_staged(edges)
        edges, old = new, mark
        mark = _mark(edges)
        if mark == old:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("root"))


def label_documents(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``_id, n_shingles, root`` for each row of ``docs``; root is the smallest id reachable by links.

    Defined cases: a text without words (or null) has no shingles and no links;
    rows of one id are one node, whatever their texts; null ids are one node
    below all others; repeated rows are members of one class.
    """
    figures = stage(set_figures(docs, k), "near-figures")
    classes = stage(classes_of(figures), "near-classes")
    every = stage(table_rows(classes), "near-tables")
    sizes = every.groupBy(F.col("ka").alias("_ka"), F.col("kb").alias("_kb")).agg(F.count("*").alias("_c")).where("_c > 1")
    tables = shared = stage(every.join(sizes, (F.col("ka") == F.col("_ka")) & (F.col("kb") == F.col("_kb"))).select("ka", "kb", "id", "s1", "_c"), "near-shared")
    drop_staged(every)
    met = tables.groupBy(F.col("id").alias("_n")).agg(F.sum("_c").alias("rank"))
    tables = tables.drop("_c")
    members = figures.where("n > 0").select("id", "n", "s1", "s2").join(classes.select(F.col("s1").alias("_s1"), F.col("s2").alias("_s2"), F.col("id").alias("c")), (F.col("s1") == F.col("_s1")) & (F.col("s2") == F.col("_s2"))).select("id", "n", "c")
    again = ids_repeat(docs)
    links = []
    if again:  # classes that share an id are linked by it
        low = members.groupBy(F.col("id").alias("_i")).agg(F.min("c").alias("b"), F.max("c").alias("_hi")).where("b < _hi")
        links.append(stage(members.join(low, F.col("id") == F.col("_i")).where("c <> b").select(F.col("c").alias("a"), "b").distinct(), "near-links"))
    sets = stage(full_sets(docs, tables.select("id").distinct(), k), "near-sets")
    roots, mixed, asked, turn = None, tables.withColumn("root", F.col("id")), None, 0
    if links:
        roots = components(links[0])
        mixed = stage(mixed_members(tables, roots), "near-mixed")
    while True:
        ranked = mixed.join(met, F.col("id") == F.col("_n"), "left").withColumn("rank", F.coalesce("rank", F.lit(0)))
        pairs = led_pairs(ranked, turn)
        pairs = stage(pairs if asked is None else pairs.join(asked, ["a", "b"], "left_anti"), "near-pairs")
        asked = pairs if asked is None else asked.unionByName(pairs)
        links.append(stage(confirmed(pairs, sets, percent), "near-links"))
        n, good = pairs.count(), links[-1].count()
        if good or roots is None:
            both = reduce(DataFrame.unionByName, links)
            roots = components(both)
            met = both.select(F.col("a").alias("_n")).unionByName(both.select(F.col("b").alias("_n"))).groupBy("_n").agg(F.count("*").alias("rank"))
            mixed = stage(mixed_members(tables, roots), "near-mixed")
            tables = mixed.drop("root")
        if good <= WORTH * n:
            break
        turn += 1

    rest = unlinked_pairs(mixed, classes, percent)
    rest = stage(rest.join(asked, ["a", "b"], "left_anti"), "near-rest")
    links.append(stage(confirmed(rest, sets, percent), "near-links"))
    if not links[-1].isEmpty():
        roots = components(reduce(DataFrame.unionByName, links))

    rooted = members.join(roots.select(F.col("id").alias("_r"), F.col("root")), F.col("c") == F.col("_r"), "left").select("id", "n", F.coalesce("root", "c").alias("root"))
    if again:
        by_id = rooted.groupBy(F.col("id").alias("_i")).agg(F.min("root").alias("root"))
        out = figures.join(by_id, F.col("id") == F.col("_i"), "left").select(F.col("id").alias("_id"), F.col("n").alias("n_shingles"), F.coalesce("root", "id").alias("root"))
    else:
        out = rooted.unionByName(figures.where("n = 0").select("id", "n", F.col("id").alias("root"))).toDF("_id", "n_shingles", "root")
    out = stage(out, "near-labels")
    drop_staged(figures, classes, shared, sets, asked, rest, mixed, roots, *links)
    return out


def near_dedup(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each near-duplicate component: that of the smallest id.

    Rows of one id are one document; of several the one with the smallest text
    hash stays. Only ids that repeat are sorted for that. Rows without an id are
    one document, too, below all others; null and empty texts are alike to nothing
    and stay; columns of any name are kept; no rows give no rows.
    """
    labels = label_documents(docs, k, percent).where("_id = root").groupBy("_id").agg(F.count("*").alias("_copies"))
    keyed = boxed(docs, _doc=F.coalesce(F.col("doc_id"), F.lit(NO_ID)).cast("long"), _th=F.xxhash64("text"))
    once = keyed.join(labels.where("_copies = 1"), F.col("_doc") == F.col("_id"), "left_semi")
    again = keyed.join(labels.where("_copies > 1"), F.col("_doc") == F.col("_id"), "left_semi")
    again = again.groupBy("_doc").agg(F.min_by("_row", "_th").alias("_row"))
    return once.select("_row").unionByName(again.select("_row")).select(*fields_of(docs.columns))


def op6_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = label_documents(docs, 4, 80)
    back = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return out.select(back("_id").alias("doc_id"), "n_shingles", back("root").alias("component_id"), (F.col("_id") == F.col("root")).alias("kept"))
