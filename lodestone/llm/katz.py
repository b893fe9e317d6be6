"""Operator 9: Katz backoff language model of trigrams, its tables partitioned by the middle word.

P(w | u v) is a Good-Turing discounted trigram where (u, v, w) was seen in
training, else alpha(u, v) * P(w | v); P(w | v) is a discounted bigram or else
alpha(v) * P(w); P(w) is a discounted unigram whose left-over mass is the
probability of an unseen word. Every alpha normalises exactly. Histories are
whole words (64-bit hashes, which the word tables give dense numbers).

1. A block of texts becomes a body (which of its words each token is) and its
   distinct words, dealt over word partitions. These add up counts, number the
   words and answer each block with the numbers and counts of its words.
2. Blocks send each token as (w, count of w, u, v, document) to the partition of
   v, the last word of its history. So trigrams (., v, .), bigrams (v, .) and all
   weights of histories that end in v meet in one partition, where each token is
   evaluated recursively without asking elsewhere.
3. A word v that stands often is salted by u over several partitions. These lack
   the counts of whole bigrams: those of salted words only are summed by (v, w)
   and given back, with the alpha of v.
4. Partitions give the sum of log10 P for each document they hold tokens of.

Dealt tokens are staged, and gathered one slice of the partitions after the other:
what is dealt goes with its slice, so disk never holds all of it twice.

Discounts need counts of counts, which partitions report before they evaluate.
Those (a few numbers for each order) are all that is sent to every worker.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import textnp
from lodestone.llm.common import drop_path, drop_staged, is_held_out, stage
from lodestone.llm.exchange import NO_ID, Sent, blocks, deal_for, dealt, pack, unpack

#: Counts up to CUT are discounted.
CUT = 5
#: A word is salted for every so many times that it stands in training.
SALT = 1 << 20
#: Bytes of text in a block; its tokens are held with some ten numbers each.
BLOCK = 5 << 20
#: Slices of the partitions, gathered one after the other.
SLICES = 4
#: Number of the start of a text; words have numbers from 1.
START = 0
#: Bits of a row's number for its place in a block.
PLACE = 20
U = textnp.U
END = textnp.mix(np.array([0x656E64], U))[0]
BODY, ASK, ANSWER, HISTOGRAM, TOKENS, HOT = range(6)
COLUMNS = "kind int, block long, part int, c0 binary, c1 binary, c2 binary, c3 binary, c4 binary, c5 binary, v array<long>"
DOC_ROWS = {"_row": "long", "_doc": "long", "held_out": "long", "n_tokens": "long", "n_known": "long", "base_score": "double"}


def route(columns: list[np.ndarray]) -> np.ndarray:
    """Key of a token (w, its count, u, v, salt, row): its last history word, and for a salted one u; after a start w."""
    w, _, u, v, salt, _ = columns
    side = np.where(v == START, w, u).astype(U)
    return textnp.combine(v, np.where(salt > 0, textnp.mix(side) & ((U(1) << salt.astype(U)) - U(1)), U(0)))


LAYOUT = Sent(6, DOC_ROWS, key=route)


def narrow(a: np.ndarray) -> np.ndarray:
    """Numbers or counts in 32 bits, where these hold all of them."""
    return a.astype(np.uint32) if not len(a) or int(a.max()) < 1 << 32 else a


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    """Rows of (kind, block, part, packed columns, v)."""
    full = [(k, b, p, *c, *[None] * (6 - len(c)), v) for k, b, p, c, v in rows]
    kinds = [pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 6, pa.list_(pa.int64())]
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*full), kinds)], [x.split()[0] for x in COLUMNS.split(", ")])


def tokens(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes with an end token after each text, and tokens of each text."""
    buf, bounds = textnp.joined(texts)
    at, h = textnp.words(buf)
    doc = np.searchsorted(bounds, at, "right") - 1
    sizes = np.bincount(doc, minlength=len(texts)) + 1
    word = np.full(int(sizes.sum()), END, U)
    word[np.arange(len(h)) + doc] = h
    return word, sizes


def tokenised(docs: DataFrame, held_out, parts: int) -> DataFrame:
    """Rows BODY and ASK of all blocks."""

    def send(batches):
        first = TaskContext.get().partitionId() << 24
        for n, rows in enumerate(blocks(batches, BLOCK)):
            found = [tokens([r[2] for r in rows[lo:hi]]) for lo, hi in textnp.groups([len(r[2] or b"") for r in rows], 1 << 21)]
            word, sizes = (np.concatenate(x) for x in zip(*found))
            train = ~np.array([r[3] for r in rows], bool)
            known, index = np.unique(word, return_inverse=True)
            counts = np.bincount(index[np.repeat(train, sizes)], minlength=len(known))
            ids = np.array([r[0] for r in rows], np.int64)
            yield _batch([(BODY, first + n, -1, [pack(index.astype(np.uint32)), pack(sizes), pack(ids), pack(train.astype(np.uint8))], None)])
            part = ((known >> U(32)) * U(parts) >> U(32)).astype(np.int64)  # sorted as the words are
            used, at = np.unique(part, return_index=True)
            cut = np.append(at, len(known))
            yield _batch([(ASK, first + n, int(p), [pack(known[a:b]), pack(counts[a:b])], None) for p, a, b in zip(used, cut[:-1], cut[1:])])

    rows = docs.select(F.coalesce(F.col("doc_id"), F.lit(NO_ID)).cast("long"), F.xxhash64("text"), F.col("text"), held_out)
    return rows.mapInArrow(send, COLUMNS)


def _few(counts: np.ndarray) -> list[int]:
    """How many counts are 1, 2, ..., CUT + 1."""
    return np.bincount(counts[counts <= CUT + 1], minlength=CUT + 2)[1:].tolist()


def count_words(asks: DataFrame, parts: int) -> DataFrame:
    """Rows ANSWER and HISTOGRAM of all word partitions."""

    def meet(table):
        part, names = table.column("part")[0].as_py(), table.column("block").to_pylist()
        words, counts = ([unpack(x.as_buffer()) for x in table.column(f"c{i}")] for i in (0, 1))
        ends = np.cumsum([len(x) for x in words])[:-1]
        known, index = np.unique(np.concatenate(words), return_inverse=True)
        total = np.zeros(len(known), np.int64)
        np.add.at(total, index, np.concatenate(counts))
        number = np.empty(len(known), U)
        number[np.argsort(-total, kind="stable")] = np.arange(len(known), dtype=U) * U(parts) + U(part + 1)
        rows = [(ANSWER, b, part, [pack(number[i]), pack(total[i])], None) for b, i in zip(names, np.split(index, ends))]
        rows.append((HISTOGRAM, None, part, [], [int(total.sum()), int((total > 0).sum()), *_few(total)]))
        return pa.Table.from_batches([_batch(rows)])

    return asks.groupBy("part").applyInArrow(meet, COLUMNS)


def discounts(n: np.ndarray) -> np.ndarray:
    """Katz's Good-Turing factors for counts 0 to CUT + 1 from n_1 to n_(CUT+1).

    Where the counts of counts don't give factors between 0 and 1 (small or odd
    corpora), 0.5 is taken from every count up to CUT.
    """
    r = np.arange(1, CUT + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        common = (CUT + 1) * n[CUT] / n[0]
        d = ((r + 1) * n[1:] / (r * n[:-1]) - common) / (1 - common)
    if not (np.isfinite(d).all() and (d > 0).all() and (d < 1).all()):
        d = 1 - 0.5 / r
    return np.concatenate([[0.0], d, [1.0]])


@dataclass
class Unigrams:
    """Discounted probabilities of words; a few numbers."""

    total: int
    words: int
    factors: np.ndarray
    whole: float
    unseen: float

    @classmethod
    def of(cls, total: int, words: int, n: np.ndarray) -> Unigrams:
        d = discounts(n)
        lost = float(((1 - d[1:-1]) * np.arange(1, CUT + 1) * n[:CUT]).sum())
        if lost > 0:
            return cls(total, words, d, float(total), lost / total)
        # no count small enough to discount: one more count is set aside for unseen words
        return cls(total, words, np.concatenate([[0.0], np.ones(CUT + 1)]), float(total + 1), 1 / (total + 1))

    def p(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, self.factors[np.minimum(counts, CUT + 1)] * counts / self.whole, self.unseen)

    def log_base(self, counts: np.ndarray) -> np.ndarray:
        """log10 of the add-one unigram probability."""
        return np.log10((counts + 1.0) / (self.total + self.words + 1))


def weights(group: np.ndarray, groups: int, counts: np.ndarray, lower: np.ndarray, factors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(total, set aside, lower sum) of histories as an array of three rows, from their n-grams.

    ``group``: history of each n-gram; ``lower``: the lower order's probability of its word.
    """
    gone = (1 - factors[np.minimum(counts, CUT + 1)]) * counts
    return np.stack([np.bincount(group, x, groups) for x in (counts, gone, np.where(counts > 0, lower, 0.0))])


def alphas(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Denominator, whether nothing can be discounted, and backoff weight of histories."""
    total, gone, lower = sums
    plain = (total > 0) & (gone <= 1e-12)
    bottom = np.where(plain, total + 1, np.maximum(total, 1))
    beta = np.where(total == 0, 1.0, np.where(plain, 1.0, gone) / bottom)
    return bottom, plain, beta / np.maximum(1 - lower, 1e-300)


def probability(counts, lower, group, factors, bottom, plain, alpha) -> np.ndarray:
    """Of n-grams: discounted if seen, else backed off."""
    d = np.where(plain[group], 1.0, factors[np.minimum(counts, CUT + 1)])
    return np.where(counts > 0, d * counts / bottom[group], alpha[group] * lower)


def assembled(sent: DataFrame, words: DataFrame, unigrams, texts: int, parts: int) -> DataFrame:
    """Tokens of all blocks, dealt by ``route``, and documents' own figures (packed, part -1)."""

    def join(table):
        kinds, part, base = table.column("kind").to_numpy(), table.column("part").to_numpy(), unigrams.value
        col = lambda c, i: unpack(table.column(c)[int(i)].as_buffer())
        body = int(np.flatnonzero(kinds == BODY)[0])
        answers = sorted(np.flatnonzero(kinds == ANSWER), key=lambda i: part[i])
        number, total = (narrow(np.concatenate([col(c, i) for i in answers])) for c in ("c0", "c1"))
        index, sizes, ids, train = (col(f"c{i}", body) for i in range(4))
        starts = np.cumsum(sizes) - sizes
        # what depends on the word only is found for each word once
        known = np.add.reduceat((total > 0)[index], starts, dtype=np.int64)
        score = np.add.reduceat(base.log_base(total)[index], starts)
        salts = salt_bits(total)
        salt = np.zeros(len(index), np.uint8)
        salt[1:] = salts[index[:-1]]
        w, c = number[index], total[index]
        del index
        v, u = np.zeros_like(w), np.zeros_like(w)
        v[1:], u[2:] = w[:-1], w[:-2]
        v[starts], u[starts], salt[starts] = START, START, salt_bits(np.array([texts]))
        second = starts[sizes > 1] + 1
        u[second] = START
        number_of = (table.column("block")[0].as_py() << PLACE) + np.arange(len(ids))
        order = np.lexsort((u, v, w))
        out = [w, c, u, v, salt, np.repeat((number_of * 2 + train).astype(U), sizes)]
        del w, c, u, v, salt
        _reorder(out, order)
        del order
        made = [LAYOUT.rows([number_of, ids, 1 - train.astype(np.int64), sizes, known, score]), LAYOUT.split(out, parts)]
        return pa.Table.from_batches(made)

    body = sent.where(f"kind = {BODY}").select("kind", "block", "part", "c0", "c1", "c2", "c3")
    answers = words.where(f"kind = {ANSWER}").select("kind", "block", "part", "c0", "c1", "c2", "c3")
    return body.unionByName(answers).groupBy("block").applyInArrow(join, LAYOUT.schema)


def salt_bits(counts: np.ndarray) -> np.ndarray:
    """Over how many partitions words of these counts are salted, as bits."""
    return np.ceil(np.log2(np.maximum(counts / SALT, 1))).astype(np.uint8)


def _reorder(columns: list[np.ndarray], order: np.ndarray) -> None:
    """In this order, in place of the old columns, which are let go one by one."""
    for i in range(len(columns)):
        columns[i] = columns[i][order]


def _ties(*columns: np.ndarray) -> np.ndarray:
    """For sorted columns the number of each row's group."""
    new = np.zeros(len(columns[0]), bool)
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.cumsum(new, dtype=np.int32 if len(new) < 1 << 31 else np.int64)


def _firsts(group: np.ndarray) -> np.ndarray:
    new = np.ones(len(group), bool)
    new[1:] = group[1:] != group[:-1]
    return np.flatnonzero(new)


class Part:
    """Tokens of a partition, sorted by (v, u, w), and the groups in them.

    ``columns``: v, u, w, row, words, counts. They are taken out of the list, so that
    those of all tokens can be let go once their groups are known.
    """

    def __init__(self, columns: list[np.ndarray]):
        v, u, w, self.row, words, counts = columns
        columns.clear()
        self.tri = _ties(v, u, w)
        at = _firsts(self.tri)
        v, u, w = v[at], u[at], w[at]
        del at
        self.tri_count = np.bincount(self.tri[(self.row & U(1)).astype(bool)], minlength=len(v))
        self.history = _ties(v, u)
        self.starts = v == START
        del u
        order = np.lexsort((w, v))
        group = _ties(v[order], w[order])
        self.pair_of = np.empty_like(group)  # bigram of each trigram
        self.pair_of[order] = group
        first = order[_firsts(group)]
        del order, group
        self.pair_v, self.pair_w = v[first], w[first]
        self.pair_count = np.bincount(self.pair_of, self.tri_count, len(first)).astype(np.int64)
        self.last = _ties(self.pair_v)  # v of each bigram
        self.unigram = counts[np.searchsorted(words, self.pair_w)] if len(first) else np.zeros(0, np.int64)


def gathered(sent: DataFrame) -> DataFrame:
    """Rows TOKENS, HISTOGRAM and HOT of the partitions in ``sent``."""

    def meet(table):
        part = table.column("part")[0].as_py()
        w, c, u, v, salt, row = LAYOUT.gathered(table)
        words, at = np.unique(w, return_index=True)
        counts, salted = c[at], np.unique(v[salt > 0])
        del c, salt, at
        columns = [v, u, w, row]
        del v, u, w, row
        _reorder(columns, np.lexsort([columns[i] for i in (3, 2, 1, 0)]))
        columns += [words, counts]
        packed = [pack(x, 3) for x in columns]
        p = Part(columns)
        hot = np.isin(p.pair_v, salted)
        three = p.tri_count[~p.starts]  # after a start there is one history word only
        seen = [int(x) for x in (*_few(three[three > 0]), *_few(p.pair_count[(p.pair_count > 0) & ~hot]))]
        rows = [(TOKENS, None, part, packed, [int(hot.any())]), (HISTOGRAM, None, part, [], seen)]
        if hot.any():
            rows.append((HOT, None, part, [*map(pack, (p.pair_v[hot], p.pair_w[hot], p.pair_count[hot], p.unigram[hot]))], None))
        return pa.Table.from_batches([_batch(rows)])

    return sent.groupBy("part").applyInArrow(meet, COLUMNS)


def hot_pairs(found: DataFrame) -> DataFrame:
    """part, v, w, c (its own count), unigram: bigrams of salted words in each of their partitions."""

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                cols = [unpack(b.column(f"c{k}")[i].as_buffer()) for k in range(4)]
                yield pa.record_batch([pa.array(np.full(len(cols[0]), b.column("part")[i].as_py(), np.int32)), *[pa.array(x.astype(np.int64)) for x in cols]], ["part", "v", "w", "c", "unigram"])

    rows = found.where(f"kind = {HOT}").select("part", "c0", "c1", "c2", "c3")
    return rows.mapInArrow(run, "part int, v long, w long, c long, unigram long")


def histogram(found: DataFrame) -> np.ndarray:
    rows = found.where(f"kind = {HISTOGRAM}").select(F.posexplode("v")).groupBy("pos").agg(F.sum("col")).collect()
    out = np.zeros(2 * (CUT + 1) + 2, np.int64)
    for i, n in rows:
        out[i] = n
    return out


RESULT = "_doc long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_texts(docs: DataFrame, held_out=None) -> DataFrame:
    """Train on the rows of ``docs`` where ``held_out`` is false and score all rows.

    Defined cases: null and empty texts consist of the end token; repeated rows
    count each; without training rows every token is unseen, base_score and
    score are 0; null ids are kept as NO_ID; very long texts are a block of their own.
    """
    spark = docs.sparkSession
    held_out = is_held_out(F.col("doc_id"), 7, 2) if held_out is None else held_out
    deal = deal_for(docs, 8 << 20, 36)
    word_parts = min(4096, deal.parts[-1])
    sent = stage(tokenised(docs, held_out, word_parts), "lm-blocks", by="kind")
    words = stage(count_words(sent.where(f"kind = {ASK}"), word_parts), "lm-words")
    _drop_some(sent, "kind", ASK)  # the bodies are still needed
    n = histogram(words)
    one = Unigrams.of(int(n[0]), int(n[1]), n[2 : 3 + CUT].astype(float))
    texts = docs.where(~held_out).count()
    cells = assembled(sent, words, spark.sparkContext.broadcast(one), texts, deal.parts[0])
    own = F.when(F.col("part") < 0, F.lit(-1)).otherwise(F.col("part") % SLICES)
    cells = stage(cells.withColumn("slice", own), "lm-cells", by="slice")
    drop_staged(sent, words)
    slices = []
    for k in range(SLICES):
        some = cells.where(f"slice = {k}").drop("slice")
        slices.append(stage(gathered(dealt(some, LAYOUT, deal, lambda columns: ([np.zeros(0)] * 6, columns))), "lm-tokens"))
        _drop_some(cells, "slice", k)
    found = reduce(DataFrame.unionByName, slices)
    own_figures = cells.where("slice = -1").select(*LAYOUT.columns)
    out = stage(_scored(spark, found, own_figures, one), "lm-scores")
    drop_staged(found, cells)
    return out


def _drop_some(staged: DataFrame, by: str, value: int) -> None:
    """Delete the rows of one value of the column by which a table is staged; no later plan may read them."""
    for folder in {f.rpartition(f"/{by}=")[0] for f in staged.inputFiles()}:
        drop_path(staged.sparkSession, f"{folder}/{by}={value}")


def _scored(spark, found: DataFrame, own_figures: DataFrame, one: Unigrams) -> DataFrame:
    """``found``: what was gathered; ``own_figures``: packed DOC_ROWS."""
    n = histogram(found)
    n_three, n_two = n[: CUT + 1], n[CUT + 1 : 2 * (CUT + 1)].copy()
    hot = stage(hot_pairs(found), "lm-hot")
    totals = stage(hot.groupBy("v", "w").agg(F.sum("c").alias("c"), F.max("unigram").alias("unigram")), "lm-hot-totals")
    for c, k in totals.where(f"c between 1 and {CUT + 1}").groupBy("c").count().collect():
        n_two[c - 1] += k
    two, three = discounts(n_two.astype(float)), discounts(n_three.astype(float))
    # Sums of the salted words' histories, in the same terms as a partition's own.
    small = F.least("c", F.lit(CUT + 1)).cast("int")
    factor = F.element_at(F.array(*[F.lit(float(x)) for x in two]), small + 1)
    u_factor = F.element_at(F.array(*[F.lit(float(x)) for x in one.factors]), F.least("unigram", F.lit(CUT + 1)).cast("int") + 1)
    lower = F.when(F.col("c") > 0, F.when(F.col("unigram") > 0, u_factor * F.col("unigram") / F.lit(one.whole)).otherwise(F.lit(one.unseen))).otherwise(0.0)
    sums = totals.groupBy(F.col("v").alias("_v")).agg(F.sum("c").cast("double").alias("t"), F.sum((1 - factor) * F.col("c")).alias("g"), F.sum(lower).alias("l"))
    back = hot.select("part", "v", "w").join(totals.select(F.col("v").alias("_a"), F.col("w").alias("_b"), "c"), (F.col("v") == F.col("_a")) & (F.col("w") == F.col("_b")))
    back = back.join(sums, F.col("v") == F.col("_v")).select("part", "v", "w", "c", "t", "g", "l")

    def packed(table):
        cols = [table.column(x).to_numpy() for x in ("v", "w", "c", "t", "g", "l")]
        order = np.lexsort((cols[1], cols[0]))
        return pa.table([table.column("part").slice(0, 1), *[pa.array([pack(x[order])], pa.binary()) for x in cols]], ["_part", *[f"h{i}" for i in range(6)]])

    given = back.groupBy("part").applyInArrow(packed, "_part int, " + ", ".join(f"h{i} binary" for i in range(6)))
    model = spark.sparkContext.broadcast((one, two, three))

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                cols = [unpack(b.column(f"c{k}")[i].as_buffer()) for k in range(6)]
                know = [unpack(b.column(f"h{k}")[i].as_buffer()) for k in range(6)] if b.column("h0")[i].is_valid else None
                rows, score = evaluated(Part(cols), know, *model.value)
                yield pa.record_batch([pa.array(rows), pa.array(score)], ["_row", "score"])

    # Only partitions with salted words need what others know of these: the rest is evaluated where it lies.
    asked = found.where(f"kind = {TOKENS}").select("part", F.col("v")[0].alias("_hot"), *[f"c{i}" for i in range(6)])
    alone = asked.where("_hot = 0").drop("part", "_hot").withColumns({f"h{i}": F.lit(None).cast("binary") for i in range(6)})
    joined = asked.where("_hot = 1").join(given, F.col("part") == F.col("_part")).drop("part", "_hot", "_part")
    asked = alone.unionByName(joined)
    scores = asked.mapInArrow(run, "_row long, score double").groupBy(F.col("_row").alias("_r")).agg(F.sum("score").alias("score"))

    def unpacked(batches):
        for b in batches:
            for i in range(b.num_rows):
                yield from LAYOUT.table([unpack(b.column(f"c{k}")[i].as_buffer()) for k in range(6)]).to_batches()

    out = own_figures.mapInArrow(unpacked, LAYOUT.found).join(scores, F.col("_row") == F.col("_r"))
    total = F.lit(one.total).cast("long")
    return out.select("_doc", (F.col("held_out") == 1).alias("held_out"), "n_tokens", "n_known", total.alias("train_tokens"), "base_score", "score")


def evaluated(p: Part, know: list[np.ndarray] | None, one: Unigrams, two: np.ndarray, three: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the rows with tokens here, and their sums of log10 P: trigram, else bigram, else unigram."""
    p1 = one.p(p.unigram)
    count, groups = p.pair_count, int(p.last[-1]) + 1 if len(p.last) else 0
    sums = weights(p.last, groups, count, p1, two)
    if know is not None:  # bigrams of salted words: the counts and sums of all their partitions
        v, w, c, *rest = know
        wide = textnp.combine(v.astype(U), w.astype(U))
        order = np.argsort(wide)
        mine = textnp.combine(p.pair_v, p.pair_w)
        at = np.minimum(np.searchsorted(wide[order], mine), len(wide) - 1)
        hit = wide[order][at] == mine
        count = np.where(hit, c[order][at], count)
        for k, x in enumerate(rest):
            sums[k, p.last[hit]] = x[order][at[hit]]
    bottom, plain, alpha = alphas(sums)
    p2 = probability(count, p1, p.last, two, bottom, plain, alpha)[p.pair_of]
    histories = int(p.history[-1]) + 1 if len(p.history) else 0
    bottom, plain, alpha = alphas(weights(p.history, histories, p.tri_count, p2, three))
    p3 = probability(p.tri_count, p2, p.history, three, bottom, plain, alpha)
    log = np.log10(np.where(p.starts, p2, p3))
    tri, row = p.tri, (p.row >> U(1)).view(np.int64)
    del p, p2, p3
    order = np.argsort(row, kind="stable")
    row = row[order]
    at = _firsts(row)
    return row[at], np.add.reduceat(log[tri[order]], at) if len(at) else np.zeros(0)


def op9_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score_texts(docs).select(F.when(F.col("_doc") != NO_ID, F.col("_doc")).alias("doc_id"), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
