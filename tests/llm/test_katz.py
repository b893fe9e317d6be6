import math
import os
import zlib
from collections import Counter

import numpy as np
import pytest

from lodestone.llm import exchange, katz
from tests.llm.helpers import clashing, corpus, frame, lower, words


def is_held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2


def sequence(text):
    """(u, v, w) of every token; u is None after the start."""
    w = [*words(lower(text or "")), "</s>"]
    return list(zip([None, "<s>", *w][: len(w)], ["<s>", *w], w))


def factors(counts):
    n = Counter(counts.values())
    n1, nk = n[1], n[katz.CUT + 1]
    d = {}
    for r in range(1, katz.CUT + 1):
        try:
            c = (katz.CUT + 1) * nk / n1
            d[r] = ((r + 1) * n[r + 1] / (r * n[r]) - c) / (1 - c)
        except ZeroDivisionError:
            d[r] = math.nan
    if not all(0 < x < 1 for x in d.values()):
        d = {r: 1 - 0.5 / r for r in d}
    return d


class Plain:
    """The same model with dictionaries."""

    def __init__(self, rows):
        train = [sequence(t) for i, t in rows if not is_held(i)]
        self.one = Counter(w for s in train for _, _, w in s)
        self.total, self.words = sum(self.one.values()), len(self.one)
        two = Counter((v, w) for s in train for _, v, w in s)
        three = Counter(((u, v), w) for s in train for u, v, w in s if u is not None)
        self.d1 = factors(self.one)
        lost = sum((1 - self.d1[c]) * c for c in self.one.values() if c <= katz.CUT)
        self.whole = self.total if lost else self.total + 1
        self.d1 = self.d1 if lost else {}
        self.unseen = lost / self.total if lost else 1 / (self.total + 1) if self.total else 1.0
        self.levels = []
        for counts in (two, three):
            by = {}
            for (h, w), c in counts.items():
                by.setdefault(h, {})[w] = c
            self.levels.append((by, factors(counts)))

    def p1(self, w):
        c = self.one[w]
        return self.d1.get(c, 1) * c / self.whole if c else self.unseen

    def backed(self, level, h, w, lower):
        by, d = self.levels[level]
        seen = by.get(h, {})
        total = sum(seen.values())
        if not total:
            return lower(w)
        gone = sum((1 - d.get(c, 1)) * c for c in seen.values())
        plain = gone <= 1e-12
        bottom = total + 1 if plain else total
        if w in seen:
            return (1 if plain else d.get(seen[w], 1)) * seen[w] / bottom
        return (1 if plain else gone) / bottom / (1 - sum(map(lower, seen))) * lower(w)

    def p2(self, v, w):
        return self.backed(0, v, w, self.p1)

    def p(self, u, v, w):
        return self.p2(v, w) if u is None else self.backed(1, (u, v), w, lambda x: self.p2(v, x))


def compare(spark, rows):
    model, got = Plain(rows), katz.score_texts(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    want = []
    for i, t in rows:
        s = sequence(t)
        base = sum(math.log10((model.one[w] + 1) / (model.total + model.words + 1)) for *_, w in s)
        want.append((katz.NO_ID if i is None else i, is_held(i), len(s), sum(model.one[w] > 0 for *_, w in s), model.total, base, sum(math.log10(model.p(*x)) for x in s)))
    key = lambda r: (r[0], r[2], round(r[5], 6))
    for a, b in zip(sorted((tuple(r) for r in got), key=key), sorted(want, key=key)):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], abs=1e-6) and a[6] == pytest.approx(b[6], abs=1e-6)
    return model


def test_mixed_corpus_against_dictionaries(spark):
    model = compare(spark, corpus(n=100))
    vocab = list(model.one)
    histories = [*[(None, v) for v in list(model.levels[0][0])[:10]], *list(model.levels[1][0])[:25], ("no", "history")]
    for u, v in histories:  # every history's probabilities add up to one, the unseen word included
        assert sum(model.p(u, v, w) for w in [*vocab, "never seen word"]) == pytest.approx(1, abs=1e-9)


def test_salted_words_and_levels_of_the_exchange(spark, monkeypatch):
    rows = corpus(n=100) + [(500 + i, " ".join(f"the w{j % 7} the v{(i + j) % 11}" for j in range(40))) for i in range(12)]
    monkeypatch.setattr(katz, "SALT", 8)
    compare(spark, rows)
    monkeypatch.setattr(exchange, "FAN", 6)
    monkeypatch.setattr(exchange, "BLOCK", 4000)
    compare(spark, rows)


def test_dealt_tokens_are_gathered_in_slices(spark, monkeypatch):
    """Disk holds a slice of the dealt tokens twice and never all of them, and no token is left out."""
    rows, given, standing, real = corpus(n=100), [], [], katz.gathered

    def gathered(sent):
        given.append(sum(len(exchange.unpack(r["c0"])) for r in sent.where("part >= 0").select("c0").collect()))
        files = [f.removeprefix("file:") for f in sent.inputFiles()]
        standing.append({int(f.rpartition("/slice=")[2].split("/")[0]) for f in files if os.path.exists(f)})
        return real(sent)

    monkeypatch.setattr(katz, "gathered", gathered)
    katz.score_texts(frame(spark, rows)).collect()
    assert sum(given) == sum(len(sequence(t)) for _, t in rows)
    assert len(given) == katz.SLICES and max(given) < sum(given) / 2
    assert standing == [{-1, *range(k, katz.SLICES)} for k in range(katz.SLICES)]


def test_narrow_columns_go_where_wide_ones_go():
    rng = np.random.default_rng(3)
    wide = [rng.integers(0, 1 << 20, 500).astype(np.uint64), np.ones(500, np.int64), rng.integers(0, 50, 500).astype(np.uint64), rng.integers(0, 9, 500).astype(np.uint64), np.full(500, 2, np.uint8), np.arange(500, dtype=np.uint64)]
    small = [katz.narrow(x) if x.itemsize == 8 else x for x in wide]
    assert [x.dtype.itemsize for x in small] == [4, 4, 4, 4, 1, 4]
    assert (katz.route(small) == katz.route(wide)).all()
    for top, kind in ((2**32 - 1, np.uint32), (2**32, np.int64)):
        got = katz.narrow(np.array([1, top]))
        assert got.dtype == kind and got.tolist() == [1, top]
    assert katz.salt_bits(np.array([0, katz.SALT, katz.SALT + 1, 5 << 32])).tolist() == [0, 0, 1, 15]


def test_counts_above_32_bits(spark):
    pack = lambda x, t: exchange.pack(np.array(x, t))
    asks = spark.createDataFrame([(katz.ASK, b, 0, bytearray(pack([5, 9], np.uint64)), bytearray(pack([3_000_000_000, b], np.int64)), None, None, None, None, None) for b in (1, 2)], katz.COLUMNS)
    got = katz.count_words(asks, 1)
    assert katz.histogram(got)[0] == 6_000_000_003
    answer = got.where(f"kind = {katz.ANSWER}").first()
    assert exchange.unpack(answer["c1"]).tolist() == [6_000_000_000, 3]
    one = katz.Unigrams.of(6_000_000_003, 2, np.array([0, 0, 1.0, 0, 0, 0]))
    assert one.p(np.array([6_000_000_000]))[0] == pytest.approx(6_000_000_000 / one.whole)


def test_few_texts(spark):
    compare(spark, [(0, "a b a b"), (1, None), (2, ""), (3, "a c"), (None, "b a")])
    compare(spark, [(i, "the same words here") for i in range(30)])
    assert katz.score_texts(frame(spark, [])).count() == 0
    held = [i for i in range(60) if is_held(i)][:2]
    got = katz.score_texts(frame(spark, [(i, "a b") for i in held])).collect()
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 and r["score"] == 0 and r["base_score"] == 0 for r in got)


def test_order_and_columns_do_not_matter(spark):
    rows = corpus()
    a = sorted(map(str, katz.score_texts(frame(spark, rows)).drop("score", "base_score").collect()))
    b = sorted(map(str, katz.score_texts(clashing(frame(spark, rows[::-1])).repartition(5)).drop("score", "base_score").collect()))
    assert a == b


def test_better_than_base_on_held_out(spark):
    got = katz.op9_query(spark, "/root/testdata/sf0.01").where("held_out").toPandas()
    assert got["score"].sum() > got["base_score"].sum() and (got["score"] <= 0).all()
