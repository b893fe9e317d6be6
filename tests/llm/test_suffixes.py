import hashlib

import numpy as np

from lodestone.llm import suffixes, textnp
from tests.llm.helpers import clashing, corpus, frame


def brute(rows, length=100):
    """(bytes, removed, runs, sha256) by (id, text); a row repeated with equal id and text is one document."""
    docs = sorted({(i is not None, i or 0, t or "") for i, t in rows}, key=lambda d: (d[0], d[1]))
    first, out = set(), {}
    for known, i, text in docs:
        b = text.encode()
        gone = np.zeros(len(b), bool)
        for at in range(len(b) - length + 1):
            w = b[at : at + length]
            if w in first:
                gone[at : at + length] = True
            first.add(w)
        runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()) if len(b) else 0
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out[i if known else None, text] = (len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
    return out


def held(spark, rows):
    got = suffixes.remove_repeats(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    return {(r["doc_id"], r["kept_sha256"]): (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got}


def compare(spark, rows):
    want = {(k[0], v[3]): v for k, v in brute(rows).items()}
    assert held(spark, rows) == want


def test_mixed_corpus_against_brute_force(spark):
    rows = corpus()
    null_ids = [r for r in rows if r[0] is None]
    compare(spark, [r for r in rows if r[0] is not None] + null_ids[:1])


def test_overlaps_periods_and_passages_cut_anywhere(spark):
    rng = np.random.default_rng(3)
    base = "".join(rng.choice(list("abcdefgh "), 900))
    rows = [(1, base), (2, "q" + base[100:420] + "w" + base[380:700]), (3, base[:99]), (4, base[:100]), (5, "z" * 260), (6, "y" * 30 + "z" * 120), (7, "ab" * 150), (8, base[50:149] + "é" + base[149:260]), (9, base[1:101] + base[2:102] + base[3:103])]
    compare(spark, rows)


def test_many_copies_over_blocks_and_segments(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "SEGMENT", 700)
    rng = np.random.default_rng(4)
    long = "".join(rng.choice(list("abcdef"), 5000))
    rows = [(i, long[i * 37 : i * 37 + 1200]) for i in range(40)] + [(100 + i, long) for i in range(5)]
    compare(spark, rows)


def test_colliding_hashes_are_settled_byte_by_byte():
    buf = np.frombuffer(b"aaaabbbb" * 40, np.uint8)
    text = suffixes.Suffixes(buf, np.zeros(len(buf) + 1, textnp.U))  # all hashes equal
    assert not text.same_bytes(np.array([0]), np.array([4]), np.array([100]))[0]
    assert text.same_bytes(np.array([0]), np.array([8]), np.array([100]))[0]


def test_merge_sort_orders_suffixes():
    rng = np.random.default_rng(5)
    buf = rng.integers(97, 99, 600).astype(np.uint8)
    text = suffixes.Suffixes(buf, textnp.prefix(textnp.BYTES[buf]))
    at = rng.permutation(500)
    order = text.merge_sort(at, np.full(500, 100), np.repeat(np.arange(5), 100))
    for g in range(5):
        some = at[order[g * 100 : g * 100 + 100]]
        keys = [bytes(buf[a : a + 100]) for a in some]
        assert keys == sorted(keys) and set(some) == set(at[g * 100 : g * 100 + 100])


def test_empty_table_clashing_columns_and_kept_text(spark):
    assert suffixes.remove_repeats(frame(spark, [])).count() == 0
    docs = clashing(frame(spark, corpus()))
    out = suffixes.remove_repeats(docs)
    same = [c for c in docs.columns if c not in ("text", "kept")]
    assert out.count() == docs.count() and out.select(*same).exceptAll(docs.select(*same)).isEmpty()
    r = suffixes.remove_repeats(frame(spark, [(1, "t" * 120), (2, "a" + "t" * 110 + "b")])).orderBy("doc_id").collect()
    assert bytes(r[0]["kept"]) == b"" or r[0]["n_removed"] > 0
    assert bytes(r[1]["kept"]) == b"ab"


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffixes.op5_query(spark, sf_dir).collect()}
    assert got == {k[0]: v for k, v in brute(rows).items()}


def test_levels_of_the_exchange_change_nothing(spark, monkeypatch):
    from lodestone.llm import exchange

    monkeypatch.setattr(exchange, "FAN", 4)
    monkeypatch.setattr(exchange, "BLOCK", 3000)
    rows = [r for r in corpus() if r[0] is not None]
    assert len(exchange.deal_for(frame(spark, rows)).parts) > 1
    compare(spark, rows)


def test_without_the_sort_repeats_are_lost(monkeypatch):
    """What is removed follows from neighbours in sorted order."""
    monkeypatch.setattr(suffixes.Suffixes, "merge_sort", lambda self, at, size, group: np.arange(len(at)))
    gram = "".join(np.random.default_rng(9).choice(list("abcdefgh "), 400))
    texts = [gram[:200] + x + gram[200:] for x in ("", "x" * 7, "", "x" * 7, "", "x" * 7)]
    names = np.arange(6)
    text = suffixes.Suffixes(*(lambda b: (b, textnp.prefix(textnp.BYTES[b])))(np.frombuffer("".join(t[150:320] for t in texts).encode(), np.uint8)))
    again, _ = suffixes.repeats(text, names * 170, np.full(6, 170), np.zeros(6, textnp.U), (names, names, names))
    assert not again.any()
    monkeypatch.undo()
    again, _ = suffixes.repeats(text, names * 170, np.full(6, 170), np.zeros(6, textnp.U), (names, names, names))
    assert again.tolist() == [False, False, True, True, True, True]
