import zlib

from pyspark.sql import functions as F

from lodestone.llm import sharding
from tests.llm.helpers import clashing, corpus, frame


def brute(rows, n_shards):
    """rows: (id, size) with distinct ids; the middle of a record on the byte axis decides its shard."""
    total, at, out, slots = sum(s for _, s in rows), 0, {}, {}
    for i, size in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        at += size
        shard = min(n_shards - 1, int((at - size / 2) * n_shards / total))
        out[i] = (size, shard, slots.setdefault(shard, 0))
        slots[shard] += 1
    return out


def test_distinct_ids_against_brute_force(spark):
    rows = list({r[0]: r for r in corpus()}.values())
    got = sharding.shard_documents(frame(spark, rows), 7).collect()
    want = brute([(i, len((t or "").encode()) + 8) for i, t in rows], 7)
    assert {r["doc_id"]: (r["size"], r["shard"], r["slot"]) for r in got} == want


def test_repeated_rows_and_hot_key_stay_balanced(spark):
    rows = [(1, "same text")] * 400 + [(1, f"other {i}") for i in range(200)] + [(i, "x" * (i % 50)) for i in range(300)] + [(None, None)] * 100
    got = sharding.shard_documents(frame(spark, rows), 24).toPandas()
    assert len(got) == len(rows)
    by = got.groupby("shard")["size"].sum()
    assert len(by) == 24 and by.max() - by.min() <= 2 * got["size"].max()
    for _, slots in got.groupby("shard")["slot"]:
        assert sorted(slots) == list(range(len(slots)))


def test_overfull_ranges_are_subdivided(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PER_CUT", 1)
    rows = [(i, "y" * (3000 if i % 97 == 0 else 1)) for i in range(2000)]
    got = sharding.shard_documents(frame(spark, rows), 5).collect()
    want = brute([(i, len(t) + 8) for i, t in rows], 5)
    assert {r["doc_id"]: (r["size"], r["shard"], r["slot"]) for r in got} == want


def test_empty_one_row_and_clashing_columns(spark):
    empty = sharding.shard_documents(frame(spark, []))
    assert empty.count() == 0 and {"size", "shard", "slot"} <= set(empty.columns)
    assert sharding.shard_documents(frame(spark, [(None, None)])).select("shard", "slot").collect()[0]["slot"] == 0
    docs = clashing(frame(spark, corpus()))
    out = sharding.shard_documents(docs)
    kept = [c for c in docs.columns if c not in ("size", "shard", "slot")]
    assert out.count() == docs.count() and set(out.columns) == set(docs.columns)
    assert out.select(*kept).exceptAll(docs.select(*kept)).isEmpty()


def test_query_and_files(spark, sf_dir, tmp_path):
    out = sharding.op1_query(spark, sf_dir).cache()
    texts = {r[0]: r[1] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    got = out.collect()
    want = brute([(i, len(t.encode()) + 8) for i, t in texts.items()], 24)
    assert {r["doc_id"]: (r["size"], r["shard"], r["slot"]) for r in got} == want
    assert all(r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode()) and r["law"] == "bytes" and r["grown_shard"] is None for r in got)
    sharding.write_shards(sharding.shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")), str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == len(texts) and back.agg(F.countDistinct("shard")).first()[0] == 24
