import math
import zlib

import numpy as np
import xxhash
from pyspark.sql import functions as F

from lodestone.llm import textnp, toxicity
from tests.llm.helpers import clashing, corpus, frame


def auc(score, y):
    rank = np.argsort(np.argsort(score, kind="stable")) + 1
    pos = y == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def test_ftrl_step_by_step():
    a, b, l1, l2 = 0.3, 1.0, 0.5, 1.0
    model, z, n = toxicity.Ftrl(4, a, b, l1, l2), [0.0] * 4, [0.0] * 4
    rng = np.random.default_rng(1)
    for _ in range(50):
        active, y = np.append(rng.choice(3, 2, replace=False), 3), float(rng.integers(2))
        w = {}
        for i in active:
            lam = 0 if i == 3 else l1
            w[i] = 0.0 if abs(z[i]) <= lam else -(z[i] - np.sign(z[i]) * lam) / ((b + n[i] ** 0.5) / a + l2)
        p = 1 / (1 + np.exp(-sum(w.values())))
        for i in active:
            g = p - y
            sigma = ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / a
            z[i] += g - sigma * w[i]
            n[i] += g * g
        assert abs(model.learn(active, y) - p) < 1e-12
    assert np.allclose(model.z, z) and np.allclose(model.n, n)


def test_features_stay_inside_texts():
    doc, ids = toxicity.features([b"a b c d", None, b"", b"a", b"a b"])
    assert np.bincount(doc, minlength=5).tolist() == [4 + 3 + 2, 0, 0, 1, 2 + 1]
    assert set(ids[doc == 4]) <= set(ids[doc == 0])
    assert toxicity.features([b"One, two"])[1].tolist() == toxicity.features([b"one two!"])[1].tolist()


def test_learns_words_pairs_and_stays_sparse(spark):
    rng = np.random.default_rng(2)
    vocab = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(1200):
        w, bad = list(rng.choice(vocab, 30)), i % 4 == 0
        w[5] = "vile" if bad and i % 8 else "w1"
        if bad and i % 8 == 0:
            w[10:12] = ["w2", "w3"]
        rows.append((i, " ".join(w)))
        labels.append((i, 0, int(bad)))
    docs, lab = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    ids, w = toxicity.fit(docs, lab)
    assert 0 < len(ids) < 5000
    out = toxicity.score_documents(docs, (ids, w)).toPandas()
    held = np.array([zlib.crc32(str(i).encode()) % 4 == 2 for i in out["doc_id"]])
    y = (out["doc_id"] % 4 == 0).to_numpy().astype(int)
    assert auc(out["score"].to_numpy()[held], y[held]) > 0.7


def test_labels_of_held_out_rows_are_never_read(spark):
    rows = [(i, f"text number {i} good" if i % 2 else f"text number {i} bad") for i in range(400)]
    lab = [(i, 0, i % 2) for i in range(400)]
    flipped = [(i, 0, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, _, t in lab]
    schema = "doc_id long, quality int, toxic int"
    a, b = (toxicity.fit(frame(spark, rows), spark.createDataFrame(x, schema)) for x in (lab, flipped))
    assert (a[0] == b[0]).all() and (a[1] == b[1]).all()


def test_edge_cases(spark):
    schema = "doc_id long, quality int, toxic int"
    docs = clashing(frame(spark, corpus()))
    none = toxicity.fit(docs, spark.createDataFrame([], schema))
    out = toxicity.score_documents(docs, none)
    assert out.count() == docs.count() and out.where("score > 0.001").count() == 0
    some = toxicity.fit(docs, spark.createDataFrame([(None, 0, 1), (1, 0, None), (2, 0, 1), (2, 0, 0), (3, 0, 0)], schema))
    out = toxicity.score_documents(docs, some)
    assert out.where("score is null or score < 0 or score > 1").count() == 0
    assert toxicity.score_documents(frame(spark, []), some).count() == 0
    kept = toxicity.toxic_filter(docs, spark.createDataFrame([], schema))
    assert kept.columns == docs.columns and kept.count() == docs.count()
    lab = spark.createDataFrame([(i, 0, 0) for i in range(60)], schema)
    kept = toxicity.toxic_filter(docs, lab)
    assert kept.count() == docs.count() and kept.exceptAll(docs).isEmpty()


def plain_scores(rows, labels):
    """The query restated: dictionaries of hashed features, one example after the other."""
    def grams(text):
        w = textnp.words(np.frombuffer((text or "").encode() + b"\n", np.uint8), bare=True)[1]
        out = [int(x) for x in w]
        for gap in (1, 2):
            out += [int(textnp.combine(w[i : i + 1], w[i + gap : i + gap + 1] + textnp.U(gap))[0]) for i in range(len(w) - gap)]
        return {x >> (64 - toxicity.BITS) for x in out}

    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    z, n = {}, {}

    def weight(i):
        a = z.get(i, 0.0)
        lam = 0.0 if i == "bias" else toxicity.L1
        return 0.0 if abs(a) <= lam else -(a - math.copysign(lam, a)) / ((toxicity.BETA + n.get(i, 0.0) ** 0.5) / toxicity.ALPHA + toxicity.L2)

    features = {i: [*grams(t), "bias"] for i, t in rows}
    order = sorted((i for i in labels if not held(i) and i in features), key=lambda i: (xxhash.xxh64(i.to_bytes(8, "little"), 42).intdigest() + (1 << 63)) % (1 << 64))
    for _ in range(toxicity.EPOCHS):
        for i in order:
            w = {f: weight(f) for f in features[i]}
            g = 1 / (1 + math.exp(-max(-35, min(35, sum(w.values()))))) - labels[i]
            for f, v in w.items():
                sigma = ((n.get(f, 0.0) + g * g) ** 0.5 - n.get(f, 0.0) ** 0.5) / toxicity.ALPHA
                z[f], n[f] = z.get(f, 0.0) + g - sigma * v, n.get(f, 0.0) + g * g
    return {i: 1 / (1 + math.exp(-max(-35, min(35, sum(map(weight, fs)))))) for i, fs in features.items()}


def test_query_against_plain_scores(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    want = plain_scores(rows, labels)
    for r in toxicity.op8_query(spark, sf_dir).collect():
        assert abs(r["score"] - want[r["doc_id"]]) < 1e-4 and r["predicted"] == (r["score"] >= 0.3)


def test_query_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    out = toxicity.op8_query(spark, sf)
    lab = spark.read.parquet(f"{sf}/labels.parquet").select(F.col("doc_id").alias("d"), "toxic")
    got = out.join(lab, F.col("doc_id") == F.col("d")).toPandas()
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got["doc_id"]]).all()
    assert (got["predicted"] == (got["score"] >= 0.3)).all()
    held = got[got["held_out"]]
    assert auc(held["score"].to_numpy(), held["toxic"].to_numpy()) > 0.85
