import duckdb
import pytest
from pyspark.sql import functions as F

from lodestone.llm import mixing
from lodestone.llm.common import n_words
from tests.llm.helpers import DOCS, clashing, corpus, frame, words


def targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """Water filling, round by round."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, free, left = {}, set(sizes), share * sum(sizes.values())
    while free:
        each = left / sum(w[s] for s in free)
        over = {s for s in free if w[s] * each >= most * sizes[s]}
        if not over:
            out |= {s: w[s] * each for s in free}
            break
        out |= {s: float(most * sizes[s]) for s in over}
        left -= sum(most * sizes[s] for s in over)
        free -= over
    return out


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 500, "c": 3, None: 70}, {"a": 0, "b": 0}, {"x": 7}, {chr(97 + i): (i * 37) % 200 for i in range(20)}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
    want = targets(sizes)
    assert set(got) == set(want) and all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_taken_words_meet_targets(spark):
    rows = corpus(n=120)
    docs = frame(spark, rows)
    got = mixing.mix(docs, n_words(F.col("text"))).toPandas()
    assert len(got) == len(rows) and (got["taken"] <= 2 * got["size"]).all() and (got["taken"] >= 0).all()
    for _, g in got.groupby("source"):
        assert g["taken"].sum() == int(g["target"].iloc[0] + 0.5) and g["source_size"].iloc[0] == g["size"].sum()
    again = mixing.mix(docs.repartition(3), n_words(F.col("text"))).toPandas()
    assert sorted(map(str, got.values.tolist())) == sorted(map(str, again.values.tolist()))


def test_mixed_corpus_has_the_words(spark):
    docs = clashing(frame(spark, corpus(n=120)))
    out = mixing.mix_documents(docs)
    assert out.columns == docs.columns
    want = mixing.mix(docs.drop("size", "taken", "target"), n_words(F.col("text"))).groupBy("source").agg(F.sum("taken").alias("t")).collect()
    have = {}
    for r in out.collect():
        have[r["source"]] = have.get(r["source"], 0) + len(words(r["text"]))
    assert have == {r["source"]: r["t"] for r in want}
    assert set(r[0] for r in out.select("_base").distinct().collect()) == {"own _base"}


def test_empty_null_and_wordless(spark):
    assert mixing.mix(frame(spark, []), n_words(F.col("text"))).count() == 0
    rows = [(1, None, "en", None, 0), (2, "", "en", "a", 0), (None, "a b c", "en", None, 5), (None, "a b c", "en", None, 5)]
    got = mixing.mix(frame(spark, rows), n_words(F.col("text"))).toPandas()
    assert got["size"].sum() == 6 and got["taken"].sum() == 9 or got["taken"].sum() == int(got[got["size"] > 0]["target"].iloc[0] + 0.5)


def test_sql(spark, sf_dir):
    duckdb.sql(f"create or replace view documents as select * from '{sf_dir}/documents.parquet'")
    want = duckdb.sql(mixing.OP7_SQL).df().sort_values("doc_id").reset_index(drop=True)
    got = mixing.op7_query(spark, sf_dir).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert got["taken"].tolist() == want["taken"].tolist() and (got["target"] - want["target"]).abs().max() < 1e-6
    assert got[["doc_id", "size", "source_size"]].equals(want[["doc_id", "size", "source_size"]])
    assert DOCS
