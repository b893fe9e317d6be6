"""Steps whose memory and work must not grow faster than their input."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lodestone.operators import enrichment, parsing, search
from lodestone.plans import evaluation, ingest
from lodestone.sources import files, golden


def test_search_of_any_number_of_queries_is_dealt_in_cells(spark, monkeypatch):
    """Many cells, equal vectors and a zero vector give what brute force gives; there is no bound on queries."""
    monkeypatch.setattr(search, "CELL_POINTS", 40)
    monkeypatch.setattr(search, "CELL_QUERIES", 16)
    monkeypatch.setattr(search, "BLOCK_NUMBERS", 400)
    rng = np.random.default_rng(5)
    v = rng.normal(size=(300, 3)).round(1)
    v[50:90] = v[50]
    v[7] = 0
    points = spark.createDataFrame([(f"p{i:03}", x.tolist()) for i, x in enumerate(v)] + [("none", None)], "point_id string, embedding array<float>")
    asked = points.where(F.col("point_id") < "p100").select(F.col("point_id").alias("query_id"), F.col("embedding").alias("vector"))
    w = v.astype("float32").astype(float)
    unit = w / np.where((n := np.linalg.norm(w, axis=1, keepdims=True)) == 0, 1, n)
    score = np.round(unit @ unit[:100].T, 6)
    want = []
    for q in range(100):
        for rank, i in enumerate(sorted(range(300), key=lambda i: (-score[i, q], i))[:5]):
            want.append((f"p{q:03}", rank + 1, f"p{i:03}", score[i, q]))
    got = search.top_k_grid(points, asked, 5)
    assert sorted(tuple(r) for r in got.select("query_id", "rank", "point_id", "score").collect()) == want
    batch = search.top_k_batch(points, asked, 5)
    assert sorted(tuple(r) for r in batch.select("query_id", "rank", "point_id", "score").collect()) == want


def test_search_without_points_or_queries(spark):
    points = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>")
    asked = points.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    for p, q, n in ((points, asked, 1), (points.limit(0), asked, 0), (points, asked.limit(0), 0)):
        assert search.top_k_grid(p, q, 5, "vec_id").count() == search.top_k_batch(p, q, 5, "vec_id").count() == n


def test_workers_behind_a_kept_frame_get_small_batches(spark):
    def sizes(batches):
        for b in batches:
            yield pa.record_batch([pa.array([b.num_rows])], ["n"])

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    got = ingest.keeper(spark)(spark.range(0, 3500, 1, 1).mapInArrow(sizes, "n long"), "sizes").agg(F.max("n"), F.sum("n")).first()
    assert got[0] <= 1000 and got[1] == 3500 and spark.conf.get(name) == before
    wide = spark.range(0, 900, 1, 1).select(F.repeat(F.lit("x"), 100_000).alias("t"))
    assert ingest.keeper(spark)(wide.mapInArrow(sizes, "n long"), "sizes").agg(F.max("n")).first()[0] < 100


def test_prompts_are_asked_in_parts(spark):
    def model(messages):
        if messages[-1]["content"] == "p7":
            raise ConnectionError("gone")
        return "answer to " + messages[1]["content"]

    asked = spark.range(0, 250, 1, 1).select(F.col("id").cast("string").alias("batch"), F.lit(1).alias("n"), F.concat(F.lit("p"), F.col("id").cast("string")).alias("prompt"))
    got = {r["batch"]: (r["n"], r["prompt"], r["content"]) for r in enrichment.ask(asked, model).collect()}
    assert got == {str(i): (1, f"p{i}", None if i == 7 else f"answer to p{i}") for i in range(250)}
    again = asked.withColumns({"content": F.lit("bad"), "error": F.lit("no JSON")})
    assert enrichment.ask(again, lambda m: str(len(m)) + m[3]["content"][:45], True).first()["content"] == "4Your last answer could not be used. Error: no"


def labelled(spark):
    """Results, spans and files; of two files of one name the last by path gives the weights."""
    texts = [("a/x.md", "one two\nthree\n\nfour five six\n"), ("b/x.md", "1\n2 2\n"), ("c/y.md", "a b c\n"), ("c/z.md", None)]
    corpus = files.of_columns(spark.createDataFrame(texts, "p string, t string"), F.col("p"), F.col("t"))
    rows = [("l", "q", 1, "x.md", "b/x.md", 1, 9), ("l", "q", 2, "y.md", "c/y.md", 1, 1), ("l", "q", 3, "z.md", "c/z.md", 1, 1)]
    results = spark.createDataFrame(rows, "label string, query_id string, rank int, file_name string, source_path string, start_line int, end_line int")
    spans = spark.createDataFrame([("q", 2, 0, "b/x.md", 2, 4), ("q", 2, 1, "c/z.md", 1, 2)], "query_id string, grade int, span_id int, file string, start_line int, end_line int")
    return results, spans, corpus


def test_concentration_counts_lines_of_files(spark):
    results, spans, corpus = labelled(spark)
    for weights in (corpus, golden.line_weights(corpus.where("content is not null"))):
        assert [r["concentration"] for r in evaluation.concentration(results, spans, weights, (1, 3)).orderBy("k").collect()] == [2 / 3, 2 / 6]


def test_canary_reads_files_as_weights(spark):
    results, spans, corpus = labelled(spark)
    both = results.unionByName(results.withColumns({"label": F.lit(evaluation.S.CANARY), "start_line": F.lit(2), "end_line": F.lit(2)}))
    cover, dense = evaluation.coverage(both, spans, corpus, (1,)), evaluation.concentration(both, spans, corpus, (1,))
    assert sorted((r["label"], r["n_spans"], r["coverage"]) for r in cover.collect()) == [("l", 2, 1.0), (evaluation.S.CANARY, 2, 1.0)]
    assert evaluation.canary(cover, dense).count() == 0


def test_files_are_parsed_in_parts(spark):
    """A batch of files gives records in several parts, all files in order; large files stand in small parts."""
    rows = spark.range(0, 1000, 1, 1).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("source_path"), F.lit("f").alias("file_name"), F.lit("py").alias("strategy"), F.lit(".py").alias("ext"), F.lit("x").alias("content"))
    done = parsing.parsed_files(rows, {"py": lambda text, name, *_: [parsing.Unit(1, 1, "k", text)]}, 1, 9)
    assert [r["source_path"] for r in done.collect()] == [f"f{i}" for i in range(1000)]
    big = pa.record_batch([pa.array(["x" * (1 << 20)] * 20)], ["content"])
    got = [b.num_rows for b in parsing.parts(big)]
    assert sum(got) == 20 and max(got) <= 4
    assert [b.num_rows for b in parsing.parts(pa.record_batch([pa.array(range(1000))], ["n"]))] == [256, 256, 256, 232]


def test_dispatch_is_no_join(spark):
    """A strategy is an expression of the extension, so a filter by it goes below what makes the content; a listed strategy alone is looked for."""
    rows = files.of_columns(spark.createDataFrame([("a.md", "# x"), ("b.py", "x = 1"), ("c", None), ("d.zz", "t")], "p string, t string"), F.col("p"), F.col("t"))
    got = files.dispatch(rows)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(tuple(r) for r in got.select("file_name", "strategy", "language").collect()) == [("a.md", "markdown", None), ("b.py", "python", "python"), ("c", "plaintext", None), ("d.zz", "plaintext", None)]
    assert [r["file_name"] for r in files.dispatch(rows, {".zz": "line-based"}, None).collect()] == ["d.zz"]
