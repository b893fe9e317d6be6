"""Search, store, sync, enrichment, evaluation, report, streaming and settings."""

import json

import pytest
from pyspark.sql import functions as F

from lodestone import schemas as S
from lodestone.config import ProjectConfig, collection_name, load_config, slug
from lodestone.operators import enrichment, search
from lodestone.operators.embedding import HashProvider, embedded
from lodestone.plans import evaluation, ingest, report
from lodestone.sources import files, golden
from lodestone.sources.collection import Collection
from lodestone.streaming import ingest as streaming

PROVIDER = HashProvider(8)
CONFIG = ProjectConfig(file_extensions=[".md", ".py"], code_chunk_min_lines=2, code_chunk_max_lines=6, key_terms=["gap"])
TEXTS = {"a/x.md": "# Sets\nA gap here.\n", "b/x.md": "# Sets\nOther.\n", "t.py": "class A:\n    def m(self):\n        return 1\n\n    def n(self):\n        return 2\n\n    z = 1\n"}


def corpus(spark, contents):
    return files.of_columns(spark.createDataFrame(list(contents.items()), "p string, t string"), F.col("p"), F.col("t"))


def store(spark, tmp_path, name="c"):
    return Collection(spark, str(tmp_path / "store"), name)


def content(c):
    return sorted((r["source_path"], r["start_line"], r["end_line"]) for r in c.read().collect())


def test_top_k_filters_ties_and_caps(spark):
    rows = [("b", [1.0, 0.0], 0.2, "py"), ("a", [2.0, 0.0], 0.9, None), ("c", [0.0, 1.0], None, "py"), ("d", [0.0, 0.0], 0.5, "go")]
    df = spark.createDataFrame(rows, "point_id string, embedding array<double>, math_density double, language string")
    ids = lambda **k: [r["point_id"] for r in search.top_k(df, [1.0, 0.0], **k).orderBy("rank").collect()]
    assert ids(k=3) == ["a", "b", "c"] and ids(k=9) == ["a", "b", "c", "d"] and ids(k=0) == []
    assert ids(language="py") == ["b", "c"] and ids(min_math_density=0.3) == ["a", "d"] and ids(min_math_density=0.0) == ["a", "b", "c", "d"]
    asked = spark.createDataFrame([("q1", [1.0, 0.0]), ("q2", [0.0, 3.0])], "query_id string, vector array<double>")
    got = sorted((r["query_id"], r["rank"], r["point_id"], r["score"]) for r in search.top_k_batch(df, asked, 2).collect())
    assert got == [("q1", 1, "a", 1.0), ("q1", 2, "b", 1.0), ("q2", 1, "c", 1.0), ("q2", 2, "a", 0.0)]
    with pytest.raises(ValueError):
        search.top_k_batch(df, asked, 2, most_queries=1)


def test_ingest_is_repeatable_and_sync_removes(spark, tmp_path):
    c = store(spark, tmp_path)
    first = ingest.ingest_files(corpus(spark, TEXTS), CONFIG, c, PROVIDER, index_path=str(tmp_path / "index"))
    before = content(c)
    assert first["markdown_chunks"] == 2 and first["code_chunks"] == 3 and first["total_chunks"] == len(before) == 5
    ingest.ingest_files(corpus(spark, TEXTS), CONFIG, c, PROVIDER, recreate=False)
    assert content(c) == before
    changed = {"a/x.md": "new first line\n\n# Sets\nA gap here.\n", "t.py": TEXTS["t.py"]}
    got = ingest.ingest_files(corpus(spark, changed), CONFIG, c, PROVIDER, recreate=False)
    assert got["pruned_points"] == 1 and {p for p, _, _ in content(c)} == {"a/x.md", "t.py"} and ("a/x.md", 1, 4) in content(c)
    assert sorted(r[0] for r in c.source_paths().collect()) == ["a/x.md", "t.py"]
    assert c.delete_by_source("t.py") == 3 and c.delete_by_source("none") == 0 and {p for p, _, _ in content(c)} == {"a/x.md"}
    none = ingest.ingest_files(corpus(spark, {"e.md": "\n"}), CONFIG, c, PROVIDER, recreate=False)
    assert none["total_chunks"] == 0 and content(c) == []
    index = golden.load_index(spark, str(tmp_path / "index"))
    assert {r["concept"] for r in index.collect()} == {"Sets", "gap", "A", "A.m", "A.n"}


def test_upsert_replaces_by_id(spark, tmp_path):
    c = store(spark, tmp_path)
    c.ensure()
    assert c.exists() and c.read().count() == 0
    row = lambda i, t: (i, t, "p", [1.0])
    schema = "point_id string, text string, source_path string, embedding array<float>"
    assert c.upsert(spark.createDataFrame([row("a", "1"), row("b", "2")], schema)) == 2
    c.upsert(spark.createDataFrame([row("b", "3"), row("c", "4")], schema))
    assert sorted((r["point_id"], r["text"]) for r in c.read().collect()) == [("a", "1"), ("b", "3"), ("c", "4")]
    c.ensure(recreate=True)
    assert c.read().count() == 0
    c.drop()
    assert not c.exists()


def test_retriever_tools(spark, tmp_path):
    c = store(spark, tmp_path)
    ingest.ingest_files(corpus(spark, TEXTS), CONFIG, c, PROVIDER, index_path=str(tmp_path / "i"))
    tools = search.Retriever(c.read(), golden.load_index(spark, str(tmp_path / "i")), PROVIDER)
    shown = tools.search_documents("anything", top=99)
    assert shown.count("### Result") == 5 and "\n---\n" in shown
    code = tools.search_code("anything", language="python")
    assert code.count("### Result") == 3 and code.count("<details>") == 1 and "```python" in code
    assert tools.search_code("x", language="cobol") == "No matching code found for the given query."
    assert tools.search_documents("x", min_math_density=2.0) == "No matching documents found for the given query."
    found = tools.lookup_index("a.m")
    assert found.startswith("Found 2 entries for 'a.m'") and found.index("**A.m**") < found.index("**A**")
    assert tools.lookup_index("zzz") == "No entries found for concept: 'zzz'"


def test_lookup_order_and_cut(spark):
    rows = [(f"Part {i}", "f", "d/f", i, i, t) for i, t in enumerate(["method", "section", "lemma", "other"] * 4)] + [("part", "f", "d/f", 99, 99, "other"), ("p", "f", "d/f", 1, 1, "definition")]
    df = spark.createDataFrame(rows, S.INDEX_ENTRY)
    got = [r["concept"] for r in search.lookup(df, "PART").orderBy(*search.lookup_order()).limit(3).collect()]
    assert got == ["part", "p", "Part 2"]
    text = search.format_lookup(search.lookup(df, "part"), "part")
    assert text.startswith("Found 18 entries for 'part' (showing top 10)") and text.count("- **") == 10


class Scripted:
    """Answers by the number of passages: batches fail, singles succeed, one file always raises."""

    def __call__(self, messages):
        asked = messages[1]["content"]
        n = asked.count(enrichment.CHUNK_MARK)
        if "raise.md" in asked:
            raise RuntimeError("no service")
        if n > 1:
            return "no json" if len(messages) == 2 else json.dumps({"chunks": []})
        return "Sure: " + enrichment.canned_model(messages[:2])


def chunks(spark, names, lines=5):
    rows = [(f"t {n}", n, n, "markdown", None, 1, lines, f"id{i}", None, None) for i, n in enumerate(names)]
    return spark.createDataFrame(rows, "text string, file_name string, source_path string, chunk_type string, language string, start_line int, end_line int, point_id string, summary string, hypothetical_questions array<string>")


def test_enrichment_batches_retries_and_fallback(spark):
    keep = ingest.keeper(spark)
    good = enrichment.enrich(chunks(spark, [f"{i}.md" for i in range(7)]), enrichment.canned_model, keep, 3).collect()
    assert all(r["summary"] and len(r["hypothetical_questions"]) == 1 for r in good)
    short = enrichment.enrich(chunks(spark, ["a.md"], 2), enrichment.canned_model, keep).collect()
    assert short[0]["summary"] is None
    mixed = {r["file_name"]: r["summary"] for r in enrichment.enrich(chunks(spark, [*[f"{i}.md" for i in range(40)], "raise.md"]), Scripted(), keep, 5).collect()}
    assert len(mixed) == 41 and mixed.pop("raise.md") is None and all(mixed.values())


def test_answers_are_checked(spark):
    item = lambda i, s="x", q=("a",): {"id": i, "summary": s, "hypothetical_questions": list(q)}
    dump = lambda *items: json.dumps({"chunks": list(items)})
    cases = [
        (dump(item(1), item(2)), [1, 2]), (dump(item(2), item(1)), [1, 2]), ("```json\n" + dump(item(1), item(2)) + "\n```", [1, 2]), (dump(item(1, " pad "), item(2)), [1, 2]),
        (dump(item(1)), None), (dump(item(1), item(1)), None), (dump(item(1), item(3)), None), (dump(item(1, "  "), item(2)), None), (dump(item(1, q=()), item(2)), None),
        (dump(item(1, q="abcdef"), item(2)), None), (json.dumps({"chunks": [{"id": 1, "summary": "x"}]}), None), ("nothing", None), ("", None), ("{broken", None),
    ]
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, c string").orderBy("i")
    got = [r[0] for r in df.select(enrichment.parsed(F.col("c"), F.lit(2))).collect()]
    assert [[x["id"] for x in g["items"]] if g["items"] is not None else None for g in got] == [want for _, want in cases]
    assert all((g["items"] is None) == (g["error"] is not None) for g in got) and got[3]["items"][0]["summary"] == "pad"


def test_embedding_by_a_provider(spark):
    class Lengths:
        dimension = 2

        def embed(self, texts):
            assert len(texts) <= 3
            return [[float(len(t)), 1.0] for t in texts]

    df = spark.createDataFrame([(i, "x" * i) for i in range(10)], "i int, text string")
    assert all(r["embedding"] == [float(r["i"]), 1.0] for r in embedded(df, F.col("text"), Lengths(), 3).collect())


def frames(spark, results, spans, weights):
    r = spark.createDataFrame([("c", q, n, f.rsplit("/", 1)[-1], f if "/" in f else None, a, b) for q, n, f, a, b in results], "label string, query_id string, rank int, file_name string, source_path string, start_line int, end_line int")
    s = spark.createDataFrame([(q, g, i, f, a, b) for i, (q, g, f, a, b) in enumerate(spans)], "query_id string, grade int, span_id int, file string, start_line int, end_line int")
    w = spark.createDataFrame([(f, i + 1, t) for f, ts in weights.items() for i, t in enumerate(ts)], "basename string, line_no int, tokens int")
    return r, s, w


WEIGHTS = {"x.py": [2] * 100, "y.md": [3] * 50, "z.md": [1] * 10}


def scores(spark, results, spans, k=5):
    got = frames(spark, results, spans, WEIGHTS)
    cover = {r["grade"]: r["coverage"] for r in evaluation.coverage(*got, (k,)).collect()}
    return cover.get(2, 0.0), evaluation.concentration(*got, (k,)).first()["concentration"], evaluation.wholeness(got[0], got[1], (k,)).first()["wholeness"]


def test_metrics_by_hand(spark):
    span = [("q", 2, "x.py", 10, 24)]
    assert scores(spark, [("q", 1, "x.py", 20, 40)], span) == (pytest.approx(5 / 15), pytest.approx(5 / 21), 0.0)
    assert scores(spark, [("q", 1, "x.py", 10, 16), ("q", 2, "x.py", 14, 24)], span)[::2] == (1.0, 0.0)
    assert scores(spark, [("q", 1, "x.py", 1, 100)], span) == (1.0, pytest.approx(15 / 100), 1.0)
    assert scores(spark, [("q", 1, "x.py", 10, 24), ("q", 2, "x.py", 10, 24)], span) == (1.0, 1.0, 1.0)
    assert scores(spark, [("q", 1, "y.md", 1, 50)], span) == (0.0, 0.0, 0.0)
    two = [("q", 2, "x.py", 1, 10), ("q", 2, "y.md", 1, 10)]
    assert scores(spark, [("q", 1, "y.md", 1, 10)], two)[0] == pytest.approx(30 / 50)
    assert scores(spark, [("q", 6, "x.py", 10, 24), ("q", 1, "z.md", 1, 1)], span)[0] == 0.0
    paths = [("q", 2, "a/x.py", 1, 5)]
    assert scores(spark, [("q", 1, "b/x.py", 1, 5)], paths)[0] == 0.0 and scores(spark, [("q", 1, "a/x.py", 1, 5)], paths)[0] == 1.0
    assert scores(spark, [("q", 1, "x.py", 90, 300)], [("q", 2, "x.py", 95, 200)])[0] == 1.0
    overlap = [("q", 2, "x.py", 1, 10), ("q", 1, "x.py", 5, 20)]
    assert scores(spark, [("q", 1, "x.py", 1, 20)], overlap)[1] == 1.0


def test_canary_needs_a_rival(spark):
    def won(values):
        cover = spark.createDataFrame([(label, 3, 2, c) for label, c, _ in values], "label string, k int, grade int, coverage double")
        dense = spark.createDataFrame([(label, 3, d) for label, _, d in values], "label string, k int, concentration double")
        return evaluation.canary(cover, dense).count()

    assert won([(S.CANARY, 0.9, 0.9), ("a", 0.5, 0.5)]) == 1
    assert won([(S.CANARY, 0.9, 0.9), ("a", 0.5, 0.5), ("b", 0.1, 0.9)]) == 0
    assert won([(S.CANARY, 0.9, 0.9)]) == 0


def test_dataset_and_report(spark, tmp_path):
    span = {"file": "a/x.md", "start_line": 1, "end_line": 2}
    data = {"corpus_dir": "c", "queries": [{"id": "1", "query": "sets", "tool": "lookup_index", "decisive_spans": [span]}, {"id": "2", "query": "what", "decisive_spans": [], "supportive_spans": [span, {"file": "t.py", "symbol": "A"}]}]}
    (tmp_path / "g.json").write_text(json.dumps(data))
    dataset = golden.load_dataset(spark, str(tmp_path / "g.json"))
    assert [(r["query_id"], r["tool"]) for r in dataset.orderBy("query_id").collect()] == [("1", "lookup_index"), ("2", "search_documents")]
    spans = golden.gold_spans(dataset)
    assert spans.count() == 2
    rows = corpus(spark, TEXTS)
    text = report.run_matrix(
        spark, rows, dataset, spans, golden.line_weights(rows), [report.RunConfig("ast"), report.RunConfig("lines", "line-based"), report.RunConfig(S.CANARY, "whole-file")],
        CONFIG, str(tmp_path / "ev"), PROVIDER, k_values=(3,))
    assert "| coverage@3 (decisive) |" in text and "| chunks | 5 | 3 | 3 |" in text and "WARNING" not in text and "lookup_index 1" in text
    bad = dict(data, queries=[{"id": "1", "query": "x", "tool": "grep"}])
    (tmp_path / "b.json").write_text(json.dumps(bad))
    with pytest.raises(Exception, match="unknown tool"):
        golden.load_dataset(spark, str(tmp_path / "b.json")).collect()


def test_weights_of_equal_names(spark):
    rows = corpus(spark, {"a/x.md": "one two\n\nthree\n", "b/x.md": "four\n"})
    assert [tuple(r) for r in golden.line_weights(rows).collect()] == [("x.md", 1, 1)]


def test_streaming_replaces_sources(spark, tmp_path):
    c = store(spark, tmp_path)

    def add(contents):
        corpus(spark, contents).select("source_path", "file_name", "ext", "content").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        streaming.start(spark, str(tmp_path / "in"), CONFIG, c, str(tmp_path / "cp"), PROVIDER, once=True).awaitTermination()

    add({"a/x.md": TEXTS["a/x.md"], "b/x.md": TEXTS["b/x.md"]})
    assert content(c) == [("a/x.md", 1, 2), ("b/x.md", 1, 2)]
    add({"a/x.md": "# New\nl\nl\n"})
    assert content(c) == [("a/x.md", 1, 3), ("b/x.md", 1, 2)]


def test_settings(tmp_path, monkeypatch):
    assert slug("My  Project!") == "my-project" and collection_name("My Project") == "my_project"
    (tmp_path / "rag-config.json").write_text(json.dumps({"name": "n", "min_chunk_lines": 7, "key_terms": ["a"], "unknown": 1}))
    got = load_config(str(tmp_path))
    assert (got.name, got.min_chunk_lines, got.key_terms, got.file_extensions) == ("n", 7, ["a"], [".md"])
    monkeypatch.setenv("LODESTONE_MIN_CHUNK_LINES", "9")
    monkeypatch.setenv("LODESTONE_FILE_EXTENSIONS", ".md, .py")
    assert load_config(str(tmp_path)).min_chunk_lines == 9 and load_config(str(tmp_path)).file_extensions == [".md", ".py"]
    (tmp_path / ".env").write_text("# c\nLODESTONE_NAME='from file'\n")
    assert load_config(str(tmp_path)).name == "from file"


def test_commands(spark, tmp_path, capsys):
    from lodestone.cli import main

    assert main(["init", "--project-dir", str(tmp_path)]) == 0 and main(["init", "--project-dir", str(tmp_path)]) == 0
    capsys.readouterr()
    (tmp_path / "data" / "x.md").write_text("# Sets\nA gap here.\n")
    run = lambda *a: (main([*a, "--project-dir", str(tmp_path), "--dimension", "8"]), capsys.readouterr().out)[1]
    assert json.loads(run("ingest"))["total_chunks"] == 1
    assert "# Sets" in run("search", "sets") and run("lookup", "sets").startswith("Found 1 entries")
    (tmp_path / "g.json").write_text(json.dumps({"queries": [{"id": "1", "query": "sets", "decisive_spans": [{"file": "x.md", "start_line": 1, "end_line": 2}]}]}))
    assert "| coverage@3 (decisive) | 1.000 | 1.000 | 1.000 |" in run("eval", "--dataset", str(tmp_path / "g.json"), "--top-k", "3")
