"""Model services, the tool server, and collections that several writers change."""

import io
import json

import pytest
from pyspark.sql import functions as F

from lodestone import server
from lodestone.cli import init, main
from lodestone.operators import embedding, providers, search
from lodestone.sources.collection import Collection


def service(kind, answers, **more):
    """A service whose transport gives these answers in turn, what it was sent, and how long it waited."""
    sent, waits, left = [], [], list(answers)

    def post(url, headers, body, timeout):
        sent.append((url, headers, json.loads(body), timeout))
        found = left.pop(0)
        if isinstance(found, Exception):
            raise found
        return found

    return kind("key", "m", "http://x", transport=post, sleep=waits.append, **more), sent, waits


GOOD = (200, b'{"choices": [{"message": {"content": "hi"}}]}')


def test_chat_is_asked_again_after_rate_limits_and_failures():
    for first in ((429, b""), OSError("reset"), (500, b"broken"), (200, b'{"error": 1}'), (200, b"no json")):
        chat, sent, waits = service(providers.ChatService, [first, first, GOOD])
        assert chat([{"role": "user", "content": "q"}]) == "hi" and len(sent) == 3 and waits == [1, 2]
    chat, sent, waits = service(providers.ChatService, [(429, b"")] * 3)
    with pytest.raises(providers.ServiceError):
        chat([])
    assert len(sent) == 3 and waits == [1, 2]
    chat, sent, _ = service(providers.ChatService, [GOOD], order=("a", "b"), options={"temperature": 0})
    chat([{"role": "user", "content": "q"}])
    assert sent[0][0] == "http://x/chat/completions" and sent[0][1]["Authorization"] == "Bearer key"
    assert sent[0][2] == {"model": "m", "messages": [{"role": "user", "content": "q"}], "temperature": 0, "provider": {"order": ["a", "b"]}}
    with pytest.raises(ValueError):
        providers.ChatService("", "m", "http://x")([])


def test_embeddings_come_in_order_and_errors_are_final():
    good = (200, json.dumps({"data": [{"index": 1, "embedding": [2.0]}, {"index": 0, "embedding": [1.0]}]}).encode())
    emb, sent, waits = service(providers.EmbeddingService, [(429, b""), OSError("x"), good], dimension=1, order=("a",), only=True)
    assert emb.embed(["a", "b"]) == [[1.0], [2.0]] and waits == [1, 2] and sent[0][3] == 50.0 and sent[0][2]["provider"]["allow_fallbacks"] is False
    for bad in ((400, b"bad"), (200, b'{"error": "too long"}')):
        emb, sent, waits = service(providers.EmbeddingService, [bad, good])
        with pytest.raises(providers.ServiceError):
            emb.embed(["a"])
        assert len(sent) == 1 and not waits


def tools(spark):
    rows = [("p1", "alpha text", "a.py", "code", "python", [1.0, 0.0]), ("p2", "beta text", "b.md", "markdown", None, [0.0, 1.0])]
    points = spark.createDataFrame(rows, "point_id string, text string, file_name string, chunk_type string, language string, embedding array<float>")
    none = F.lit(None).cast("string")
    points = points.withColumns({"start_line": F.lit(1), "end_line": F.lit(2), "math_density": F.lit(0.0), "symbol_name": none, "symbol_type": none, "summary": none, "chunk_id": none, "parent_id": none})
    entries = spark.createDataFrame([("Alpha", "a.py", "a.py", 1, 2, "class")], "concept string, file_name string, file_path string, start_line int, end_line int, entry_type string")

    class Ones:
        dimension = 2

        def embed(self, texts):
            return [[1.0, 0.0] for _ in texts]

    return search.Retriever(points, entries, Ones())


def test_server_answers_lines(spark):
    asked = [
        {"jsonrpc": "2.0", "id": 1, "method": "initialize", "params": {}}, {"jsonrpc": "2.0", "method": "notifications/initialized"}, {"id": 2, "method": "tools/list"},
        {"id": 3, "method": "tools/call", "params": {"name": "search_documents", "arguments": {"query": "x", "top_k": 1}}}, {"id": 4, "method": "tools/call", "params": {"name": "lookup_index", "arguments": {"concept": "alpha"}}},
        {"id": 5, "method": "tools/call", "params": {"name": "nothing", "arguments": {}}}, {"id": 6, "method": "other"}, {"id": 7, "method": "ping"},
    ]
    out = io.StringIO()
    server.serve(tools(spark), [*map(json.dumps, asked), "", "no json"], out)
    got = {r["id"]: r for r in map(json.loads, out.getvalue().splitlines())}
    assert set(got) == {1, 2, 3, 4, 5, 6, 7, None} and len(got[2]["result"]["tools"]) == 3 and got[7]["result"] == {}
    assert "alpha text" in got[3]["result"]["content"][0]["text"] and "beta" not in got[3]["result"]["content"][0]["text"]
    assert "**Alpha** (class)" in got[4]["result"]["content"][0]["text"] and got[5]["error"] and got[6]["error"]["code"] == -32601 and got[None]["error"]["code"] == -32700


def test_init_registers_the_server_beside_others(tmp_path):
    (tmp_path / ".mcp.json").write_text(json.dumps({"mcpServers": {"other": {"command": "x"}}}))
    assert ".mcp.json" in init(str(tmp_path)) and init(str(tmp_path)) == []
    known = json.loads((tmp_path / ".mcp.json").read_text())["mcpServers"]
    assert known["other"] == {"command": "x"} and known["lodestone"]["args"][2] == "serve"


def test_enrichment_needs_a_service(tmp_path, spark):
    init(str(tmp_path))
    with pytest.raises(SystemExit):
        main(["ingest", "--project-dir", str(tmp_path), "--enrich"])


POINT = "point_id string, source_path string, text string"


def rows(spark, *some):
    return spark.createDataFrame(list(some), POINT)


def test_writes_touch_their_buckets_only_and_none_is_lost(spark, tmp_path):
    c = Collection(spark, str(tmp_path), "c", buckets=8)
    c.write(rows(spark, *[(f"p{i}", f"s{i}", "old") for i in range(40)]))
    before = c._manifest()
    assert c.upsert(rows(spark, ("p3", "s3", "new"), ("q", "s3", "more"))) == 2
    after = c._manifest()
    assert sum(before["folders"][b] != after["folders"][b] for b in before["folders"]) == 1
    got = {r["point_id"]: r["text"] for r in c.read().collect()}
    assert len(got) == 41 and got["p3"] == "new" and got["q"] == "more" and got["p4"] == "old"
    stale = Collection(spark, str(tmp_path), "c")
    stale._manifest = lambda: before  # it has not seen the last commit
    with pytest.raises(Exception, match="(?i)exist"):
        stale.upsert(rows(spark, ("p5", "s5", "lost")))
    assert c.read().where("text = 'lost'").isEmpty() and c.delete_by_source("s4") == 1 and c.read().count() == 40
    gone = c.sync(rows(spark, ("p1", "s1", "x"), (None, None, "no path"))).collect()
    assert len(gone) == 38 and c.read().count() == 2


def test_hash_provider_and_expression_agree(spark):
    one = embedding.HashProvider(6)
    df = embedding.embedded(spark.createDataFrame([("some text",), ("",)], "t string"), F.col("t"), one)
    for r in df.collect():
        assert r["embedding"] == pytest.approx(one.embed([r["t"]])[0], abs=1e-6)
