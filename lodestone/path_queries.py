"""Queries that go the whole way: files written and scanned, parsed, enriched, embedded, stored, searched and served.

Every document of the table is a file by a fixed rule of its number, so that
``path_oracles`` can compute what has to come out.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone import queries as Q
from lodestone import schemas as S
from lodestone import server
from lodestone.config import ProjectConfig
from lodestone.functions import text as X
from lodestone.operators import embedding, enrichment, markdown, providers, search, windows
from lodestone.operators.chunking import chunk_files
from lodestone.plans import ingest
from lodestone.sources import files, golden
from lodestone.sources.collection import Collection


def folder(spark: SparkSession, name: str) -> str:
    return f"{files.shared_folder(spark)}/queries/{name}-{uuid.uuid4().hex[:12]}"


def file_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder for each source with all its documents in one file: Markdown where the source's last digit is even; in sources that end in 2, 3 or 6 every third document begins with a bad byte."""
    docs = Q.table(spark, sf_dir, "documents").where("source is not null")
    digit = F.substring("source", -1, 1)
    bad = F.when((F.col("doc_id") % 3 == 0) & digit.isin("2", "3", "6"), F.lit(b"\xff")).otherwise(F.lit(b""))
    line = F.concat(bad, F.coalesce("text", F.lit("")).cast("binary")).cast("string")
    kind = F.when(digit.isin("0", "2", "4", "6", "8"), "md").otherwise("txt")
    path = folder(spark, "scan")
    rows = docs.select("source", "doc_id", kind.alias("kind"), line.alias("value"))
    rows.repartition("source").sortWithinPartitions("kind", "source", "doc_id").drop("doc_id").write.partitionBy("kind", "source").text(path)
    _rename(spark, path)
    got = files.read_files(spark, path, [".md", ".txt"])
    return got.select("source_path", "ext", F.md5(F.col("content").cast("binary")).alias("content_md5"), "error")


def _rename(spark: SparkSession, path: str) -> None:
    """Names that don't depend on the writer: one part of each folder becomes ``notes`` with the folder's extension."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for top in fs.listStatus(root):
        ext = top.getPath().getName().replace("kind=", ".")
        for source in fs.listStatus(top.getPath()) if top.isDirectory() else []:
            for part in fs.listStatus(source.getPath()):
                if part.getPath().getName().startswith("part-"):
                    fs.rename(part.getPath(), jvm.org.apache.hadoop.fs.Path(source.getPath(), f"notes{ext}"))


#: Languages by extension: line of import, function, kind of class, its first line, its members, last line.
SHAPES = [
    (".js", "import a from 'a';", "function f{}(x) {", "  x = x + 1;", "}", "methods", "class C {", "  m{}() {", "    return 1;", "  }", "}"),
    (".ts", "import a from 'a';", "function f{}(x: number): number {", "  x = x + 1;", "}", "methods", "class C {", "  public m{}(): number {", "    return 1;", "  }", "}"),
    (".frag", "#version 330", "float f{}(float x) {", "  x = x + 1.0;", "}", "none", "", "", "", "", ""),
    (".rs", "use std::io;", "fn f{}(x: i32) -> i32 {", "    step();", "}", "methods", "impl C {", "    fn m{}(&self) {", "        step();", "    }", "}"),
    (".go", "package main", "func f{}(x int) int {", "\tx = x + 1", "}", "fields", "type C struct {", "\tv{} int", "", "", "}"),
    (".java", "import a.B;", "", "", "", "methods", "public class C {", "    public int m{}() {", "        return 1;", "    }", "}"),
    (".c", "#include <a.h>", "int f{}(int x) {", "  x = x + 1;", "}", "fields", "struct C {", "  int v{};", "", "", "};"),
    (".cpp", "#include <a>", "int f{}(int x) {", "  x = x + 1;", "}", "methods", "class C {", "  int m{}() {", "    return 1;", "  }", "};"),
    (".rb", "require 'a'", "def f{}(x)", "  x + 1", "end", "methods", "class C", "  def m{}", "    1", "  end", "end"),
    (".swift", "import A", "func f{}(x: Int) {", "    step()", "}", "methods", "class C {", "    func m{}() {", "        step()", "    }", "}"),
]
CODE = ProjectConfig(code_chunk_min_lines=2, code_chunk_max_lines=6)


def _repeat(n: Column, line) -> Column:
    """Lines for 1 to n."""
    return F.array_join(F.transform(F.filter(F.sequence(F.lit(0), n), lambda i: i > 0), line), "")


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a source file: doc_id % 10 names the language, other remainders the numbers of functions, body lines and members."""
    d = F.col("doc_id")
    nf, body, members = d % 3 + 1, d % 4 + 1, F.floor(d / 10) % 4

    def numbered(template: str, i: Column) -> Column:
        a, _, b = template.partition("{}")
        return F.concat(F.lit(a), i.cast("string"), F.lit(b))

    def content(s: tuple) -> Column:
        _, head, f, step, end, kind, c, m, inner, close, last = s
        functions = _repeat(nf, lambda i: F.concat(numbered(f, i), F.lit("\n"), F.repeat(F.lit(step + "\n"), body.cast("int")), F.lit(end + "\n\n"))) if f else F.lit("")
        member = lambda i: F.concat(numbered(m, i), F.lit("\n" + (f"{inner}\n{close}\n" if kind == "methods" else "")))
        classes = F.concat(F.lit(c + "\n"), _repeat(members, member), F.lit(last + "\n")) if kind != "none" else F.lit("")
        return F.concat(F.lit(head + "\n\n"), functions, classes)

    text, ext = None, None
    for i, s in enumerate(SHAPES):
        text = F.when(d % 10 == i, content(s)) if text is None else text.when(d % 10 == i, content(s))
        ext = F.when(d % 10 == i, F.lit(s[0])) if ext is None else ext.when(d % 10 == i, F.lit(s[0]))
    docs = Q.table(spark, sf_dir, "documents")
    return files.of_columns(docs, F.concat(F.lit("code/"), d.cast("string"), ext), text)


def _chunk_columns(chunks: DataFrame) -> DataFrame:
    return chunks.select("source_path", "start_line", "end_line", "chunk_type", "language", "symbol_type", "symbol_name", F.col("parent_id").isNotNull().alias("has_parent"), F.size(F.split("text", "\n")).alias("text_lines"))


def _entry_columns(entries: DataFrame) -> DataFrame:
    return entries.select("file_path", "concept", "entry_type", "start_line", "end_line")


def code_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunk_columns(chunk_files(code_files(spark, sf_dir), CODE).chunks)


def code_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entry_columns(chunk_files(code_files(spark, sf_dir), CODE).entries)


def python_files(spark: SparkSession, sf_dir: str, broken: bool = False) -> DataFrame:
    """Each document as a Python file: functions of doc_id % 9 + 1 statements, decorated if the number is even, and a class of methods."""
    d = F.col("doc_id")
    mark = F.when(d % 2 == 0, "@wraps\n").otherwise("")
    functions = _repeat(d % 3 + 1, lambda i: F.concat(mark, F.lit("def f"), i.cast("string"), F.lit("(x):\n"), F.repeat(F.lit("    x = x + 1\n"), (d % 9 + 1).cast("int")), F.lit("\n")))
    methods = _repeat(F.floor(d / 9) % 3 + 1, lambda i: F.concat(F.lit("    def m"), i.cast("string"), F.lit("(self):\n        return 1\n")))
    text = F.concat(F.lit("print 'old'\n\n" if broken else "import a\n\n"), functions, F.lit("class C:\n"), methods)
    return files.of_columns(Q.table(spark, sf_dir, "documents"), F.concat(F.lit("py/"), d.cast("string"), F.lit(".py")), text)


def python_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunk_columns(chunk_files(python_files(spark, sf_dir), CODE).chunks)


def python_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entry_columns(chunk_files(python_files(spark, sf_dir), CODE).entries)


def broken_python_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entry_columns(chunk_files(python_files(spark, sf_dir, broken=True), CODE).entries)


def lean_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a Lean file of declarations of five kinds, every second one under a nested comment that names another theorem."""
    d = F.col("doc_id")
    kinds = F.array(*[F.lit(x) for x in ("theorem", "lemma", "def", "structure", "abbrev")])
    doc = F.when(d % 2 == 0, "/-- about /- theorem no : a -/ it -/\n").otherwise("")
    made = _repeat(d % 4 + 1, lambda i: F.concat(doc, F.element_at(kinds, ((d + i) % 5 + 1).cast("int")), F.lit(" t"), i.cast("string"), F.lit(" : a = b := by\n"), F.repeat(F.lit("  simp\n"), (d % 3 + 1).cast("int"))))
    return files.of_columns(Q.table(spark, sf_dir, "documents"), F.concat(F.lit("lean/"), d.cast("string"), F.lit(".lean")), F.concat(F.lit("import A\n\n"), made))


def lean_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunk_columns(chunk_files(lean_files(spark, sf_dir), CODE).chunks)


def lean_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entry_columns(chunk_files(lean_files(spark, sf_dir), CODE).entries)


def ingest_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown files chunked, embedded by hashes, stored, and read back."""
    store = Collection(spark, folder(spark, "store"), "c")
    ingest.ingest_files(Q.md_files(spark, sf_dir), ProjectConfig(min_chunk_lines=12, max_chunk_lines=16), store, embedding.HashProvider(4))
    return store.read().select("point_id", "source_path", "start_line", "end_line", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.size("embedding").alias("dimension"))


def ingest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an ingest reports: chunks by type, index entries."""
    path = folder(spark, "store")
    both = Q.md_files(spark, sf_dir).unionByName(Q.doc_files(spark, sf_dir))
    config = ProjectConfig(min_chunk_lines=12, max_chunk_lines=16)
    counts = ingest.ingest_files(both, config, Collection(spark, path, "c"), embedding.HashProvider(2), index_path=f"{path}/index")
    named = [(k, int(counts[k])) for k in ("markdown_chunks", "code_chunks", "total_chunks", "errors", "pruned_points")]
    stored = golden.load_index(spark, f"{path}/index").count()
    return spark.createDataFrame([*named, ("index_entries", stored)], "name string, n long")


def _stored(spark: SparkSession, sf_dir: str) -> tuple[Collection, DataFrame, DataFrame]:
    old, new = Q._versions(spark, sf_dir)
    return Collection(spark, folder(spark, "store"), "c"), old.withColumn("summary", F.lit("old")), new.withColumn("summary", F.lit("new"))


def _content(store: Collection) -> DataFrame:
    return store.read().select("point_id", "source_path", "summary", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def collection_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, old, new = _stored(spark, sf_dir)
    store.ensure(recreate=True)
    store.upsert(old)
    store.upsert(new)
    return _content(store)


def collection_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that a sync removes."""
    store, old, new = _stored(spark, sf_dir)
    store.write(old)
    return store.sync(new)


def collection_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content after two sources are deleted, with the numbers of points that went."""
    store, old, _ = _stored(spark, sf_dir)
    store.write(old)
    paths = [r[0] for r in old.select("source_path").distinct().orderBy("source_path").limit(2).collect()]
    gone = sum(store.delete_by_source(p) for p in paths)
    return _content(store).withColumn("gone", F.lit(gone))


def pointer_index_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "index")
    golden.save_index(markdown.markdown_entries(Q.md_files(spark, sf_dir)).where("entry_type = 'section'"), path)
    return golden.load_index(spark, path)


def golden_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as a labelled set in a JSON file, read back as spans."""
    items = Q.table(spark, sf_dir, "benchmark")
    span = lambda lo, hi: F.struct(F.concat(F.lit("f"), (F.col("item_id") % 5).cast("string"), F.lit(".md")).alias("file"), lo.cast("int").alias("start_line"), hi.cast("int").alias("end_line"))
    i = F.col("item_id")
    tool = F.when(i % 2 == 0, "search_code").otherwise("lookup_index")
    query = F.struct(F.concat(F.lit("q"), i.cast("string")).alias("id"), F.col("text").alias("query"), tool.alias("tool"), F.array(span(i + 1, i + 3)).alias("decisive_spans"), F.array(span(i, i + 5), span(F.lit(None), F.lit(None))).alias("supportive_spans"))
    path = folder(spark, "dataset")
    items.groupBy().agg(F.sort_array(F.collect_list(query)).alias("queries")).select(F.lit("d").alias("corpus_dir"), "queries").coalesce(1).write.json(path)
    dataset = golden.load_dataset(spark, path)
    return golden.gold_spans(dataset).join(dataset.select(F.col("query_id"), "tool"), "query_id").select("query_id", "tool", "grade", "span_id", "file", "start_line", "end_line")


def moody_model(messages: list[dict]) -> str:
    """Nonsense for a batch that holds a file's beginning, a broken connection where one holds line 9, else the canned answer; once asked again, it does better."""
    prompt = messages[1]["content"]
    several = prompt.count(enrichment.CHUNK_MARK) > 1
    if several and "\nLines: 9-" in prompt:
        raise ConnectionError("gone")
    if several and "\nLines: 1-" in prompt and len(messages) < 4:
        return "no JSON here"
    return enrichment.canned_model(messages[:2])


def enrich_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enrichment by a model that fails: asked again with the error, and chunk by chunk where a batch is lost."""
    chunks = search.search_ids(windows.window_chunks(Q.doc_files(spark, sf_dir), 4))
    chunks = chunks.withColumns({"language": F.lit(None).cast("string"), "summary": F.lit(None).cast("string"), "hypothetical_questions": F.lit(None).cast("array<string>")})
    out = enrichment.enrich(chunks, moody_model, ingest.keeper(spark))
    return out.select("source_path", "start_line", "summary", F.array_join("hypothetical_questions", "|").alias("questions"))


class CountingProvider:
    """Vectors of two numbers that the text gives."""

    dimension = 2

    def embed(self, texts: list[str]) -> list[list[float]]:
        if len(texts) > S.EMBED_BATCH:
            raise ValueError("too many texts at once")
        return [[float(len(t)), float(t.count("e"))] for t in texts]


def embed_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = Q.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = embedding.embedded(docs, F.col("text"), CountingProvider())
    return out.select("doc_id", F.element_at("embedding", 1).cast("double").alias("chars"), F.element_at("embedding", 2).cast("double").alias("es"))


class Line:
    """A transport that fails as the text of the question says, and notes how often it was asked and waited."""

    def __init__(self):
        self.calls, self.waits = 0, []

    def post(self, url: str, headers: dict, body: bytes, timeout: float) -> tuple[int, bytes]:
        import json

        self.calls += 1
        kind = json.loads(body)["messages"][0]["content"]
        if kind == "2" and self.calls < 3 or kind == "3":
            return providers.TOO_MANY, b"slow down"
        if kind == "1" and self.calls < 2:
            raise ConnectionError("reset")
        if kind == "4":
            return 200, b'{"error": "overloaded"}'
        return 200, json.dumps({"choices": [{"message": {"content": f"answer {kind}"}}]}).encode()


def chat_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chat service that is asked once for each conversation's turn, over a line that breaks."""
    rows = Q.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.pmod(F.col("conv_id") + F.col("turn"), F.lit(5)).cast("string").alias("kind"))

    @F.pandas_udf("answer string, calls int, waited double")
    def ask(kinds):
        import pandas as pd

        out = []
        for kind in kinds:
            line = Line()
            service = providers.ChatService("key", "m", "http://model", transport=line.post, sleep=line.waits.append)
            try:
                got = service([{"role": "user", "content": kind}])
            except providers.ServiceError:
                got = None
            out.append((got, line.calls, float(sum(line.waits))))
        return pd.DataFrame(out, columns=["answer", "calls", "waited"])

    return rows.withColumn("r", ask("kind")).select("conv_id", "turn", "r.answer", "r.calls", "r.waited")


class FixedProvider:
    """The vector that it holds, whatever the text."""

    def __init__(self, vector: list[float]):
        self.vector, self.dimension = vector, len(vector)

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [self.vector for _ in texts]


def _retriever(spark: SparkSession, sf_dir: str) -> search.Retriever:
    docs = Q.table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang", "n_chars")
    rows = Q.table(spark, sf_dir, "embeddings").join(docs, F.col("vec_id") == F.col("doc_id"), "left")
    chunk = rows.select(
        F.col("vec_id").cast("string").alias("point_id"), F.coalesce("text", F.lit("")).alias("text"), F.concat(F.coalesce("source", F.lit("none")), F.lit(".py")).alias("file_name"), F.lit(1).alias("start_line"),
        F.coalesce("n_chars", F.lit(0)).cast("int").alias("end_line"), F.lit(0.0).alias("math_density"), F.lit("code").alias("chunk_type"), F.col("lang").alias("language"), F.lit(None).cast("string").alias("symbol_name"),
        F.lit(None).cast("string").alias("symbol_type"), F.lit(None).cast("string").alias("summary"), F.lit(None).cast("string").alias("chunk_id"), F.lit(None).cast("string").alias("parent_id"), "embedding",
    )
    return search.Retriever(chunk, Q.part_index(spark, sf_dir), FixedProvider(Q._query_vector(spark, sf_dir)))


def tool_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of the three query tools, as the server gives them."""
    tools = _retriever(spark, sf_dir)
    asked = [("search_documents", {"query": "x", "top_k": 3}), ("search_code", {"query": "x", "language": "en", "top_k": 2}), ("lookup_index", {"concept": "no such concept"}), ("lookup_index", {"concept": Q._concept(spark, sf_dir)})]
    rows = []
    for n, (name, given) in enumerate(asked):
        reply = server.answer(tools, {"id": n, "method": "tools/call", "params": {"name": name, "arguments": given}})
        rows.append((n, name, reply["result"]["content"][0]["text"]))
    return spark.createDataFrame(rows, "n int, tool string, text string").select("n", "tool", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def tool_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = server.answer(None, {"id": 1, "method": "tools/list"})["result"]["tools"]
    return spark.createDataFrame([(t["name"], t["inputSchema"]["required"][0], len(t["inputSchema"]["properties"])) for t in rows], "tool string, required string, arguments int")


def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Methods and the classes that they point to."""
    chunks = chunk_files(code_files(spark, sf_dir), CODE).chunks
    child = chunks.where("parent_id is not null").select("source_path", F.col("symbol_name").alias("method"), F.col("parent_id").alias("_p"))
    return child.join(chunks.select(F.col("chunk_id").alias("_c"), F.col("symbol_name").alias("class")), F.col("_p") == F.col("_c")).select("source_path", "method", "class")


def corpus_setup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and lines by extension of the code corpus."""
    rows = code_files(spark, sf_dir)
    return rows.groupBy("ext").agg(F.count("*").alias("files"), F.sum(F.size(X.file_lines(F.col("content")))).alias("lines"))


QUERIES = [
    file_scan, code_chunks, code_index, python_chunks, python_index, broken_python_index, lean_chunks, lean_index, ingest_points, ingest_counts, collection_upsert,
    collection_sync, collection_delete, pointer_index_round_trip, golden_spans, enrich_run, embed_run, chat_backoff, tool_answers, tool_list, chunk_ids, corpus_setup,
]


def queries() -> dict:
    return {q.__name__: q for q in QUERIES}
