"""The evaluation as Markdown: a few rows for each table reach the driver."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone import schemas as S
from lodestone.config import collection_name
from lodestone.functions import text as X
from lodestone.operators.search import fixed
from lodestone.plans import evaluation as E

DEFINITIONS = """## Metrics

Gold spans are line ranges; a decisive span answers the query, a supportive one helps. A result matches a span of the
same file when their ranges overlap. Scores weigh lines by their tokens and lie between 0 and 1.

- coverage@k: share of all gold tokens that the first k results hold.
- concentration@k: share of the retrieved tokens that is gold, averaged over queries; a line read twice counts twice.
- wholeness@k: of the decisive spans that were touched, the share that one result holds whole (n spans).
- geometry: number and size of the chunks.

The whole-file baseline must not win both coverage and concentration; if it does, the metrics have failed.
"""
CAVEATS = """## Caveats

- Wholeness counts touched spans only: read it beside coverage.
- Slices by file type are small.
- Lookup matches substrings of concepts, so whole questions rarely find anything.
"""


@dataclass(frozen=True)
class RunConfig:
    """One column of the report."""

    label: str
    chunker: str = "ast"  # ast, line-based or whole-file
    enrich: bool = False
    enrichment_model: str = ""


def metric_rows(results: DataFrame, spans: DataFrame, weights: DataFrame, k_values: tuple[int, ...] = S.EVAL_K) -> DataFrame:
    """label, metric, value of all score tables in long form."""
    name = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    k = F.col("k").cast("string")
    grade = F.when(F.col("grade") == S.DECISIVE, " (decisive)").otherwise(" (supportive)")
    cover = E.coverage(results, spans, weights, k_values).select("label", name("coverage@", k, grade).alias("metric"), fixed(F.col("coverage"), 3).alias("value"))
    by_ext = E.coverage(results, spans, weights, k_values, by_ext=True).where(F.col("grade") == S.DECISIVE)
    by_ext = by_ext.select("label", name(F.col("ext"), " coverage@", k, " (n=", F.col("n_spans").cast("string"), ")").alias("metric"), fixed(F.col("coverage"), 3).alias("value"))
    dense = E.concentration(results, spans, weights, k_values).select("label", name("concentration@", k).alias("metric"), fixed(F.col("concentration"), 3).alias("value"))
    cell = F.concat(fixed(F.col("wholeness"), 3), F.lit(" (n="), F.col("n_overlapped").cast("string"), F.lit(")"))
    whole = E.wholeness(results, spans, k_values).select("label", name("overall wholeness@", k).alias("metric"), cell.alias("value"))
    whole_ext = E.wholeness(results, spans, k_values, by_ext=True).select("label", name(F.col("ext"), " wholeness@", k).alias("metric"), cell.alias("value"))
    out = cover
    for x in (by_ext, dense, whole, whole_ext):
        out = out.unionByName(x)
    return out


def pivoted(rows: DataFrame, labels: list[str]) -> DataFrame:
    """A row for each metric, a column for each label."""
    return rows.groupBy("metric").pivot("label", labels).agg(F.first("value"))


def _table(corner: str, labels: list[str], rows: list[list[str]]) -> str:
    lines = [[corner, *labels], ["---"] * (len(labels) + 1), *rows]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines)


def setup_summary(files: DataFrame, dataset: DataFrame, spans: DataFrame) -> str:
    """Files and lines by extension, queries by tool, decisive spans by extension."""
    by_ext = files.groupBy(X.suffix(F.col("file_name")).alias("x")).agg(F.count("*").alias("n"), F.sum(F.size(X.file_lines(F.col("content")))).alias("lines")).orderBy("x").collect()
    tools = dataset.groupBy("tool").count().orderBy("tool").collect()
    gold = E.keyed_spans(spans).where(F.col("grade") == S.DECISIVE).groupBy("ext").count().orderBy("ext").collect()
    return "\n".join([
        "## Setup\n",
        f"- Corpus: {sum(r['n'] for r in by_ext)} files, {sum(r['lines'] for r in by_ext)} lines (" + ", ".join(f"{r['x']} {r['n']} files, {r['lines']} lines" for r in by_ext) + ")",
        f"- Queries: {sum(r['count'] for r in tools)} (" + ", ".join(f"{r['tool']} {r['count']}" for r in tools) + ")",
        f"- Decisive spans: {sum(r['count'] for r in gold)} (" + ", ".join(f"{r['ext']} {r['count']}" for r in gold) + ")",
    ])


def build_report(results: DataFrame, spans: DataFrame, weights: DataFrame, chunks: DataFrame, labels: list[str], setup: str = "", k_values: tuple[int, ...] = S.EVAL_K) -> str:
    table = {r["metric"]: [r[c] or "" for c in labels] for r in pivoted(metric_rows(results, spans, weights, k_values), labels).collect()}
    of = lambda *ends: [[m, *table[m]] for m in sorted(table, key=lambda m: (m.split("@")[0], int(m.split("@")[1].split(" ")[0]), m)) if any(e(m) for e in ends)]
    rows = {r["label"]: r for r in E.geometry(chunks).collect()}
    shape = [[n, *[f.format(rows[c][key]) if c in rows else "0" for c in labels]] for n, key, f in (("chunks", "chunks", "{:d}"), ("mean lines", "mean_lines", "{:.1f}"), ("median lines", "median_lines", "{:.0f}"), ("max lines", "max_lines", "{:d}"))]
    parts = [
        "# Retrieval evaluation", setup, DEFINITIONS, "## Results\n",
        _table("coverage", labels, of(lambda m: m.startswith("coverage"))), "",
        _table("content-type", labels, of(lambda m: m.startswith(".") and " coverage" in m)), "",
        _table("concentration", labels, of(lambda m: m.startswith("concentration"))), "",
        _table("wholeness", labels, of(lambda m: m.startswith("overall"), lambda m: m.startswith(".") and " wholeness" in m)), "",
        _table("geometry", labels, shape), "",
    ]
    won = [r["k"] for r in E.canary(E.coverage(results, spans, weights, k_values), E.concentration(results, spans, weights, k_values)).orderBy("k").collect()]
    parts += [f"**WARNING (k={k})**: the whole-file baseline is best in coverage and in concentration; don't use this report." for k in won]
    return "\n".join([*parts, CAVEATS])


def run_matrix(spark: SparkSession, files: DataFrame, dataset: DataFrame, spans: DataFrame, weights: DataFrame, configs: list[RunConfig], config, store_root: str, provider, model=None, k_values: tuple[int, ...] = S.EVAL_K) -> str:
    """Index the corpus once for each configuration, into a collection of its own, and report on all of them; query vectors are made once."""
    from lodestone.operators.chunking import chunk_files
    from lodestone.plans.ingest import ingest_files
    from lodestone.sources.collection import Collection

    asked = [tuple(r) for r in dataset.select("query_id", "query", "tool").collect()]  # a labelled set is small
    vectors = provider.embed([q for _, q, _ in asked]) if asked else []
    queries = spark.createDataFrame([(i, q, t, list(map(float, v))) for (i, q, t), v in zip(asked, vectors)], "query_id string, query string, tool string, vector array<double>")
    results = chunks = None
    for run in configs:
        every = {r[0]: run.chunker for r in files.select("ext").distinct().collect()} if run.chunker != "ast" else None
        store = Collection(spark, store_root, f"{config.collection}_eval_{collection_name(run.label)}")
        ingest_files(files, config, store, provider, model if run.enrich else None, strategies=every)
        entries = chunk_files(files, config).entries
        found = E.retrieve(store.read(), queries, entries, max(k_values), run.label)
        own = store.read().select("start_line", "end_line", F.lit(run.label).alias("label"))
        results = found if results is None else results.unionByName(found)
        chunks = own if chunks is None else chunks.unionByName(own)
    return build_report(results, spans, weights, chunks, [c.label for c in configs], setup_summary(files, dataset, spans), k_values)
