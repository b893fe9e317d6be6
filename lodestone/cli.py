"""Commands: init, ingest, search, lookup, serve, eval."""

from __future__ import annotations

import argparse
import json
import os
from dataclasses import replace
from pathlib import Path

from lodestone import schemas as S
from lodestone.config import CONFIG_FILE, PREFIX, collection_name, load_config

API_KEY = f"{PREFIX}API_KEY"


def init(folder: str) -> list[str]:
    """Settings, data folder, ignore list and .env template; what is there stays. Returns what was made."""
    root = Path(folder)
    name = root.resolve().name
    settings = {"name": name, "collection": collection_name(name), "description": "", "key_terms": [], "file_extensions": [".md"]}
    wanted = {CONFIG_FILE: json.dumps(settings, indent=2) + "\n", ".env": f"# {PREFIX}FILE_EXTENSIONS=.md,.py\n", ".gitignore": ".env\ncollections/\n"}
    made = []
    (root / "data").mkdir(parents=True, exist_ok=True)
    for file, text in wanted.items():
        if not (root / file).exists():
            (root / file).write_text(text)
            made.append(file)
    if registered(root / ".mcp.json", str(root.resolve())):
        made.append(".mcp.json")
    return made


def registered(path: Path, project: str) -> bool:
    """Enter the tool server into a registration file, beside what is there. False if it was there already."""
    known = json.loads(path.read_text()) if path.exists() else {}
    servers = known.setdefault("mcpServers", {})
    if "lodestone" in servers:
        return False
    servers["lodestone"] = {"command": "python", "args": ["-m", "lodestone", "serve", "--project-dir", project]}
    path.write_text(json.dumps(known, indent=2) + "\n")
    return True


def services(a: argparse.Namespace, config) -> tuple:
    """Embedding provider and enrichment model (or none) as the arguments and settings say."""
    from lodestone.operators.embedding import HashProvider
    from lodestone.operators.providers import ChatService, EmbeddingService

    key, url = os.environ.get(API_KEY, ""), getattr(a, "service_url", None)
    named = getattr(a, "embedding_model", None)
    provider = EmbeddingService(key, named, url, dimension=a.dimension) if named and url else HashProvider(a.dimension)
    model = getattr(a, "enrichment_model", None) or config.enrichment_model
    wanted = getattr(a, "enrich", False) or config.enrich_chunks
    if wanted and not (model and url):
        raise SystemExit("enrichment needs --service-url and a model")
    return provider, ChatService(key, model, url, options={"response_format": {"type": "json_object"}}) if wanted else None


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lodestone")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("init", "ingest", "search", "lookup", "serve", "eval"):
        c = sub.add_parser(name)
        c.add_argument("--project-dir")
        c.add_argument("--dimension", type=int, default=256)
        if name == "ingest":
            c.add_argument("--no-recreate", action="store_true")
            c.add_argument("--min-chunk-lines", type=int)
            c.add_argument("--max-chunk-lines", type=int)
            c.add_argument("--enrich", action="store_true")
            c.add_argument("--enrichment-model")
        if name in ("ingest", "search", "serve", "eval"):
            c.add_argument("--service-url", help="base URL of an HTTP model service; its key is in " + API_KEY)
            c.add_argument("--embedding-model", help="embed by this model of the service, else by hashes")
        if name in ("search", "lookup"):
            c.add_argument("query")
            c.add_argument("--top-k", type=int, default=S.TOP_K)
            c.add_argument("--language")
            c.add_argument("--min-math-density", type=float)
            c.add_argument("--code", action="store_true")
        if name == "eval":
            c.add_argument("--dataset", required=True)
            c.add_argument("--top-k", default=",".join(map(str, S.EVAL_K)))
            c.add_argument("--chunkers", default="ast,line-based,whole-file")
            c.add_argument("--report-md")
    return p


def main(argv: list[str] | None = None) -> int:
    a = _parser().parse_args(argv)
    if a.command == "init":
        print("\n".join(init(a.project_dir or ".")))
        return 0
    from pyspark.sql import SparkSession

    from lodestone.operators.search import Retriever
    from lodestone.plans import ingest, report
    from lodestone.sources import files, golden
    from lodestone.sources.collection import Collection

    spark = SparkSession.builder.appName("lodestone").getOrCreate()
    config = load_config(a.project_dir)
    provider, model = services(a, config)
    if a.command == "ingest":
        given = {k: v for k in ("min_chunk_lines", "max_chunk_lines") if (v := getattr(a, k)) is not None}
        print(json.dumps(ingest.ingest(spark, replace(config, **given), provider, model, recreate=not a.no_recreate)))
    elif a.command == "eval":
        rows = files.read_files(spark, config.path("data_dir"), config.file_extensions)
        dataset = golden.load_dataset(spark, a.dataset)
        labels = {"ast": "ast", "line-based": f"line-{S.WINDOW_LINES}", "whole-file": S.CANARY}
        runs = [report.RunConfig(labels[c], c) for c in a.chunkers.split(",")]
        text = report.run_matrix(spark, rows, dataset, golden.gold_spans(dataset), golden.line_weights(rows), runs, config, config.path("store_dir"), provider, k_values=tuple(int(k) for k in a.top_k.split(",")))
        if a.report_md:
            Path(a.report_md).write_text(text)
        print(text)
    else:
        points = Collection(spark, config.path("store_dir"), config.collection).read()
        tools = Retriever(points, golden.load_index(spark, config.path("pointer_index")), provider)
        if a.command == "serve":
            from lodestone.server import serve

            serve(tools)
        elif a.command == "lookup":
            print(tools.lookup_index(a.query))
        else:
            print(tools.search_code(a.query, a.language, a.top_k) if a.code else tools.search_documents(a.query, a.top_k, a.min_math_density))
    return 0
