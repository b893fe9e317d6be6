"""Files to a stored, searchable collection."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.config import ProjectConfig
from lodestone.operators.chunking import chunk_files
from lodestone.operators.embedding import EmbeddingProvider, HashProvider, embedded
from lodestone.operators.enrichment import Model, embedding_text, enrich
from lodestone.operators.search import search_ids
from lodestone.sources.collection import Collection, latest
from lodestone.sources.files import read_files, shared_folder, small_batches
from lodestone.sources.golden import save_index


def keeper(spark: SparkSession):
    """Writes a frame to the shared folder and reads it back, so that what is behind it runs once and lost executors do no harm."""
    base = shared_folder(spark)

    def keep(df: DataFrame, name: str) -> DataFrame:
        path = f"{base}/ingest/{name}-{uuid.uuid4().hex}"
        with small_batches(spark):
            df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return keep


def ingest_files(files: DataFrame, config: ProjectConfig, store: Collection, provider: EmbeddingProvider | None = None, model: Model | None = None, recreate: bool = True, strategies: dict[str, str] | None = None, index_path: str | None = None) -> dict[str, int]:
    """Chunk, index, enrich (if there is a model), embed and store ``files``; returns counts.

    ``recreate``: drop what was stored; else the content is brought in line with
    the files, which also removes sources that are gone. Files without chunks
    empty the collection and the index.
    """
    spark = files.sparkSession
    keep = keeper(spark)
    done = chunk_files(files, config, strategies, keep)
    chunks = keep(latest(search_ids(done.chunks)), "chunks")
    if model is not None:
        chunks = keep(enrich(chunks, model, keep), "enriched")
    points = embedded(chunks, embedding_text(), provider or HashProvider())
    counts = {f"{r[0]}_chunks": r[1] for r in chunks.groupBy("chunk_type").count().collect()}
    counts = {"markdown_chunks": 0, "code_chunks": 0, "plaintext_chunks": 0} | counts
    entries = keep(done.entries, "entries")
    if index_path:
        save_index(entries, index_path)
    if recreate:
        store.write(points)
        pruned = 0
    else:
        pruned = store.sync(points).agg(F.coalesce(F.sum("deleted"), F.lit(0))).first()[0]
    return counts | {"total_chunks": chunks.count(), "index_entries": entries.count(), "errors": done.errors.count(), "pruned_points": pruned}


def ingest(spark: SparkSession, config: ProjectConfig, provider: EmbeddingProvider | None = None, model: Model | None = None, recreate: bool = True) -> dict[str, int]:
    """The project's data folder into its collection and index."""
    files = read_files(spark, config.path("data_dir"), config.file_extensions)
    store = Collection(spark, config.path("store_dir"), config.collection)
    return ingest_files(files, config, store, provider, model, recreate, index_path=config.path("pointer_index"))
