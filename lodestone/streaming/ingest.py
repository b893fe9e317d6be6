"""Continuous ingest: new and changed files of a folder, a micro-batch at a time.

Beyond the batch contract: each batch replaces the stored chunks of the sources
that it holds and leaves others alone. A batch that is run again after a failure
gives the same content, since points are replaced by source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone import schemas as S
from lodestone.config import ProjectConfig
from lodestone.operators.chunking import chunk_files
from lodestone.operators.embedding import EmbeddingProvider, HashProvider, embedded
from lodestone.operators.enrichment import embedding_text
from lodestone.operators.search import search_ids
from lodestone.plans.ingest import keeper
from lodestone.sources.collection import Collection, latest


def replace_sources(files: DataFrame, config: ProjectConfig, store: Collection, provider: EmbeddingProvider) -> None:
    keep = keeper(files.sparkSession)
    points = keep(embedded(latest(search_ids(chunk_files(files, config).chunks)), embedding_text(), provider), "batch")
    paths = files.select("source_path").distinct()
    store.ensure()
    store.replace_sources(paths, points)


def start(spark: SparkSession, folder: str, config: ProjectConfig, store: Collection, checkpoint: str, provider: EmbeddingProvider | None = None, once: bool = False) -> StreamingQuery:
    """Follow a folder of Parquet files with the columns of ``schemas.FILE``. Of a source's versions in one batch the last written counts."""
    stream = spark.readStream.schema(S.FILE).parquet(folder).withColumn("_at", F.col("_metadata.file_modification_time"))

    def batch(df: DataFrame, number: int) -> None:
        cols = [c for c in df.columns if c != "_at"]
        last = df.groupBy("source_path").agg(F.max_by(F.struct(*cols), F.struct("_at", "content")).alias("f")).select("f.*")
        replace_sources(last, config, store, provider or HashProvider())

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
