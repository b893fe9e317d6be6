from collections import Counter

import corpus_pipeline
from lodestone.llm import decontam, mixing, neardup, sharding, toxicity
from tests.llm.helpers import corpus, frame, words
from tests.llm.test_neardup import brute as near_groups


def test_stage_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "mixing", "sharding"]


def test_stages_take_effect_and_keep_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("labels", "benchmark"))
    ids = lambda df: {r[0] for r in df.select("doc_id").collect()}
    model = toxicity.fit(docs, labels)
    civil = corpus_pipeline.keep_civil(spark, docs, sf_dir)
    assert civil.columns == docs.columns and ids(civil) == ids(toxicity.score_documents(docs, model).where("predicted = 0"))
    one = corpus_pipeline.keep_distinct(spark, civil, sf_dir)
    groups = near_groups([tuple(r) for r in civil.select("doc_id", "text").collect()], 5)
    assert one.columns == docs.columns and ids(one) == {i for i, r in groups.items() if i == r}
    clean = corpus_pipeline.keep_unleaked(spark, one, sf_dir)
    bad = {r["_doc"] for r in decontam.leaks(one, bench).collect()}
    assert clean.columns == docs.columns and ids(clean) == ids(one) - bad
    mixed = corpus_pipeline.mix_sources(spark, clean, sf_dir)
    taken = Counter()
    for r in mixing.mix(clean, mixing.n_words(clean["text"])).collect():
        taken[r["doc_id"]] += r["taken"]
    have = Counter()
    for r in mixed.collect():
        have[r["doc_id"]] += len(words(r["text"]))
    assert mixed.columns == docs.columns and have == +taken
    dealt = corpus_pipeline.deal_shards(spark, mixed, sf_dir)
    assert {"size", "shard", "slot"} <= set(dealt.columns) and dealt.count() == mixed.count()


def test_run_is_the_stages_one_after_the_other(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir).toPandas()
    step = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, f in corpus_pipeline.STAGES[:-1]:
        step = f(spark, step, sf_dir)
    want = sharding.shard_documents(step).toPandas()
    assert sorted(map(str, out.sort_index(axis=1).values.tolist())) == sorted(map(str, want.sort_index(axis=1).values.tolist()))


def test_stages_take_odd_tables(spark, sf_dir):
    for rows in (corpus(), []):
        docs = frame(spark, rows)
        for _, f in corpus_pipeline.STAGES:
            docs = f(spark, docs, sf_dir)
        assert docs.count() > 0 if rows else docs.count() == 0
    assert neardup.SHINGLE == 5


def test_operators_put_the_session_back(spark, sf_dir):
    from lodestone.llm import queries

    keys = [k for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.checkpoint.dir")]
    before = {k: spark.conf.get(k, None) for k in keys}
    for query in queries.queries().values():
        query(spark, sf_dir)
    assert {k: spark.conf.get(k, None) for k in keys} == before
