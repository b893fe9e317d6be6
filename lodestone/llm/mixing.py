"""Operator 7: mixing sources to target weights, native DataFrame operations only.

Documents get a hash-random key; within each source they are ordered by it in
fixed slices of the key space (the key is uniform, so the slices are even), a
distributed prefix sum of sizes runs over slices and inside them, and each
source is cut at its exact budget. Budgets over one epoch repeat the source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import WORD, beside_text, boxed, fields_of, n_words, stage

#: Slices of the hash-key space in each source (three hex digits); a hot source is spread over all of them.
SLICE_DIGITS = 3


def source_targets(sizes: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most_epochs: int = 2) -> DataFrame:
    """Targets of each source: columns source, source_size, target.

    ``sizes`` has columns source and size (of documents, or of any parts of sources). Sources in
    code-point order, null last, get the weights in turn and share ``share``
    times all sizes; a target stops at ``most_epochs`` times its source's size
    and the excess is reshared by weight until none is above. That fixed point
    is found in closed form: with sources ordered by cap over weight, those
    before the first whose cap exceeds its share of what is left are capped.
    The windows here hold one row for each source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    i = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source"))) - 1
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (i % len(weights) + 1).cast("int"))
    ranked = per.withColumn("_w", w.cast("double")).withColumn("_cap", (F.col("source_size") * most_epochs).cast("double"))
    every = Window.partitionBy()
    by_ratio = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").isNull(), F.col("source"))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    left = F.lit(share) * F.sum("source_size").over(every) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    ranked = ranked.withColumn("_level", left / F.sum("_w").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    ranked = ranked.withColumn("_free", F.col("_cap") / F.col("_w") > F.col("_level"))
    level = F.min(F.when(F.col("_free"), F.struct((F.col("_cap") / F.col("_w")).alias("r"), F.col("_level").alias("l")))).over(every)["l"]
    first = F.min(F.when(F.col("_free"), F.col("_cap") / F.col("_w"))).over(every)
    target = F.when(first.isNull() | (F.col("_cap") / F.col("_w") < first), F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("_w") * level))
    return ranked.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, size: Column, id_column: str = "doc_id", seed: str = "mix", **targets) -> DataFrame:
    """``docs`` with size, source_size, target and taken (words the mix takes, repeats counted).

    The order within a source is md5(seed:id), then the id, then a hash of the
    row. Every source's ``taken`` adds up to its target rounded to a whole word;
    whole epochs take every document and the last one is cut inside the document
    that crosses the budget. Defined cases: null ids, sources and texts are
    values like others (a null text has size 0 and is taken 0 times); repeated
    rows count each; existing columns named like new ones are replaced; no rows
    give no rows.
    """
    key, part, before, s = "_key", "_slice", "_before", "_s"
    fields = [c for c in docs.columns if c.lower() not in ("size", "source_size", "target", "taken")]
    own = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit("null"))).cast("binary"))
    keyed = boxed(docs, fields, source=F.col("source"), size=size, _id=F.col(id_column), _key=own, _slice=F.substring(own, 1, SLICE_DIGITS), _tie=F.xxhash64(*[F.col(f"`{c}`") for c in fields]))
    slices = stage(keyed.groupBy("source", part).agg(F.sum("size").alias("_slice_size")), "mix-slices")  # sizes are counted once for both
    wanted = source_targets(slices.select("source", F.col("_slice_size").alias("size")), **targets)
    by_slice = Window.partitionBy("source").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    base = slices.withColumn(before, F.coalesce(F.sum("_slice_size").over(by_slice), F.lit(0)))
    w = wanted.select(F.col("source").alias(s), "source_size", "target")
    base = base.join(w, base["source"].eqNullSafe(w[s])).select(F.col("source").alias(s), F.col(part).alias("_p"), F.col(before).alias("_base"), "source_size", "target")
    inside = Window.partitionBy("source", part).orderBy(key, "_id", "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = keyed.withColumn(before, F.sum("size").over(inside) - F.col("size"))
    out = run.join(base, run["source"].eqNullSafe(base[s]) & (run[part] == base["_p"]))
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") == 0, F.lit(0)).otherwise(F.expr("cast(round(target) as bigint) div nullif(source_size, 0)"))
    rest = budget - epochs * F.col("source_size")
    last = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("_base") - F.col(before)))
    return out.select(*fields_of(fields), "size", "source_size", "target", (epochs * F.col("size") + last).cast("long").alias("taken"))


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: columns of ``docs``, a row for each epoch in which a document is taken.

    The document that crosses its source's budget is cut after the words that
    are left. Documents with no words are taken zero times, so they go.
    """
    packed = beside_text(docs, source=F.col("source"), doc_id=F.col("doc_id"))
    mixed = mix(packed, n_words(F.col("text")), **options)
    full = F.col("taken") / F.col("size")
    rows = mixed.where(F.col("taken") > 0).withColumn("_epoch", F.explode(F.sequence(F.lit(1), F.ceil(full).cast("int"))))
    left = F.col("taken") - (F.col("_epoch") - 1) * F.col("size")
    cut = F.array_join(F.slice(F.regexp_extract_all(F.col("text"), F.lit(f"({WORD})"), 1), 1, left.cast("int")), " ")
    rows = rows.withColumn("_new", F.when(left < F.col("size"), cut))  # null where the whole text is taken
    changed = {"text": F.coalesce("_new", "text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.coalesce(F.char_length("_new"), F.col("_row")["n_chars"]).cast(dict(docs.dtypes)["n_chars"])
    return rows.select(*fields_of(docs.columns, **changed))


def op7_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sized = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"))
    return mix(stage(sized, "mix-sizes"), F.col("size")).select("doc_id", "size", "source_size", "target", "taken")


OP7_SQL = r"""
with d as (
  select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size,
         md5('mix:' || coalesce(cast(doc_id as varchar), 'null')) as k
  from documents),
p as (select source, cast(sum(size) as bigint) as source_size from d group by 1),
r as (
  select source, source_size, cast(source_size * 2 as double) as cap,
         case (row_number() over (order by source is null, source) - 1) % 3 when 0 then 3e0 when 1 then 1e0 else 2e0 end as w
  from p),
l as (
  select *, cap / w as ratio,
         (1.5e0 * cast(sum(source_size) over () as double) - coalesce(sum(cap) over (order by cap / w, source is null, source rows between unbounded preceding and 1 preceding), 0e0))
         / sum(w) over (order by cap / w, source is null, source rows between current row and unbounded following) as level
  from r),
f as (select min(ratio) as first_ratio, arg_min(level, ratio) as first_level from l where ratio > level),
t as (
  select source, source_size,
         case when first_ratio is null or ratio < first_ratio then cap else least(cap, w * first_level) end as target
  from l, f),
c as (
  select d.doc_id, d.size, t.source_size, t.target, cast(round(t.target) as bigint) as budget,
         sum(d.size) over (partition by d.source order by d.k, d.doc_id rows between unbounded preceding and current row) - d.size as before
  from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target,
       cast(case when source_size = 0 then 0 else (budget // source_size) * size end
            + greatest(0, least(size, budget - (case when source_size = 0 then 0 else budget // source_size end) * source_size - before)) as bigint) as taken
from c
"""
