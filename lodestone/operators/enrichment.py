"""Enrichment of chunks by a language model: eligibility, batches, prompts, validated answers, retries, fallback."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone import schemas as S
from lodestone.functions import text as X

INSTRUCTIONS = (
    "Describe passages of a code and document collection for a search index.\n"
    "Answer with one JSON object and nothing else. Its only key is \"chunks\", a list with one object for each passage.\n"
    "Each object has \"id\" (the passage's number), \"summary\" (one or two plain sentences) and\n"
    "\"hypothetical_questions\" (one to five questions that the passage answers). Leave no passage out."
)
CHUNK_MARK = "--- CHUNK "
Model = Callable[[list[dict]], str]
LEAST_GROUPS, CHUNKS_A_GROUP = 64, 100_000
#: Prompts that a worker holds as Python values.
PROMPTS_AT_ONCE = 100


def eligible(chunks: DataFrame) -> DataFrame:
    return chunks.where(F.col("end_line") - F.col("start_line") + 1 >= S.ENRICH_LEAST_LINES)


def batched(chunks: DataFrame, order: list[str], size: int = S.ENRICH_BATCH, spread: int | None = None) -> DataFrame:
    """``chunks`` with batch (text) and id (1 to ``size``).

    Files are dealt over ``spread`` groups by the MD5 of their path, and batches
    are cut in order inside a group, so no task numbers the whole corpus. By
    default there is a group for every CHUNKS_A_GROUP chunks, LEAST_GROUPS at least.
    """
    spread = spread or max(LEAST_GROUPS, -(-chunks.count() // CHUNKS_A_GROUP))
    group = F.pmod(F.conv(F.substring(F.md5(F.coalesce("source_path", "file_name").cast("binary")), 1, 12), 16, 10).cast("long"), F.lit(spread))
    n = F.row_number().over(Window.partitionBy("_g").orderBy(*order)) - 1
    rows = chunks.withColumn("_g", group).withColumn("_n", n)
    batch = F.concat_ws("-", F.col("_g").cast("string"), F.floor(F.col("_n") / size).cast("string"))
    return rows.withColumns({"batch": batch, "id": (F.col("_n") % size + 1).cast("int")}).drop("_g", "_n")


def prompt_part() -> Column:
    language = F.when(F.coalesce("language", F.lit("")) != "", F.concat(F.lit(" ("), F.col("language"), F.lit(")"))).otherwise("")
    return F.concat(
        F.lit(CHUNK_MARK), F.col("id").cast("string"), F.lit(" ---\nType: "), F.col("chunk_type"), F.lit("\nFile: "), F.col("file_name"), language,
        F.lit("\nLines: "), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"), F.lit("\n\n"), F.substring("text", 1, S.PROMPT_CHARS),
    )


def prompts(batches: DataFrame) -> DataFrame:
    """batch, n, prompt: a batch holds at most its size of cut texts."""
    parts = F.transform(F.sort_array(F.collect_list(F.struct("id", prompt_part().alias("p")))), lambda x: x["p"])
    grouped = batches.groupBy("batch").agg(F.count("*").cast("int").alias("n"), F.array_join(parts, "\n\n").alias("_p"))
    return grouped.select("batch", "n", F.concat(F.lit("Passages: "), F.col("n").cast("string"), F.lit("\n\n"), F.col("_p")).alias("prompt"))


def parsed(content: Column, n: Column) -> Column:
    """(items, error) of an answer: the JSON object in it, its items by id; exactly the ids 1 to n, each with a summary and 1 to 5 questions."""

    def read(c: Column) -> Column:
        return F.from_json(F.when(F.regexp_like(c, F.lit(r"(?s)\A\s*\{.*\}\s*\z")), c), F.lit(S.ENRICHMENT))

    def good(x: Column) -> Column:
        q = lambda i: i["hypothetical_questions"]
        whole = lambda i: i["id"].isNotNull() & (F.coalesce(X.strip(i["summary"]), F.lit("")) != "") & (F.size(F.coalesce(q(i), F.array().cast("array<string>"))).between(1, 5)) & ~F.exists(q(i), lambda s: s.isNull())
        return F.coalesce(x["chunks"].isNotNull() & F.forall(x["chunks"], whole), F.lit(False))

    inner = F.regexp_extract(content, r"(?s)(\{.*\})", 1)

    def verdict(pair: Column) -> Column:
        x = F.when(good(pair["a"]), pair["a"]).when(good(pair["b"]), pair["b"])
        items = F.transform(F.array_sort(x["chunks"]), lambda i: F.struct(i["id"].alias("id"), X.strip(i["summary"]).alias("summary"), i["hypothetical_questions"].alias("hypothetical_questions")))
        ids = F.transform(items, lambda i: i["id"])
        error = (
            F.when(x.isNull(), F.concat(F.lit("Could not parse JSON from response: "), F.substring(content, 1, 200)))
            .when(F.size(items) != n, F.concat(F.lit("Expected "), n.cast("string"), F.lit(" chunks but got "), F.size(items).cast("string")))
            .when(ids != F.sequence(F.lit(1), n), F.concat(F.lit("Chunk ids did not match 1.."), n.cast("string")))
        )
        return F.struct(F.when(error.isNull(), items).alias("items"), error.alias("error"))

    return X.let(F.struct(read(content).alias("a"), read(F.when(inner != "", inner)).alias("b")), verdict)


def ask(questions: DataFrame, model: Model, feedback: bool = False) -> DataFrame:
    """batch, n, prompt, content: the model's answers. A failed call gives a null content, and the batch isn't asked again."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, PROMPTS_AT_ONCE):
                b = whole.slice(at, PROMPTS_AT_ONCE)
                out = []
                for f in b.to_pylist():
                    messages = [{"role": "system", "content": INSTRUCTIONS}, {"role": "user", "content": f["prompt"]}]
                    if feedback:
                        again = f"Your last answer could not be used. Error: {f['error']}\nAnswer again with the JSON object only."
                        messages += [{"role": "assistant", "content": f["content"]}, {"role": "user", "content": again}]
                    try:
                        out.append(model(messages))
                    except Exception:  # any failure of the provider
                        out.append(None)
                # the prompts go back as they came, without a copy
                yield pa.record_batch([b.column("batch"), b.column("n"), b.column("prompt"), pa.array(out, pa.string())], ["batch", "n", "prompt", "content"])

    return questions.mapInArrow(run, "batch string, n int, prompt string, content string")


def answers(questions: DataFrame, model: Model, retries: int, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """batch, items (null if all tries failed): each try's failures are asked again with the error. ``keep`` writes a frame and reads it back, so the model is called once for each try."""
    done, open_ = None, questions
    for n in range(retries + 1):
        tried = keep(ask(open_, model, n > 0), f"answers-{n}").withColumn("_r", parsed(F.coalesce("content", F.lit("")), F.col("n")))
        failed = F.col("content").isNull() | F.col("_r.items").isNotNull() | F.lit(n == retries)
        closed = tried.where(failed).select("batch", F.when(F.col("content").isNotNull(), F.col("_r.items")).alias("items"))
        done = closed if done is None else done.unionByName(closed)
        open_ = tried.where(~failed).select("batch", "n", "prompt", "content", F.col("_r.error").alias("error"))
    return done


def enrich(chunks: DataFrame, model: Model, keep: Callable[[DataFrame, str], DataFrame], size: int = S.ENRICH_BATCH, key: str = "point_id") -> DataFrame:
    """``chunks`` (with a unique ``key``) with summary and hypothetical_questions where the model gave valid ones.

    Batches get three tries; the chunks of a failed batch get two on their own.
    Short chunks are left as they are.
    """
    order = ["source_path", "start_line", "end_line", key]
    dealt = keep(batched(eligible(chunks), order, size), "batches")
    first = keep(answers(prompts(dealt), model, 2, keep), "batch-answers")
    lost = dealt.join(first.where("items is null").select("batch"), "batch", "left_semi")
    alone = lost.withColumns({"batch": F.col(key), "id": F.lit(1)})
    second = answers(prompts(alone), model, 1, keep)
    rows = lambda a, d: a.where("items is not null").select("batch", F.explode("items").alias("i")).select("batch", "i.*").join(d.select("batch", "id", F.col(key).alias("_key")), ["batch", "id"])
    found = rows(first, dealt).unionByName(rows(second, alone)).select("_key", F.col("summary").alias("_s"), F.col("hypothetical_questions").alias("_q"))
    out = chunks.join(found, F.col(key) == F.col("_key"), "left")
    new = {"summary": F.coalesce("_s", "summary"), "hypothetical_questions": F.coalesce("_q", "hypothetical_questions")}
    return out.select(*[new.get(c, F.col(c)).alias(c) for c in chunks.columns])


def canned_model(messages: list[dict]) -> str:
    """A well-formed answer for as many passages as the prompt marks; stands in for a provider in tests."""
    import json

    n = messages[-1]["content"].count(CHUNK_MARK) or 1
    return json.dumps({"chunks": [{"id": i, "summary": f"Summary of passage {i}.", "hypothetical_questions": [f"What is passage {i} about?"]} for i in range(1, n + 1)]})


def embedding_text() -> Column:
    """Text, summary and questions of a chunk, parted by blank lines; absent parts are left out."""
    summary = F.when(F.coalesce("summary", F.lit("")) != "", F.concat(F.lit("Summary: "), F.col("summary")))
    questions = F.when(F.size(F.coalesce("hypothetical_questions", F.array().cast("array<string>"))) > 0, F.concat(F.lit("Questions this answers: "), F.array_join("hypothetical_questions", " | ")))
    return F.concat_ws("\n\n", "text", summary, questions)
