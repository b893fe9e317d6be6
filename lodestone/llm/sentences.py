"""Operator 2: substring dedup by sliding sentence spans.

Every run of several consecutive sentences is hashed; runs are joined globally
on the hash, and sentences that a non-first repeated run covers are removed. A
run starts at each sentence and takes RUN sentences, and as many more as it
needs to hold LEAST_WORDS words. First is the smallest (doc_id, text hash,
offset). Sentences end at ``.``, ``!`` or ``?`` before white space, at a line
break, or after LONGEST words; case and outer punctuation of words don't count.

Passages without such runs (one long sentence, or none that ends) are found by
windows of PASSAGE words that start at sentences, end at them, or start at
anchors: words whose pair hash is the smallest of GAP neighbouring ones. A window
is used where no run lies in it. Runs and windows are told apart by key and
check, 95 bits of two polynomial hashes, one of them modulo a prime.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm import textnp
from lodestone.llm.common import beside_text, fields_of, stage
from lodestone.llm.exchange import NO_ID, Sent, blocks, deal_for, exchanged, first_of, keyed_texts

RUN, LEAST_WORDS, LONGEST = 3, 12, 40
#: Words of a window, and words that hold an anchor at least: PASSAGE + GAP - 1 repeated words hold a whole window.
PASSAGE, GAP = 40, 11
U = textnp.U
ENDS = np.zeros(256, bool)
ENDS[[ord(c) for c in ".!?"]] = True
LINES = np.zeros(256, bool)
LINES[[10, 11, 12, 13]] = True
#: The lowest bit of a key tells windows from runs.
ONE = U(1)


def anchors(h: np.ndarray) -> np.ndarray:
    """Whether a word's pair hash is the smallest of some GAP neighbouring ones (the last of equal ones)."""
    out = np.zeros(len(h), bool)
    if len(h) < GAP:
        return out
    pair = textnp.combine(h, np.append(h[1:], U(0)))
    rows = np.lib.stride_tricks.sliding_window_view(pair, GAP)
    out[np.arange(len(rows)) + GAP - 1 - rows[:, ::-1].argmin(1)] = True
    return out


def sentence_runs(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Document number, start, stop (bytes in the text), key and check of every run, then of every window.

    A text with words but too short for a full run is one run.
    """
    buf, bounds = textnp.joined(texts)
    at, h = textnp.words(buf, bare=True)
    none = np.zeros(0, np.int64)
    if not len(at):
        return none, none, none, none.astype(U), none.astype(U)
    doc = np.searchsorted(bounds, at, "right") - 1
    gap = np.append(textnp.SPACE[buf], True)
    edge = np.flatnonzero(~gap[:-1] & gap[1:]) + 1  # a word ends where white space follows
    lines = np.concatenate([[0], np.cumsum(LINES[buf])])
    last = np.ones(len(at), bool)
    last[:-1] = ENDS[buf[edge[:-1] - 1]] | (lines[at[1:]] > lines[edge[:-1]]) | (doc[1:] != doc[:-1])
    first = np.ones(len(at), bool)
    first[1:] = last[:-1]
    head = np.flatnonzero(first)
    since = np.arange(len(at)) - head[np.cumsum(first) - 1]
    first |= since % LONGEST == 0
    head = np.flatnonzero(first)  # first word of each sentence
    stop = np.append(head[1:], len(at))
    of = doc[head]
    doc_end = np.searchsorted(of, of, "right")  # sentence after the document's last
    doc_start = np.searchsorted(of, of, "left")
    i = np.arange(len(head))
    end = np.maximum(i + RUN, np.searchsorted(stop, head + LEAST_WORDS, "left") + 1)
    full = end <= doc_end
    whole = ~full & (i == doc_start)
    end = np.minimum(end, doc_end)
    # Ends of full runs don't decrease from sentence to sentence, so the first run after a word ends first.
    run_head, run_stop = head[full], stop[end[full] - 1]
    use = full | whole
    i, end = i[use], end[use]
    sums = textnp.Sums(h)
    a, b = head[i], stop[end - 1]
    key, check = sums.pair(a, b)
    key &= ~ONE
    begin = anchors(h)
    begin[head] = True
    ends = stop - PASSAGE
    begin[ends[ends >= 0]] = True
    begin = np.flatnonzero(begin)
    begin = begin[begin + PASSAGE <= len(at)]
    begin = begin[doc[begin] == doc[begin + PASSAGE - 1]]
    nearest = np.append(run_stop, len(at) + 1)[np.searchsorted(run_head, begin, "left")]
    begin = begin[nearest > begin + PASSAGE]
    i = np.concatenate([i, np.searchsorted(head, begin, "right") - 1])
    a, b = np.concatenate([a, begin]), np.concatenate([b, begin + PASSAGE])
    more, more_check = sums.pair(begin, begin + PASSAGE)
    key, check = np.concatenate([key, more | ONE]), np.concatenate([check, more_check])
    d = of[i]
    return d, at[a] - bounds[d], edge[b - 1] - bounds[d], key, check


def apart(key: np.ndarray, start: np.ndarray, first: np.ndarray, first_stop: np.ndarray) -> np.ndarray:
    """Whether a place in the text of the first is another one; windows must not overlap it."""
    return np.where((key & ONE).astype(bool), start >= first_stop, start != first)


LAYOUT = Sent(6, {"_doc": "long", "_th": "long", "start": "long", "stop": "long", "_first": "long"})


def fold(columns: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Of entries (key, check, document, text hash, start, size): the repeats of the first of each key, and what is left.

    Windows that overlap the first in its own text are left: they may repeat one elsewhere.
    """
    key, check, doc, th, start, size = columns
    order, head = first_of((key, check, doc, th, start), 2)
    lead = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
    i = order
    again = ~head & ((doc[i] != doc[lead]) | (th[i] != th[lead]) | apart(key[i], start[i], start[lead], start[lead] + size[lead]))
    same = ~head & (doc[i] == doc[lead]) & (th[i] == th[lead]) & (start[i] == start[lead])
    j, first = i[again], lead[again]
    left = i[~again & ~same]
    return [doc[j], th[j], start[j], start[j] + size[j], doc[first]], [c[left] for c in columns]


def repeated_runs(docs: DataFrame) -> DataFrame:
    """``_doc, _th, start, stop, _first``: each non-first run and the id of an earlier document (or the same) that has it."""
    deal = deal_for(docs)

    def send(batches):
        for rows in blocks(batches):
            ids = np.array([r[0] for r in rows], np.int64)
            hashes = np.array([r[1] for r in rows], np.int64)
            found = []
            for lo, hi in textnp.groups([len(r[2] or b"") for r in rows], 1 << 20):
                d, start, stop, key, check = sentence_runs([r[2] for r in rows[lo:hi]])
                found.append((key, check, d + lo, start.astype(np.int64), (stop - start).astype(np.int64)))
            key, check, d, start, size = (np.concatenate(x) for x in zip(*found))
            settled, left = fold([key, check, ids[d], hashes[d], start, size])
            yield LAYOUT.rows(settled)
            yield LAYOUT.split(left, deal.parts[0])

    return exchanged(keyed_texts(docs).mapInArrow(send, LAYOUT.schema), LAYOUT, deal, fold)


def removed_spans(docs: DataFrame) -> DataFrame:
    """Maximal removed stretches: ``_doc, _th, start, stop, first_doc_id``, by bytes of the UTF-8 text.

    Defined cases: null, empty and word-less texts have none; a row's copies (equal
    id and text) are one document; null ids are NO_ID and come first; of equal
    runs that of the smallest document and offset stays; no rows give no rows.
    """
    runs = stage(repeated_runs(docs), "sentence-runs")
    w = Window.partitionBy("_doc", "_th").orderBy("start", "stop")
    reach = F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("start") < F.col("_reach"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    runs = runs.withColumn("_reach", reach).withColumn("_island", island)
    return runs.groupBy("_doc", "_th", "_island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.min("_first").alias("first_doc_id")).drop("_island")


def remove_repeated_sentences(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated sentences cut out of ``text``; other columns as they are.

    Defined cases: null, empty and word-less texts stay as they are; rows with
    equal id and text are one document, so they don't repeat each other and are
    treated alike; null ids come before all others; very long texts are hashed
    piecewise; white space around a removed stretch stays.
    """
    t, h, r = "_t_doc", "_t_th", "_runs"
    spans = removed_spans(docs).groupBy(F.col("_doc").alias(t), F.col("_th").alias(h)).agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias(r))
    keyed = beside_text(docs, _k_doc=F.coalesce(F.col("doc_id"), F.lit(NO_ID)).cast("long"), _k_th=F.xxhash64("text"))
    out = keyed.join(spans, (F.col("_k_doc") == F.col(t)) & (F.col("_k_th") == F.col(h)), "left")
    raw = F.col("text").cast("binary")
    kept = F.aggregate(
        F.col(r), F.struct(F.lit(b"").cast("binary").alias("out"), F.lit(0).cast("long").alias("at")),
        lambda a, s: F.struct(F.concat(a["out"], F.substring(raw, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int"))).alias("out"), s["stop"].alias("at")),
        lambda a: F.concat(a["out"], F.substring(raw, (a["at"] + 1).cast("int"), F.lit(2147483647))),
    )
    return out.select(*fields_of(docs.columns, text=F.when(F.col(r).isNull(), F.col("text")).otherwise(kept.cast("string"))))


def op2_query(spark, sf_dir: str) -> DataFrame:
    """Removed stretches of all documents; the cases are those of ``removed_spans``, a null id is given as null."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return removed_spans(docs).select(
        F.when(F.col("_doc") != NO_ID, F.col("_doc")).alias("doc_id"), F.when(F.col("first_doc_id") != NO_ID, F.col("first_doc_id")).alias("first_doc_id"),
        F.col("start").alias("start_byte"), F.col("stop").alias("stop_byte"),
    )
