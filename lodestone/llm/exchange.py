"""Keyed exchange of packed arrays between Python workers, folded level by level.

A block of texts becomes a few rows, one for each partition of the key space,
whose binary columns hold whole arrays. That moves a fraction of the bytes that
a row for each key would need, and lets workers fold equal keys inside a block
before anything is shuffled.

A block is dealt over FAN partitions at most, whatever the corpus. Where more
are needed, the cells of a partition are taken up again, some of them at a time
(a salt deals them over tasks), folded and dealt over the partitions inside it.
So the number of rows grows with the corpus and not with its square, a task holds
a bounded part, and a key that a third of all rows share is folded once in every
block, once for every FAN blocks, and so on.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text that a worker takes as one block; a longer text is a block of its own.
BLOCK = 8 << 20
#: Rows of a block at most, however short their texts are.
MOST_ROWS = 1 << 20
#: Partitions over which a block, or what is taken up again of a partition, is dealt.
FAN = 512
#: Packed bytes that are taken up again at once.
AGAIN = 8 << 20
NO_ID = -(1 << 63)
U = np.uint64


@dataclass(frozen=True)
class Deal:
    """Numbers of partitions, level by level, and the blocks of text that there are."""

    parts: tuple[int, ...]
    blocks: int

    @classmethod
    def of(cls, total: int, per: int, least: int) -> Deal:
        """For ``total`` bytes of text, at most ``per`` of them for a partition of the last level."""
        wanted = max(least, math.ceil(total / per))
        depth = 1
        while FAN**depth < wanted:
            depth += 1
        step = wanted if depth == 1 else math.ceil(wanted ** (1 / depth))
        return cls(tuple(step ** (i + 1) for i in range(depth)), math.ceil(total / BLOCK))


def deal_for(docs: DataFrame, per: int = 16 << 20, least: int = 48) -> Deal:
    """Partitions of the key space for a corpus, in proportion to its bytes."""
    return Deal.of(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0, per, least)


def pack(a: np.ndarray, level: int = 1) -> bytes:
    """Bytes of an array, transposed so that equal high bytes stand together, and compressed."""
    raw = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() if len(a) else b""
    return zstandard.ZstdCompressor(level=level).compress(np.dtype(a.dtype).char.encode() + raw)


def unpack(b: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(b)
    kind = np.dtype(raw[:1].decode())
    n = (len(raw) - 1) // kind.itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, offset=1).reshape(kind.itemsize, n).T).reshape(-1).view(kind)


def ragged(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches [start, start + size) of ``flat``, one after the other."""
    ends = np.cumsum(size)
    if not len(size):
        return flat[:0]
    return flat[np.arange(ends[-1]) + np.repeat(start - (ends - size), size)]


class Sent:
    """Layout of what is exchanged: rows of packed columns.

    ``entries``: number of columns of entries, the first of which holds the uint64
    keys; these rows bear the partition of their keys. ``flat``: names and types of
    the columns of what is settled already; these rows bear part -1. ``sized_by``:
    number of the column that gives the sizes of the stretches of bytes in the
    last column of the entries. ``key``: gives the keys where no column holds them.
    """

    def __init__(self, entries: int, flat: dict[str, str], sized_by: int | None = None, key: Callable | None = None):
        self.n, self.flat, self.sized_by = entries, flat, sized_by
        self.key = key or (lambda columns: columns[0])
        self.columns = [f"c{i}" for i in range(max(entries, len(flat)))]
        self.schema = ", ".join(["part int", *[f"{c} binary" for c in self.columns]])
        self.found = ", ".join(f"{k} {t}" for k, t in flat.items())
        self.types = [{"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}[t] for t in flat.values()]

    def _batch(self, parts, packed: list[list[bytes]]) -> pa.RecordBatch:
        m = len(parts)
        empty = [pa.nulls(m, pa.binary())] * (len(self.columns) - len(packed))
        return pa.record_batch([pa.array(parts, pa.int32()), *[pa.array(c, pa.binary()) for c in packed], *empty], ["part", *self.columns])

    def rows(self, columns: list[np.ndarray]) -> pa.RecordBatch:
        """A packed row of what is settled; none if there is nothing."""
        if not len(columns[0]):
            return self._batch([], [[] for _ in columns])
        return self._batch([-1], [[pack(np.asarray(c))] for c in columns])

    def split(self, columns: list[np.ndarray], parts: int) -> pa.RecordBatch:
        """A packed row for each part of the keys (high bits decide) that has any."""
        part = ((self.key(columns) >> U(32)) * U(parts) >> U(32)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        used, first = np.unique(part[order], return_index=True)
        cut = np.append(first, len(order))
        if self.sized_by is not None:
            size = columns[self.sized_by].astype(np.int64)
            at = np.cumsum(size) - size
        out: list[list[bytes]] = [[] for _ in columns]
        for a, b in zip(cut[:-1], cut[1:]):
            i = order[a:b]
            for k, c in enumerate(columns):
                out[k].append(pack(ragged(c, at[i], size[i]) if self.sized_by is not None and k == self.n - 1 else c[i]))
        return self._batch(used, out)

    def gathered(self, table) -> list[np.ndarray]:
        """The arrays of the entries in packed rows, joined."""
        return [np.concatenate([unpack(x.as_buffer()) for x in table.column(c)]) for c in self.columns[: self.n]]

    def settled(self, table) -> pa.Table:
        """Rows of what is settled, from packed rows."""
        return self.table([np.concatenate([unpack(x.as_buffer()) for x in table.column(c)]) for c in self.columns[: len(self.flat)]])

    def table(self, columns: list[np.ndarray]) -> pa.Table:
        return pa.table([pa.array(c, t) for c, t in zip(columns, self.types)], list(self.flat))


def exchanged(sent: DataFrame, layout: Sent, deal: Deal, fold: Callable, last: Callable | None = None) -> DataFrame:
    """What the blocks and all folds settle.

    ``sent`` has packed rows of ``layout``, split at the first level of ``deal``.
    ``fold(columns)`` gives the columns of what these entries settle and those of
    the entries that stand for all of them; ``last`` (what is settled only) takes
    its place at the last level.
    """
    sent = dealt(sent, layout, deal, fold)
    finish = last or (lambda columns: fold(columns)[0])

    def meet(table):
        return layout.settled(table) if table.column("part")[0].as_py() < 0 else layout.table(finish(layout.gathered(table)))

    # What is settled already is dealt over many groups of its own.
    own = F.when(F.col("part") < 0, F.pmod(F.xxhash64("c0"), F.lit(deal.parts[-1]))).otherwise(F.lit(0))
    return sent.withColumn("_deal", own).groupBy("part", "_deal").applyInArrow(meet, layout.found)


def dealt(sent: DataFrame, layout: Sent, deal: Deal, fold: Callable) -> DataFrame:
    """``sent``, split at the first level, split at the last one."""
    for parts, after in zip(deal.parts[:-1], deal.parts[1:]):
        sent = _again(sent, layout, deal, parts, after, fold)
    return sent


def _again(sent: DataFrame, layout: Sent, deal: Deal, parts: int, after: int, fold: Callable) -> DataFrame:
    salts = max(1, math.ceil(deal.blocks / FAN))

    def run(batches):
        held, size, now = [], 0, None

        def flush():
            settled, kept = fold(layout.gathered(pa.Table.from_batches(held)))
            yield layout.rows(settled)
            yield layout.split(kept, after)

        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1)
                place = (row.column("part")[0].as_py(), row.column("_salt")[0].as_py())
                if place[0] < 0:
                    yield row.select(["part", *layout.columns])
                    continue
                if held and (place != now or size >= AGAIN):
                    yield from flush()
                    held, size = [], 0
                now = place
                held.append(row)
                size += sum(len(row.column(c)[0].as_buffer()) for c in layout.columns[: layout.n])
        if held:
            yield from flush()

    salted = sent.withColumn("_salt", F.pmod(F.xxhash64("c0"), F.lit(salts)).cast("int"))
    salted = salted.repartition(parts * min(salts, 64), "part", "_salt").sortWithinPartitions("part", "_salt")
    return salted.mapInArrow(run, layout.schema)


def blocks(batches, most: int = BLOCK):
    """Lists of (id, text hash, text bytes, ...) rows, in id order, of ``most`` bytes of text at a time.

    Columns: id (long), text hash (long), text (string or binary), others.
    """
    rows, held = [], 0
    for b in batches:
        cols = [c.cast(pa.binary()) if pa.types.is_string(c.type) or pa.types.is_large_string(c.type) else c for c in b.columns]
        for r in zip(*(c.to_pylist() for c in cols)):
            rows.append(r)
            held += len(r[2] or b"")
            if held >= most or len(rows) >= MOST_ROWS:
                yield sorted(rows, key=lambda r: r[:2])
                rows, held = [], 0
    if rows:
        yield sorted(rows, key=lambda r: r[:2])


def keyed_texts(docs: DataFrame, hashed: bool = True) -> DataFrame:
    """``_doc`` (id, a null below all others), ``_th`` (hash of the text) and ``text``: the order of documents.

    ``hashed`` false: no id repeats, so ``_th`` is 0 and takes no room in what is exchanged.
    """
    th = F.xxhash64("text") if hashed else F.lit(0).cast("long")
    return docs.select(F.coalesce(F.col("doc_id"), F.lit(NO_ID)).cast("long").alias("_doc"), th.alias("_th"), F.col("text"))


def ids_repeat(docs: DataFrame) -> bool:
    """Whether an id stands in several rows."""
    return not docs.groupBy(F.coalesce(F.col("doc_id"), F.lit(NO_ID))).count().where("count > 1").isEmpty()


def first_of(order_keys: tuple[np.ndarray, ...], same: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """For arrays (group, ..., tie) with the last the least significant: sorted order and, in it, whether a group begins.

    The first ``same`` arrays make up the group.
    """
    order = np.lexsort(order_keys[::-1])
    head = np.zeros(len(order), bool)
    head[:1] = True
    for g in order_keys[:same]:
        head[1:] |= g[order][1:] != g[order][:-1]
    return order, head
