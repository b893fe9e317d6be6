"""Operator 5: exact removal of repeated 100-byte strings by a hash-compared suffix sort.

A byte goes if a 100-byte string that covers it also starts earlier (smaller
document, or same document and smaller offset). Sorting all suffixes of a corpus
would shuffle every one of them, so suffixes are sorted sparsely:

1. Anchors. In each 100-byte window the GRAM-byte string with the smallest hash
   (leftmost on ties) is the anchor; equal windows have equal anchors at equal
   offsets. Windows with one anchor form a stretch, on average 35 windows long.
2. Anchors that stand once in the corpus can't lie in a repeat. The hashes of
   anchors are exchanged and the stretches of repeated anchors opened; nothing
   is removed by that.
3. The bytes of opened stretches are exchanged by anchor. There, and before in
   each buffer and block, stretches of one anchor and shape are merge-sorted as
   suffixes: two are compared by their longest common extension, found by binary
   search over prefix polynomial hashes, so a comparison takes logarithmic time.
   Neighbours whose extension covers the stretch are compared byte by byte; then
   all but the first are repeats.
4. What is left of an anchor agrees in part at most: the single windows of these
   stretches are sorted and compared in the same way. Windows whose hash no other
   has are left out of that sort.

Every removal follows from a comparison of neighbours in sorted order that their
bytes confirm; hashes alone decide nothing. No pairs are formed, and a stretch
is sent once for each buffer and block. Windows are never cut by block or segment
bounds: longer texts are taken in segments that overlap by 99 bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import textnp
from lodestone.llm.common import boxed, fields_of, stage
from lodestone.llm.exchange import NO_ID, Deal, Sent, blocks, deal_for, exchanged, first_of, ids_repeat, keyed_texts, ragged

LENGTH, GRAM = 100, 32
#: Bytes that are hashed at once; anchors are told apart by 24 bits of offset.
SEGMENT = 1 << 20
U = textnp.U


def windows_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    m, have = values, 1
    while have < width:
        step = min(have, width - have)
        m = np.minimum(m[:-step], m[step:])
        have += step
    return m


def stretches(buf: np.ndarray, sums: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, ...]:
    """First and last window, anchor, anchor hash of every stretch of valid windows.

    ``valid[p]`` says whether the window at p lies in one document.
    """
    none = np.zeros(0, np.int64)
    if len(buf) < LENGTH or not valid.any():
        return none, none, none, none.astype(U)
    n = len(buf) - GRAM + 1
    gram = textnp.mix((sums[GRAM:] - sums[:-GRAM]) * textnp.POWERS.get(len(sums))[1][:n])
    low = U((1 << 24) - 1)
    owner = windows_min((gram & ~low) | np.arange(n, dtype=U), LENGTH - GRAM + 1) & low
    owner = owner.astype(np.int64)
    v = valid[: len(owner)]
    new = v.copy()
    new[1:] &= (owner[1:] != owner[:-1]) | ~v[:-1]
    lo = np.flatnonzero(new)
    end = v.copy()
    end[:-1] &= (owner[1:] != owner[:-1]) | ~v[1:]
    hi = np.flatnonzero(end)
    a = owner[lo]
    return lo, hi, a, textnp.mix(gram[a])  # the smallest hashes are crowded: mixed again, they spread over all parts


class Suffixes:
    """Suffixes of a buffer, compared through prefix hashes."""

    def __init__(self, buf: np.ndarray, sums: np.ndarray):
        self.buf, self.sums = buf, sums
        self.down = textnp.POWERS.get(len(sums))[1]

    def common(self, x: np.ndarray, y: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Length of the longest common extension of suffixes x and y, at most ``limit``, by binary search."""
        lo, hi = np.zeros(len(x), np.int64), limit.copy()
        while (lo < hi).any():
            mid = (lo + hi + 1) // 2
            same = (self.sums[x + mid] - self.sums[x]) * self.down[x] == (self.sums[y + mid] - self.sums[y]) * self.down[y]
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        return lo

    def compare(self, x: np.ndarray, y: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """-1, 0 or 1: order of the first ``limit`` bytes."""
        n = self.common(x, y, limit)
        ends = len(self.buf) - 1
        a, b = self.buf[np.minimum(x + n, ends)].astype(np.int16), self.buf[np.minimum(y + n, ends)]
        return np.where(n >= limit, 0, np.sign(a - b))

    def merge_sort(self, at: np.ndarray, size: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Stable bottom-up merge sort of suffixes inside groups of equal ``group`` (already side by side).

        All suffixes of a group are compared over the same ``size``. Each merge
        places an element by binary search in the neighbouring run.
        """
        m = len(at)
        order = np.arange(m)
        head = np.ones(m, bool)
        head[1:] = group[1:] != group[:-1]
        g0 = np.flatnonzero(head)[np.cumsum(head) - 1] if m else order
        count = np.diff(np.append(np.flatnonzero(head), m))[np.cumsum(head) - 1] if m else order
        run = 1
        while m and (count > run).any():
            i = np.flatnonzero(count > run)
            j = i - g0[i]
            mine = j // run
            right = (mine & 1) == 1
            other0 = (mine ^ 1) * run
            other1 = np.minimum(other0 + run, count[i])
            lo, hi = np.minimum(other0, other1), other1.copy()
            x = order[i]
            while (lo < hi).any():
                open_ = np.flatnonzero(lo < hi)
                mid = (lo[open_] + hi[open_]) // 2
                y = order[g0[i[open_]] + mid]
                c = self.compare(at[y], at[x[open_]], size[x[open_]])
                ahead = (c < 0) | ((c == 0) & right[open_])
                lo[open_] = np.where(ahead, mid + 1, lo[open_])
                hi[open_] = np.where(ahead, hi[open_], mid)
            place = g0[i] + np.minimum(other0, mine * run) + (j - mine * run) + np.maximum(lo - other0, 0)
            moved = order.copy()
            moved[place] = x
            order, run = moved, run * 2
        return order

    def same_bytes(self, x: np.ndarray, y: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Byte by byte comparison, which settles hash collisions."""
        out = np.zeros(len(x), bool)
        for lo in range(0, len(x), 2000):
            a, b, n = x[lo : lo + 2000], y[lo : lo + 2000], size[lo : lo + 2000]
            k = np.arange(n.max())
            inside = k < n[:, None]
            ends = len(self.buf) - 1
            out[lo : lo + 2000] = ((self.buf[np.minimum(a[:, None] + k, ends)] == self.buf[np.minimum(b[:, None] + k, ends)]) | ~inside).all(1)
        return out


def segments(rows: list[tuple]):
    """Buffers of whole texts, or of overlapping pieces of a long one, with what stands where.

    Yields buffer, row number and text offset of each piece, offset of each
    piece in the buffer, and the mask of windows that lie in one piece.
    """
    sizes = [len(r[2] or b"") for r in rows]
    for lo, hi in textnp.groups(sizes, SEGMENT):
        if hi - lo == 1 and sizes[lo] > 2 * SEGMENT:
            for at in range(0, sizes[lo] - LENGTH + 1, SEGMENT):
                piece = rows[lo][2][at : at + SEGMENT + LENGTH - 1]
                yield from _buffer([piece], np.array([lo]), np.array([at]))
        else:
            yield from _buffer([r[2] or b"" for r in rows[lo:hi]], np.arange(lo, hi), np.zeros(hi - lo, np.int64))


def _buffer(texts: list[bytes], row: np.ndarray, offset: np.ndarray):
    buf, bounds = textnp.joined(texts)
    valid = np.ones(len(buf), bool)
    for start, stop in zip(bounds[:-1], bounds[1:]):
        valid[max(start, stop - LENGTH) : stop] = False
    yield buf, row, offset, bounds, valid


FLAT = {"_doc": "long", "_th": "long", "start": "long", "stop": "long"}
#: Anchor hash, document, text hash, start, windows beyond the first, offset of the anchor.
ANCHORS = Sent(6, FLAT)
#: Anchor hash, document, text hash, start, size, offset of the anchor, bytes.
STRETCHES = Sent(7, FLAT, sized_by=4)


def runs_of(doc, th, start, stop) -> list[np.ndarray]:
    """Stretches of window starts that repeat, those side by side joined."""
    order = np.lexsort((start, th, doc))
    doc, th, start, stop = (x[order] for x in (doc, th, start, stop))
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (th[1:] != th[:-1]) | (start[1:] > stop[:-1] + 1)
    head = np.flatnonzero(new)
    return [doc[head], th[head], start[head], stop[np.append(head[1:], len(stop)) - 1] if len(head) else stop]


def repeats(text: Suffixes, at, size, group, place: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Which suffixes repeat an earlier one of their group, and which stand for others or themselves.

    ``at``, ``size``: suffixes of ``text``, all of one size in a group. ``place``:
    document, text hash and offset; the smallest of equal suffixes is the first.
    Of several suffixes at one place (repeated rows) one stands for all.
    """
    order = np.lexsort((*place[::-1], group))
    g = group[order]
    tied = np.zeros(len(g), bool)
    tied[1:] = g[1:] == g[:-1]
    tied[:-1] |= tied[1:].copy()
    again, stands = np.zeros(len(g), bool), np.ones(len(g), bool)
    some = order[tied]
    if len(some):
        ranked = some[text.merge_sort(at[some], size[some], group[some])]
        x, n, gg = at[ranked], size[ranked], group[ranked]
        same = np.zeros(len(x), bool)
        same[1:] = (gg[1:] == gg[:-1]) & (text.common(x[1:], x[:-1], n[1:]) >= n[1:])
        p = np.flatnonzero(same)
        same[p] = text.same_bytes(x[p], x[p - 1], n[p])
        lead = ranked[np.maximum.accumulate(np.where(same, 0, np.arange(len(x))))]
        apart = np.zeros(len(x), bool)
        for c in place:
            apart |= c[ranked] != c[lead]
        stands[ranked] = ~same
        again[ranked] = same & apart
    return again, stands


def packed_place(start, shift, wide) -> np.ndarray:
    """Start of a stretch with its shape in the lowest 14 bits."""
    return start.astype(np.int64) << 14 | shift.astype(np.int64) << 7 | wide.astype(np.int64)


def fold_anchors(columns: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Stretches whose anchor stands in several of these; the first of each anchor goes on."""
    key, doc, th, start, wide, shift = columns
    order, head = first_of((key, doc, th, start))
    group = np.cumsum(head) - 1
    i = order[np.bincount(group)[group] > 1] if len(order) else order
    settled = [doc[i], th[i], packed_place(start[i], shift[i], wide[i]), np.full(len(i), -1, np.int64)]
    return settled, [c[order[head]] for c in columns]


def find_anchors(docs: DataFrame, deal: Deal, hashed: bool) -> DataFrame:
    """Steps 1 and 2: stretches that repeat in a buffer, and (stop -1) those to open, by their packed place."""

    def send(batches):
        for rows in blocks(batches):
            ids, ths = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)
            held, gone = [], []
            for buf, row, offset, bounds, valid in segments(rows):
                sums = textnp.prefix(textnp.BYTES[buf])
                lo, hi, a, key = stretches(buf, sums, valid)
                if not len(lo):
                    continue
                piece = np.searchsorted(bounds, lo, "right") - 1
                start, r = lo - bounds[piece] + offset[piece], row[piece]
                place = (ids[r], ths[r], start)
                shape = ((a - lo) * 256 + (hi - lo)).astype(U)
                again, stands = repeats(Suffixes(buf, sums), lo, hi + LENGTH - lo, textnp.combine(key, shape), place)
                gone.append([c[again] for c in (*place, start + hi - lo)])
                held.append([c[stands] for c in (key, *place, (hi - lo).astype(np.uint8), (a - lo).astype(np.uint8))])
            if not held:
                continue
            yield ANCHORS.rows(runs_of(*(np.concatenate(c) for c in zip(*gone))))
            opened, left = fold_anchors([np.concatenate(c) for c in zip(*held)])
            yield ANCHORS.rows(opened)
            yield ANCHORS.split(left, deal.parts[0])

    return exchanged(keyed_texts(docs, hashed).mapInArrow(send, ANCHORS.schema), ANCHORS, deal, fold_anchors)


def in_chunks(columns: list[np.ndarray]):
    """The entries in runs of whole anchors of about SEGMENT bytes, with the offsets of their bytes."""
    key, size, data = columns[0], columns[4].astype(np.int64), columns[6]
    order = np.argsort(key, kind="stable")
    at = np.cumsum(size) - size
    new = np.ones(len(order), bool)
    new[1:] = key[order][1:] != key[order][:-1]
    firsts = np.flatnonzero(new)
    sums = np.add.reduceat(size[order], firsts) if len(firsts) else firsts
    for lo, hi in textnp.groups(sums.tolist(), SEGMENT):
        i = order[firsts[lo] : firsts[hi] if hi < len(firsts) else len(order)]
        n = size[i]
        yield i, [c[i] for c in columns[:6]], ragged(data, at[i], n), np.cumsum(n) - n


def equal_stretches(chunk: list[np.ndarray], text: Suffixes, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key, doc, th, start, size, shift = chunk
    shape = shift.astype(U) * U(256) + size.astype(U)
    return repeats(text, at, size.astype(np.int64), textnp.combine(key, shape), (doc, th, start))


def equal_windows(chunk: list[np.ndarray], text: Suffixes, at: np.ndarray, stands: np.ndarray) -> list[np.ndarray]:
    """Step 4 for the stretches that stand: places of windows that repeat an earlier one."""
    key, doc, th, start, size, shift = chunk
    h = np.flatnonzero(stands)
    k = key[h]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    group = np.cumsum(new) - 1
    h = h[np.bincount(group)[group] > 1]
    n = size[h].astype(np.int64) - LENGTH + 1
    of = np.repeat(h, n)
    step = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    w = at[of] + step
    side = textnp.combine(key[of], (shift[of].astype(np.int64) - step).astype(U))
    hashed = textnp.combine(side, textnp.stretch(text.sums, w, w + LENGTH))
    order = np.argsort(hashed, kind="stable")
    tied = np.zeros(len(order), bool)
    tied[1:] = hashed[order][1:] == hashed[order][:-1]
    tied[:-1] |= tied[1:].copy()
    i = order[tied]
    of, w, p, side = of[i], w[i], (start[of] + step)[i] if len(of) else step, side[i]
    again, _ = repeats(text, w, np.full(len(w), LENGTH), side, (doc[of], th[of], p))
    return [doc[of][again], th[of][again], p[again], p[again]]


def fold_stretches(columns: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Whole stretches that repeat an earlier one; those that stand go on."""
    gone, kept = [], []
    for i, chunk, data, at in in_chunks(columns):
        again, stands = equal_stretches(chunk, Suffixes(data, textnp.prefix(textnp.BYTES[data])), at)
        _, doc, th, start, size, _ = chunk
        gone.append([doc[again], th[again], start[again], (start + size - LENGTH)[again]])
        kept.append([*(c[stands] for c in chunk), ragged(data, at[stands], chunk[4][stands].astype(np.int64))])
    if not gone:
        return [np.zeros(0, np.int64)] * 4, columns
    return runs_of(*(np.concatenate(c) for c in zip(*gone))), [np.concatenate(c) for c in zip(*kept)]


def last_stretches(columns: list[np.ndarray]) -> list[np.ndarray]:
    """Whole stretches, then single windows, that repeat an earlier one."""
    gone = []
    for _, chunk, data, at in in_chunks(columns):
        text = Suffixes(data, textnp.prefix(textnp.BYTES[data]))
        again, stands = equal_stretches(chunk, text, at)
        _, doc, th, start, size, _ = chunk
        gone.append([doc[again], th[again], start[again], (start + size - LENGTH)[again]])
        gone.append(equal_windows(chunk, text, at, stands))
    return runs_of(*(np.concatenate(c) for c in zip(*gone)))


def find_repeats(docs: DataFrame, opened: DataFrame, deal: Deal, hashed: bool) -> DataFrame:
    """Steps 3 and 4: runs of window starts in the opened stretches that repeat."""
    by_doc = opened.groupBy(F.col("_doc").alias("_d"), F.col("_th").alias("_t")).agg(F.collect_set("start").alias("_s"))
    rows = keyed_texts(docs, hashed).join(by_doc, (F.col("_doc") == F.col("_d")) & (F.col("_th") == F.col("_t"))).select("_doc", "_th", "text", "_s")

    def send(batches):
        for block in blocks(batches):
            found = []
            for doc, th, text, places in block:
                data = np.frombuffer(text, np.uint8)
                place = np.sort(np.array(places, np.int64))
                start, shift, size = place >> 14, place >> 7 & 127, (place & 127) + LENGTH
                gram = data[(start + shift)[:, None] + np.arange(GRAM)]
                sums = np.zeros((len(start), GRAM + 1), U)
                np.cumsum(textnp.BYTES[gram] * textnp.POWERS.get(GRAM)[0], axis=1, out=sums[:, 1:])
                m = np.full(len(start), 0)
                found.append([textnp.mix(textnp.mix(sums[:, -1])), m + doc, m + th, start, size.astype(np.uint8), shift.astype(np.uint8), ragged(data, start, size)])
            settled, left = fold_stretches([np.concatenate(c) for c in zip(*found)])
            yield STRETCHES.rows(settled)
            yield STRETCHES.split(left, deal.parts[0])

    return exchanged(rows.mapInArrow(send, STRETCHES.schema), STRETCHES, deal, fold_stretches, last_stretches)


def repeated_windows(docs: DataFrame, hashed: bool = True) -> DataFrame:
    """``_doc, _th, start, stop``: stretches of window starts whose 100 bytes also start earlier."""
    deal = deal_for(docs)
    found = stage(find_anchors(docs, deal, hashed), "suffix-anchors")
    more = stage(find_repeats(docs, found.where("stop < 0"), deal, hashed), "suffix-repeats")
    return found.where("stop >= 0").unionByName(more)


def _cut(text: bytes, starts, stops) -> tuple[list[tuple[int, int]], bytes]:
    """Maximal runs covered by windows (first to last start of each stretch) and the bytes that are left."""
    runs: list[tuple[int, int]] = []
    for a, b in sorted(zip(starts, stops)):
        if runs and a <= runs[-1][1]:
            runs[-1] = (runs[-1][0], max(runs[-1][1], b + LENGTH))
        else:
            runs.append((a, b + LENGTH))
    kept, at = [], 0
    for a, b in runs:
        kept.append(text[at:a])
        at = b
    kept.append(text[at:])
    return runs, b"".join(kept)


def remove_repeats(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """Documents without repeated strings: all columns but ``text`` as they are, plus n_bytes, n_removed, n_spans, kept_sha256.

    ``with_text``: also ``kept`` (binary, the bytes that are left; cuts may split
    a character). Defined cases: null texts are empty; texts under 100 bytes
    stay; rows with equal id and text are one document and don't repeat each
    other; null ids come before all others; existing columns named like new
    ones are replaced.
    """
    hashed = ids_repeat(docs)
    spans = repeated_windows(docs, hashed).groupBy(F.col("_doc").alias("_d"), F.col("_th").alias("_t")).agg(F.collect_list("start").alias("_a"), F.collect_list("stop").alias("_b"))
    taken = {"n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"}
    fields = [c for c in docs.columns if c.lower() not in taken and c != "text"]
    keyed = boxed(docs, fields, text=F.col("text"), _k=F.coalesce(F.col("doc_id"), F.lit(NO_ID)).cast("long"), _h=F.xxhash64("text") if hashed else F.lit(0).cast("long"))
    rows = keyed.join(spans, (F.col("_k") == F.col("_d")) & (F.col("_h") == F.col("_t")), "left").select("_row", "text", "_a", "_b")
    schema = rows.select("_row").schema
    kinds = {"n_bytes": "long", "n_removed": "long", "n_spans": "long", "kept_sha256": "string"} | ({"kept": "binary"} if with_text else {})
    for k, t in kinds.items():
        schema = schema.add(k, t)

    def cut(batches):
        for b in batches:
            names = b.schema.names
            texts = b.column(names.index("text")).cast(pa.binary()).to_pylist()
            starts, stops = (b.column(names.index(c)).to_pylist() for c in ("_a", "_b"))
            rows = []
            for t, s, e in zip(texts, starts, stops):
                t = t or b""
                runs, kept = _cut(t, s or (), e or ())
                rows.append((len(t), len(t) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept)[: len(kinds)])
            cols = list(zip(*rows)) if rows else [[] for _ in kinds]
            types = [pa.int64()] * 3 + [pa.string(), pa.binary()]
            yield pa.record_batch([b.column(0), *[pa.array(c, t) for c, t in zip(cols, types)]], ["_row", *kinds])

    return rows.mapInArrow(cut, schema).select(*fields_of(fields), *kinds)


def op5_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs, with_text=False)
