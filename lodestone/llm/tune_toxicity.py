"""Chooses the rates of ``toxicity``: ``python -m lodestone.llm.tune_toxicity TABLES``.

Only labelled rows outside the held-out part are read. Those whose
crc32(doc_id as text) mod 4 is 0 judge what was learned from those of 1 and 3, by
log loss, then by errors at the threshold. Labels of the held-out part play no role.
"""

from __future__ import annotations

import itertools
import sys
import zlib

import numpy as np
import pyarrow.dataset as ds

from lodestone.llm import toxicity

GRID = {"alpha": (0.3, 1.0, 3.0, 10.0), "l1": (1.0, 3.0, 6.0, 12.0), "l2": (0.3, 1.0), "epochs": (1, 2, 3)}


def rows(tables: str) -> tuple[list[tuple], list[tuple]]:
    """(text, label) to learn from and to judge by."""
    labels = {r["doc_id"]: r["toxic"] for r in ds.dataset(f"{tables}/labels.parquet").to_table().to_pylist() if r["toxic"] is not None}
    held = lambda i: zlib.crc32(str(i).encode()) % 4
    known = sorted(i for i in labels if i is not None and held(i) != 2)
    texts = {}
    for batch in ds.dataset(f"{tables}/documents.parquet").to_batches(columns=["doc_id", "text"]):
        texts.update((i, (t or "").encode()) for i, t in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()) if i in labels)
    pairs = [(held(i), texts[i], float(labels[i])) for i in known if i in texts]
    return [x[1:] for x in pairs if x[0] != 0], [x[1:] for x in pairs if x[0] == 0]


def judged(learn: list[tuple], judge: list[tuple], epochs: int, **rates) -> tuple[float, int, int]:
    """Log loss, toxic rows missed and others rejected at the threshold."""
    ids, w = toxicity.train([t for t, _ in learn], [y for _, y in learn], epochs, **rates)
    dense = np.zeros((1 << toxicity.BITS) + 1)
    dense[ids] = w
    p = np.concatenate([toxicity.score([t for t, _ in judge[lo:hi]], dense) for lo, hi in toxicity.textnp.groups([len(t) for t, _ in judge], 1 << 21)])
    y = np.array([y for _, y in judge])
    loss = -np.mean(np.log(np.clip(np.where(y > 0, p, 1 - p), 1e-12, 1)))
    said = p >= toxicity.THRESHOLD
    return float(loss), int((~said & (y > 0)).sum()), int((said & (y == 0)).sum())


def main(tables: str) -> None:
    learn, judge = rows(tables)
    print(len(learn), "rows to learn from,", len(judge), "to judge by,", int(sum(y for _, y in judge)), "of them toxic")
    found = []
    for values in itertools.product(*GRID.values()):
        rates = dict(zip(GRID, values))
        found.append((judged(learn, judge, **rates), rates))
        print(*found[-1], flush=True)
    print("best:", *min(found, key=lambda x: x[0]))


if __name__ == "__main__":
    main(sys.argv[1])
