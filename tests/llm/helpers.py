"""Small corpora and plain-Python statements of shared rules."""

import random
import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return SPLIT.findall(text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def frame(spark, rows, schema=DOCS):
    """rows: (id, text) pairs or full rows."""
    full = [(*r, "en", f"src{(r[0] or 0) % 3}", len(r[1] or "")) if len(r) == 2 else r for r in rows]
    return spark.createDataFrame(full, schema)


def clashing(docs):
    """The same documents with columns named like the operators' own."""
    from pyspark.sql import functions as F

    names = ["_r", "_b", "_n", "_id", "_doc", "_th", "_d", "_t", "_a", "_s", "_k", "_h", "_key", "_base", "_epoch", "_runs", "_slice", "_p", "size", "shard", "slot", "score", "taken", "target", "root", "kept", "a", "key", "id"]
    return docs.withColumns({n: F.lit(f"own {n}") for n in names})


def vocabulary(rng, n=400):
    return ["".join(rng.choice("abcdefghijklmnoprstuvéèß") for _ in range(rng.randint(2, 9))) for _ in range(n)]


def corpus(seed=5, n=60):
    """Random prose with exact copies, near copies, shared passages, repeats, nulls, empty and long texts."""
    rng = random.Random(seed)
    vocab = vocabulary(rng)

    def prose(k):
        out = []
        while k > 0:
            m = min(k, rng.randint(3, 14))
            out.append(" ".join(rng.choice(vocab) for _ in range(m)).capitalize() + rng.choice([". ", ". ", "! ", ".\n", "\n"]))
            k -= m
        return "".join(out).strip()

    texts = [prose(rng.choice([1, 3, 8, 30, 60, 120, 250])) for _ in range(n)]
    passage = prose(70)
    for i in range(0, n, 7):
        texts[i] = prose(20) + "\n" + passage + "\n" + prose(25)
    for i in range(3, n, 11):
        texts[i] = texts[i - 1]
    for i in range(5, n, 13):
        w = texts[i - 2].split(" ")
        w[len(w) // 2] = "changed"
        texts[i] = " ".join(w)
    texts += [None, "", " \n\t ", "one", "x" * 350, "ab " * 400, prose(3000), None, ""]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [rows[2], rows[2], (None, texts[4]), (None, "alone among the rest of them")]
    rng.shuffle(rows)
    return rows
