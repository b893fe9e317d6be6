import re
from collections import Counter

from lodestone.llm import quality
from tests.llm.helpers import clashing, corpus, frame, lower, words


def figures(text):
    text = text or ""
    w = words(text)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    often, covered = Counter(windows), set()
    for i, x in enumerate(windows):
        if often[x] > 1:
            covered.update(range(i, i + 5))
    lines = [x for x in text.split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def norm(line):
    return " ".join(words(re.sub("[0-9]", "0", lower(line))))


def brute(rows, least_docs, share):
    """rows: (id, text, host)."""
    docs = Counter(h for _, _, h in rows)
    df = Counter((h, x) for _, t, h in rows for x in {norm(y) for y in (t or "").split("\n") if words(y)})
    often = {k for k, n in df.items() if n > least_docs and n > share * docs[k[0]]}
    out = []
    for i, t, h in rows:
        f = figures(t)
        gone = sum(len(words(y)) for y in (t or "").split("\n") if words(y) and (h, norm(y)) in often)
        failed = f[0] < 10 or 100 * f[4] > 20 * f[0]
        left = f[0] - gone
        depleted = gone > 0 and (left < 0.5 * f[0] or left < 10)
        out.append((i, *f, gone, failed, not failed and not depleted))
    return sorted(out, key=str)


def with_lines(rows):
    out = []
    for n, (i, t) in enumerate(rows):
        host = ["h1", "h1", "h2", None][n % 4]
        lines = ["Subscribe to our letter today 2024", "short", "All rights are reserved by the owner of this page and its many friends"]
        out.append((i, (t or "") + "\n" + lines[n % 3] if n % 5 and t is not None else t, "en", host, 0))
    return out


def test_mixed_corpus_against_brute_force(spark):
    rows = with_lines(corpus(n=150))
    rows += rows[:9]
    got = quality.line_rules(frame(spark, rows), least_docs=5, share=0.02).drop("source").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute([(r[0], r[1], r[3]) for r in rows], 5, 0.02)


def test_symbols_repeats_and_unicode(spark):
    rows = [(1, "a b c d e f a b c d e g"), (2, "# * $ | <b>x</b> & %"), (3, "é ü 😀 x y a b c d e f g"), (4, "x " * 50), (5, "a b c d e a b c d e a b c d e a b c d e z"), (6, "l1 w\nl1 w\n\n \nL1 w\nl1 w "), (7, None), (8, "\r\r\n")]
    got = quality.line_rules(frame(spark, rows)).drop("source").collect()
    assert sorted((tuple(r)[:6] for r in got), key=str) == sorted(((i, *figures(t)) for i, t in rows), key=str)


def test_common_line_empties_a_document(spark):
    line = "this very common line of the host has more than ten words in all"
    rows = [(i, line, "en", "h", 0) for i in range(30)] + [(100 + i, f"{line}\nown text {chr(97 + i)}{chr(98 + i % 24)}x that is long enough to stay as it holds many more words than the line", "en", "h", 0) for i in range(30)]
    docs = clashing(frame(spark, rows))
    out = quality.clean_documents(docs)
    assert out.columns == docs.columns
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert set(got) == {100 + i for i in range(30)} and all(line not in t for t in got.values())


def test_empty_and_plan_is_native(spark):
    assert quality.line_rules(frame(spark, [])).count() == 0
    plan = quality.line_rules(frame(spark, corpus()))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source").collect()]
    got = quality.op10_query(spark, sf_dir).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, quality.LINE_DOCS, quality.LINE_SHARE)
