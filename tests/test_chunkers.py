"""Chunkers against hand-made expectations and plain statements of their rules."""

import random

from pyspark.sql import functions as F

from lodestone.config import ProjectConfig
from lodestone.operators import lean, markdown, plaintext, windows
from lodestone.operators.chunking import chunk_files
from lodestone.operators.python_code import parse_python
from lodestone.operators.structural import parse_code
from lodestone.sources import files


def corpus(spark, contents):
    rows = spark.createDataFrame(list(contents.items()), "p string, t string")
    return files.of_columns(rows, F.col("p"), F.col("t"))


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.orderBy("source_path", "start_line", F.desc("end_line")).collect()]


def test_markdown_sections_keep_order_titles_and_ranges(spark):
    text = "intro\n\n# One\na\n\n## Two\nb\n### Three\n"
    got = rows(markdown.markdown_chunks(corpus(spark, {"d/x.md": text}), 0, 0), "section_title", "start_line", "end_line", "text")
    assert got == [("x.md", 1, 2, "intro"), ("One", 3, 5, "# One\na"), ("Two", 6, 7, "## Two\nb"), ("Three", 8, 8, "### Three")]


def test_markdown_merge_forward_and_last_backward(spark):
    text = "# A\n1\n# B\n2\n3\n4\n# C\n5\n"
    got = rows(markdown.markdown_chunks(corpus(spark, {"x.md": text}), 4, 0), "section_title", "start_line", "end_line", "text")
    assert got == [("A", 1, 8, "# A\n1\n\n# B\n2\n3\n4\n\n# C\n5")]


def test_markdown_split_spares_formulas_and_repeats_the_title(spark):
    text = "# T\na\n\nb\n$$\n\nx\n$$\n\nc\nd\ne\n\nf\n"
    got = rows(markdown.markdown_chunks(corpus(spark, {"x.md": text}), 0, 5), "start_line", "end_line", "text")
    assert got == [(1, 2, "# T\na"), (4, 8, "## T (continued)\n\nb\n$$\n\nx\n$$"), (10, 14, "## T (continued)\n\nc\nd\ne\n\nf")]


def test_markdown_without_blank_lines_stays_whole(spark):
    got = rows(markdown.markdown_chunks(corpus(spark, {"x.md": "# T\n" + "l\n" * 30}), 0, 5), "start_line", "end_line")
    assert got == [(1, 31)]


def plain_markdown(text, least, most):
    """The three passes as loops."""
    lines = text.split("\n")[:-1] if text.endswith("\n") else text.split("\n")
    head = lambda x: x.strip().startswith("#") and x.strip().lstrip("#")[:1].isspace() and len(x.strip()) - len(x.strip().lstrip("#")) <= 6
    starts = sorted({0, *[i for i, x in enumerate(lines) if head(x)]}) + [len(lines)]
    parts = [[lines[a].strip().lstrip("#").strip() if head(lines[a]) else "f.md", a + 1, b, "\n".join(lines[a:b]).strip()] for a, b in zip(starts, starts[1:])]
    parts = [p for p in parts if p[3]]
    out = []
    for p in parts:
        if out and out[-1][2] - out[-1][1] + 1 < least:
            out[-1] = [out[-1][0], out[-1][1], p[2], out[-1][3] + "\n\n" + p[3]]
        else:
            out.append(p)
    if len(out) > 1 and out[-1][2] - out[-1][1] + 1 < least:
        last = out.pop()
        out[-1] = [out[-1][0], out[-1][1], last[2], out[-1][3] + "\n\n" + last[3]]
    done = []
    for title, a, b, body in out:
        rows = body.split("\n")
        if b - a + 1 <= most or len(rows) <= most:
            done.append((title, a, b, body))
            continue
        inside, safe = False, []
        for i, x in enumerate(rows):
            inside ^= x.strip().startswith("$$")
            if not x.strip() and not inside:
                safe.append(i)
        at, cuts = 0, []
        while at + most < len(rows):
            near = [s for s in safe if at < s <= at + most] or [s for s in safe if s > at][:1]
            if not near:
                break
            cuts.append(near[-1])
            at = near[-1] + 1
        spans = list(zip([0, *[c + 1 for c in cuts]], [*cuts, len(rows)]))
        made = [(s, e, "\n".join(rows[s:e]).strip()) for s, e in spans]
        made = [m for m in made if m[2]]
        done += [(title, a + s, a + e - 1 if e < len(rows) else b, t if n == 0 else f"## {title} (continued)\n\n{t}") for n, (s, e, t) in enumerate(made)] if cuts and made else [(title, a, b, body)]
    return done


def test_markdown_passes_against_loops(spark):
    rng = random.Random(3)
    texts = {f"{i}/f.md": "".join(rng.choice(["# h\n", "## k\n", "text\n", "more\n", "\n", "\n", "$$\n", "x"]) for _ in range(rng.randint(1, 60))) for i in range(120)}
    got = {}
    for r in markdown.markdown_chunks(corpus(spark, texts), 5, 9).collect():
        got.setdefault(r["source_path"], []).append((r["section_title"], r["start_line"], r["end_line"], r["text"]))
    for path, t in texts.items():
        assert sorted(got.get(path, []), key=lambda c: c[1:3]) == sorted(plain_markdown(t, 5, 9), key=lambda c: c[1:3])


def test_plaintext_fills_merges_and_keeps_first_start(spark):
    text = "a\nb\n\nc\n\na\nb\n\nd\ne\nf\ng\nh\ni\n"
    got = rows(plaintext.plaintext_chunks(corpus(spark, {"x.txt": text}), 0, 7), "start_line", "end_line", "text")
    assert got == [(1, 7, "a\nb\n\nc\n\na\nb"), (9, 14, "d\ne\nf\ng\nh\ni")]
    assert rows(plaintext.plaintext_chunks(corpus(spark, {"x.txt": text}), 8, 7), "start_line", "end_line") == [(1, 14)]
    assert plaintext.plaintext_chunks(corpus(spark, {"x.txt": "\n \n", "y.txt": "", "z.txt": None})).count() == 0


def test_windows_tile_the_file(spark):
    text = "\n".join(str(i) for i in range(1, 101)) + "\n"
    assert rows(windows.window_chunks(corpus(spark, {"x.py": text})), "start_line", "end_line") == [(1, 40), (41, 80), (81, 100)]
    big = rows(windows.whole_files(corpus(spark, {"x.md": ("y" * 99 + "\n") * 2000})), "start_line", "end_line", "text")
    assert big[0][:2] == (1, 2000) and len(big[0][2]) == 12_000


PY = '''import os
X = 1

@deco(
    1)
def f(a):
    return a

class A:
    """Doc."""
    def m(self):
        return 1

    async def n(self): pass
'''


def test_python_units():
    units = list(parse_python(PY, "t.py", ".py", 2, 100))
    chunks = [(u.start, u.end, u.kind, u.name) for u in units if u.text is not None]
    assert chunks == [(1, 2, "module_preamble", "t.py preamble"), (4, 7, "function", "f"), (9, 14, "class", "A"), (11, 12, "method", "A.m")]
    assert [(u.start, u.end, u.kind, u.name) for u in units if u.text is None] == [(6, 7, "function", "f"), (9, 14, "class", "A"), (11, 12, "method", "A.m"), (14, 14, "method", "A.n")]
    assert [u.parent for u in units if u.kind == "method" and u.text] == [(9, 14, "A")]


def test_python_long_function_is_split_at_statements():
    body = "".join(f"    x{i} = {i}\n" for i in range(20))
    units = [u for u in parse_python(f"def g(a):\n{body}", "t.py", ".py", 2, 8) if u.text]
    assert [u.title for u in units] == ["g (part 1)", "g (part 2)", "g (part 3)"]
    assert [(u.start, u.end) for u in units] == [(1, 9), (10, 17), (18, 21)]
    assert all(u.text.startswith("def g(a):") for u in units) and "x8 = 8" in units[1].text


def test_broken_and_odd_python():
    assert [u.name for u in parse_python("print 'x'\ndef f():\n    pass\n", "t.py", ".py", 0, 100) if u.text] == ["t.py preamble", "f"]
    assert list(parse_python("# only a comment\n", "t.py", ".py", 0, 100)) == []
    assert list(parse_python(" \n", "t.py", ".py", 0, 100)) == []


LEAN = """import A

/-- Doc of one.
spans lines -/
theorem one : True := trivial

/-- Doc of two. -/
@[simp]
lemma two : True := by
  trivial -- def fake : Nat := 1

/- theorem hidden : True := trivial
/- nested -/ still hidden
-/
private def three := 3
def four := 4
instance : Inhabited Nat := ⟨0⟩
"""


def test_lean_units():
    units = list(lean.parse_lean(LEAN, "b.lean", ".lean", 0, 0))
    assert [(u.start, u.end, u.kind, u.name) for u in units if u.text is not None] == [
        (1, 2, "module_preamble", "b.lean preamble"), (3, 6, "theorem", "one"), (7, 11, "lemma", "two"), (12, 15, "function", "three"), (16, 17, "function", "four"),
    ]
    assert [(u.start, u.kind, u.name) for u in units if u.text is None] == [(5, "theorem", "one"), (9, "lemma", "two"), (15, "definition", "three"), (16, "definition", "four")]
    starts = [u.start for u in units if u.text is not None]
    ends = [u.end for u in units if u.text is not None]
    assert all(e < s for e, s in zip(ends, starts[1:])) and ends[-1] == 17


def names(text, ext, most=2):
    return [(u.kind, u.name) for u in parse_code(text, "f" + ext, ext, 0, most) if u.text is not None]


def test_structural_languages():
    assert names("package a;\n@X\npublic class A {\n  A() {}\n  int g(int y) { return y; }\n}\n", ".java")[1:] == [("class", "A"), ("method", "A.A"), ("method", "A.g")]
    assert names("package m\n\nfunc (s *S) Get() int {\n\treturn 1\n}\n", ".go") == [("module_preamble", "f.go preamble"), ("function", "Get")]
    assert names("struct P { int x; };\nstatic int f(int a) {\n  return a;\n}\nint proto(int);\n", ".c") == [("class", "P"), ("function", "f"), ("module_preamble", "f.c preamble")]
    assert names("module M\n  def a\n    1\n  end\nend\n", ".rb") == [("class", "M"), ("method", "M.a")]
    assert names("protocol P {\n func d()\n}\nfunc e() {\n}\n", ".swift")[0] == ("class", "P")
    assert names("const s = '}';\nfunction f() { return `{`; }\n", ".js") == [("module_preamble", "f.js preamble"), ("function", "f")]
    assert names("", ".js") == [] and names("x", ".unknown") == []


def test_tiny_code_chunks_join_the_one_before():
    text = "use a;\n\nfn one() {}\n\nfn two() {\n  1;\n  2;\n  3;\n}\n// end\n"
    got = [(u.start, u.end, u.name) for u in parse_code(text, "l.rs", ".rs", 3, 100) if u.text is not None]
    assert got == [(1, 3, "l.rs preamble"), (5, 10, "two")]


def test_dispatch_errors_and_ids(spark):
    both = {"a/x.md": "# T\nb\n", "a/t.py": PY, "a/u.rst": "para\n", "b/t.py": PY}
    done = chunk_files(corpus(spark, both), ProjectConfig(code_chunk_min_lines=2))
    chunks = done.chunks.toPandas()
    assert set(chunks["chunk_type"]) == {"markdown", "code", "plaintext"} and done.errors.count() == 0
    kids = chunks[chunks["parent_id"].notna()]
    assert set(kids["parent_id"]) <= set(chunks["chunk_id"].dropna()) and kids["parent_id"].nunique() == 2
    assert chunks.drop(columns="hypothetical_questions").equals(chunk_files(corpus(spark, both), ProjectConfig(code_chunk_min_lines=2)).chunks.toPandas().drop(columns="hypothetical_questions"))


def test_key_terms_and_formal_objects(spark):
    text = "# Sets\nA gap is here.\n\n**Definition 1.2** x\ny\n\nz\n\n## Gap\nend\n"
    done = chunk_files(corpus(spark, {"n.md": text, "p.txt": "gap\n", "k.lean": "-- a gap\ndef set := 1\n"}), ProjectConfig(key_terms=["gap", "set"]))
    got = sorted((r["file_path"], r["concept"], r["entry_type"], r["start_line"], r["end_line"]) for r in done.entries.collect())
    assert got == [
        ("k.lean", "gap", "term", 1, 2), ("k.lean", "set", "definition", 2, 2), ("n.md", "Definition 1.2", "definition", 4, 7), ("n.md", "Gap", "section", 9, 10),
        ("n.md", "Sets", "section", 1, 8), ("n.md", "set", "term", 1, 10),
    ]


def test_files_from_disk(spark, tmp_path):
    (tmp_path / "a b").mkdir()
    (tmp_path / "a b" / "x.md").write_text("# T\n")
    (tmp_path / "bad.md").write_bytes(b"\xff\xfe")
    (tmp_path / "bad.txt").write_bytes(b"ok \xff\n")
    (tmp_path / "skip.bin").write_bytes(b"x")
    got = {r["source_path"]: (r["content"], r["error"]) for r in files.read_files(spark, str(tmp_path), [".md", ".txt"]).collect()}
    assert got == {"a b/x.md": ("# T\n", None), "bad.md": (None, "not valid UTF-8"), "bad.txt": ("ok �\n", None)}
    done = chunk_files(files.read_files(spark, str(tmp_path), [".md", ".txt"]))
    assert done.chunks.count() == 2 and [r["source_path"] for r in done.errors.collect()] == ["bad.md"]
