"""Text expressions against plain Python, on hand-made and random strings."""

import hashlib
import itertools
import math
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.functions import vectors as V
from lodestone.operators.embedding import HashProvider
from lodestone.operators.search import fixed

SPACES = " \t\n\r\x0b\x0c\x1c\x1f\x85   "


def frame(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")


def values(spark, texts, column):
    return [r[0] for r in frame(spark, texts).orderBy("i").select(column(F.col("t"))).collect()]


def random_texts(alphabet, n=400, size=24, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, size))) for _ in range(n)]


def test_strip_tokens_and_blank(spark):
    texts = random_texts("ab" + SPACES)
    assert values(spark, texts, X.strip) == [t.strip() for t in texts]
    assert values(spark, texts, X.n_tokens) == [len(t.split()) for t in texts]
    assert values(spark, texts, X.blank) == [not t.strip() for t in texts]


def test_file_lines(spark):
    texts = [*random_texts("ab\r\n"), None]
    want = []
    for t in texts:
        x = re.sub("\r\n?", "\n", t or "")
        want.append([] if not x else (x[:-1] if x.endswith("\n") else x).split("\n"))
    assert values(spark, texts, X.file_lines) == want


def test_headers(spark):
    texts = random_texts("#a \t") + ["## Title x ", "####### no", " # yes", "#no", "# "]
    assert values(spark, texts, X.is_header) == [bool(re.match(r"^#{1,6}\s+", t.strip())) for t in texts]
    some = [t for t in texts if re.match(r"^#{1,6}\s+", t.strip())]
    assert values(spark, some, X.header_title) == [re.match(r"^#{1,6}\s+(.*)", t.strip())[1] for t in some]


def plain_density(text):
    """Share of the lines that begin with $$, stand after an odd number of such lines, hold $...$, or a marker."""
    lines = text.split("\n")
    marks = [i for i, x in enumerate(lines) if x.strip().startswith("$$")]
    spans = {j for a, b in itertools.zip_longest(marks[::2], marks[1::2], fillvalue=len(lines)) for j in range(a, b)} | set(marks)
    own = {i for i, x in enumerate(lines) if re.search(r"(?<!\$)\$(?!\$).+?\$(?!\$)", x.strip())}
    named = {i for i, x in enumerate(lines) for m in X.MATH_MARKERS if m in x.strip()}
    return len(spans | own | named) / len(lines)


def test_math_density(spark):
    texts = random_texts("$$a \n\n\\in{^", n=600, size=40) + ["$$x$$\ntext", "a\n$$\nb\n$$\nc", "price $5", "$x$ and $y$", "\\int", ""]
    got = values(spark, texts, X.math_density)
    assert all(abs(a - plain_density(t)) < 1e-12 for a, t in zip(got, texts))


def test_identities(spark):
    row = frame(spark, ["a/b.md"]).select(X.point_id(F.col("t"), F.lit("markdown"), F.lit(3), F.lit(9)), X.base_name(F.col("t")), X.suffix(F.lit(".env")), X.suffix(F.lit("x.tar.gz"))).first()
    m = hashlib.md5(b"a/b.md:markdown:3-9").hexdigest()
    assert tuple(row) == (f"{m[:8]}-{m[8:12]}-{m[12:16]}-{m[16:20]}-{m[20:]}", "b.md", "", ".gz")


def test_vectors(spark):
    rng = random.Random(2)
    pairs = [([rng.uniform(-1, 1) for _ in range(5)], [rng.uniform(-1, 1) for _ in range(5)]) for _ in range(50)] + [([0.0] * 5, [1.0] * 5)]
    got = [r[0] for r in spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a array<double>, b array<double>").orderBy("i").select(V.cosine(F.col("a"), F.col("b"))).collect()]
    for c, (a, b) in zip(got, pairs):
        n = math.hypot(*a) * math.hypot(*b)
        assert abs(c - (sum(x * y for x, y in zip(a, b)) / n if n else 0.0)) < 1e-12


def test_hash_vectors_agree_with_the_provider(spark):
    texts = ["", "a", "text é", "x" * 1000]
    got = values(spark, texts, lambda t: V.hash_vector(t, 24))
    want = HashProvider(24).embed(texts)
    assert all(abs(a - b) < 1e-12 for x, y in zip(got, want) for a, b in zip(x, y)) and abs(math.hypot(*got[1]) - 1) < 1e-12


@settings(max_examples=5, deadline=None)
@given(st.lists(st.floats(-1, 1, allow_nan=False), min_size=30, max_size=60))
def test_fixed_rounds_as_python_does(spark, numbers):
    numbers = [*numbers, 0.03125, 0.00625, 0.00005, -0.03125, 0.5, 1.0, 0.0, 0.12345, 0.99995]
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(numbers)], "i int, v double").orderBy("i")
    assert [r[0] for r in df.select(fixed(F.col("v") + 0.0, 4)).collect()] == [f"{v + 0.0:.4f}".replace("-0.0000", "-0.0000") for v in numbers]
