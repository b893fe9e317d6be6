import string

from lodestone.llm import sentences, textnp
from lodestone.llm.exchange import NO_ID
from tests.llm.helpers import clashing, corpus, frame, lower, vocabulary


def runs_of(text):
    """(start, stop, key) of every run, by bytes, stated word by word."""
    data, words, at = text.encode(), [], None
    for p, c in enumerate(data + b" "):
        if c in b" \t\n\x0b\x0c\r":
            if at is not None:
                words.append((at, p))
                at = None
        elif at is None:
            at = p
    ends = []
    for n, (_, e) in enumerate(words):
        after = data[e : words[n + 1][0]] if n + 1 < len(words) else b""
        ends.append(data[e - 1 : e] in (b".", b"!", b"?") or any(x in after for x in b"\n\x0b\x0c\r") or n == len(words) - 1)
    found, cur = [], []
    for n in range(len(words)):
        cur.append(n)
        if ends[n] or len(cur) == sentences.LONGEST:
            found.append(cur)
            cur = []

    def bare(n):
        w = lower(data[words[n][0] : words[n][1]].decode())
        while len(w) > 1 and w[-1] in string.punctuation:
            w = w[:-1]
        while len(w) > 1 and w[0] in string.punctuation:
            w = w[1:]
        return w

    out = []
    for i in range(len(found)):
        j, held = i, []
        while j < len(found) and (j - i < sentences.RUN or len(held) < sentences.LEAST_WORDS):
            held += found[j]
            j += 1
        full = j - i >= sentences.RUN and len(held) >= sentences.LEAST_WORDS
        if full or i == 0:
            out.append((held[0], held[-1] + 1, full))
    # windows: from sentences, to their ends, and from anchors, where they hold no full run
    runs = [(a, b) for a, b, full in out if full]
    begins = {x[0] for x in found} | {x[-1] + 1 - sentences.PASSAGE for x in found} | anchors_of(text)
    begins = [p for p in sorted(begins) if p >= 0 and p + sentences.PASSAGE <= len(words)]
    windows = [(p, p + sentences.PASSAGE) for p in begins if not any(p <= a and b <= p + sentences.PASSAGE for a, b in runs)]
    named = [(a, b, False) for a, b, _ in out] + [(a, b, True) for a, b in windows]
    return [(words[a][0], words[b - 1][1], (window, *map(bare, range(a, b)))) for a, b, window in named]


def anchors_of(text):
    """Places of words whose pair hash is the smallest of GAP neighbouring ones; of equal ones the last."""
    buf, _ = textnp.joined([text.encode()])
    h = textnp.words(buf, bare=True)[1]
    pair = [int(textnp.combine(h[i : i + 1], h[i + 1 : i + 2] if i + 1 < len(h) else h[:1] * textnp.U(0))[0]) for i in range(len(h))]
    spans = (pair[i : i + sentences.GAP] for i in range(len(pair) - sentences.GAP + 1))
    return {i + max(j for j, x in enumerate(some) if x == min(some)) for i, some in enumerate(spans)}


def brute(rows):
    docs = sorted({(i is not None, i or 0, t or "") for i, t in rows}, key=lambda d: (d[0], d[1]))
    first, out = {}, {}
    for n, (known, i, text) in enumerate(docs):
        gone = []
        for start, stop, key in sorted(runs_of(text)):
            if key not in first:
                first[key] = (n, start, stop)
                continue
            m, a, b = first[key]
            if m == n and (start < b if key[0] else start == a):
                continue  # a window overlaps its first place
            if gone and start < gone[-1][1]:
                gone[-1] = (gone[-1][0], max(gone[-1][1], stop))
            else:
                gone.append((start, stop))
        if gone:
            out[i if known else NO_ID, text] = gone
    return out


def spans(spark, rows):
    got = {}
    for r in sentences.removed_spans(frame(spark, rows)).collect():
        got.setdefault(r["_doc"], []).append((r["start"], r["stop"]))
    return {k: sorted(v) for k, v in got.items()}


def test_mixed_corpus_against_brute_force(spark):
    rows = [r for r in corpus(n=80) if r[0] is not None]
    assert spans(spark, rows) == {k[0]: v for k, v in brute(rows).items()}


def test_long_passage_is_found_wherever_it_stands(spark):
    import random

    rng = random.Random(2)
    vocab = vocabulary(rng)
    line = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passage = ". ".join(line(9).capitalize() for _ in range(7)) + "."
    rows = [(1, line(30) + ". " + passage + " " + line(8)), (2, passage), (3, line(15) + ".\n" + passage + "\n" + line(15)), (4, line(200))]
    got = spans(spark, rows)
    assert set(got) == {2, 3} and all(stop - start >= 0.9 * len(passage.encode()) for v in got.values() for start, stop in v)


def test_removal_leaves_the_rest(spark):
    text = "One two three four five. Six seven eight nine ten. Eleven twelve thirteen fourteen. "
    rows = [(1, text), (2, "Own words here come first. " + text + "Own words end."), (3, None), (4, ""), (None, "alone")]
    out = {r["doc_id"]: r["text"] for r in sentences.remove_repeated_sentences(frame(spark, rows)).collect()}
    assert out[1] == text and out[2] == "Own words here come first.  Own words end." and out[3] is None and out[4] == "" and out[None] == "alone"


def test_equal_rows_are_one_document_and_columns_stay(spark):
    rows = corpus()
    docs = clashing(frame(spark, rows))
    out = sentences.remove_repeated_sentences(docs)
    same = [c for c in docs.columns if c != "text"]
    assert out.columns == docs.columns and out.count() == docs.count() and out.select(*same).exceptAll(docs.select(*same)).isEmpty()
    assert sentences.remove_repeated_sentences(frame(spark, [(1, "Same text of one row, twice in the table."), (1, "Same text of one row, twice in the table.")])).where("text = ''").count() == 0
    assert sentences.remove_repeated_sentences(frame(spark, [])).count() == 0


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = {}
    for r in sentences.op2_query(spark, sf_dir).collect():
        got.setdefault(r["doc_id"], []).append((r["start_byte"], r["stop_byte"]))
        assert r["first_doc_id"] <= r["doc_id"]
    assert {k: sorted(v) for k, v in got.items()} == {k[0]: v for k, v in brute(rows).items()}


def test_long_passages_of_few_sentence_ends_are_found(spark):
    import random

    rng = random.Random(8)
    vocab = vocabulary(rng, 3000)
    some = lambda n: [rng.choice(vocab) for _ in range(n)]
    rows, sizes = [], {}
    for ends in (0, 1, 2):
        for case in range(12):
            words = some(51 + case)
            for i in range(ends):
                words[(i + 1) * len(words) // (ends + 1)] += "."
            passage = " ".join(words)
            first, again = 1000 * ends + case, 1000 * ends + 500 + case
            rows += [(first, " ".join([*some(7 + case), passage, *some(30)])), (again, " ".join([*some(3 * case + 20), passage, *some(9)]))]
            sizes[again] = len(passage.encode())
    text = dict(rows)
    got = spans(spark, rows)
    assert set(got) == set(sizes)
    for i, v in got.items():  # at most GAP - 1 words stay at an end
        held = text[i].encode()
        assert sum(len(held[a:b].split()) for a, b in v) >= 51 - 2 * (sentences.GAP - 1)
        assert all(any(held[a:b] in t.encode() for j, t in rows if j != i) for a, b in v)


def test_windows_that_overlap_their_first_place_stay(spark):
    text = "ha " * 60
    assert spans(spark, [(1, text)]) == {k[0]: v for k, v in brute([(1, text)]).items()}
    assert spans(spark, [(1, text), (2, "Other words. " + text)])[2]


def test_levels_of_the_exchange_change_nothing(spark, monkeypatch):
    """Blocks dealt over few partitions, folded and dealt again, give the same spans."""
    from lodestone.llm import exchange

    rows = [r for r in corpus(n=80) if r[0] is not None]
    want = spans(spark, rows)
    monkeypatch.setattr(exchange, "FAN", 4)
    monkeypatch.setattr(exchange, "BLOCK", 3000)
    assert len(exchange.deal_for(frame(spark, rows)).parts) > 1
    assert spans(spark, rows) == want


def test_thue_morse_words_are_told_apart(spark):
    bits = "".join("ab"[bin(i).count("1") % 2] for i in range(4096))
    other = bits.translate(str.maketrans("ab", "ba"))
    rest = ". ".join(" ".join(f"w{i}{j}" for j in range(6)) for i in range(3)) + "."
    rows = [(1, f"{bits} {rest}"), (2, f"{other} {rest}")]
    assert all(start >= 4096 for v in spans(spark, rows).values() for start, _ in v)
