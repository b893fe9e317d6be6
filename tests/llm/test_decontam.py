import random
import re

from lodestone.llm import decontam
from lodestone.llm.exchange import NO_ID
from tests.llm.helpers import clashing, corpus, frame, vocabulary

ITEMS = "item_id long, text string"
SP = r" \t\n\x0b\x0c\r"


def tokens(text):
    """(typed token, own form) of every word."""
    out, start = [], True
    for m in re.finditer(rf"[^{SP}]+", text or ""):
        w = m[0]
        before = (text or "")[: m.start()]
        gap = re.search(rf"[{SP}]*$", before)[0]
        start = not before.strip(" \t\n\x0b\x0c\r") or "\n" in gap or "\r" in gap or bool(re.search(r"[.!?][\"')\]]*$", before[: len(before) - len(gap)]))
        bare = re.sub(r"^[\"(\[{]+", "", re.sub(r'[.,;:!?)\]}"]+$', "", w))
        if not bare:
            continue
        first = bare[0]
        number = "0" <= first <= "9" or (first in "$€£-+." and len(bare) > 1 and "0" <= bare[1] <= "9")
        last_number = bool(out) and out[-1][0] == "<n>"
        if number:
            out.append(("<n>", bare.lower()))
        elif first != first.lower() and not start:
            out.append(("<p>", bare.lower()))
        elif last_number and bare.lower() in decontam.UNITS:
            out.append(("<u>", bare.lower()))
        else:
            out.append((bare.lower(), bare.lower()))
    return out


def brute(docs, items):
    out = {}
    for d, text in set(docs):
        td = tokens(text)
        for item, itext in items:
            ti = tokens(itext)
            if len(ti) < decontam.LEAST_ITEM:
                continue
            size = min(len(ti), decontam.WINDOW)
            places = [p for p in range(len(ti) - size + 1) if sum(x[0] not in ("<n>", "<p>", "<u>") for x in ti[p : p + size]) >= decontam.LEAST_WORDS]
            form = 0 if places and len(ti) >= decontam.WINDOW else 1  # typed, or as it stands
            places = places if form == 0 else range(len(ti) - size + 1)
            win = {p: [x[form] for x in ti[p : p + size]] for p in places}
            best = None
            for shift in range(-len(ti), len(td)):
                hit = [p for p, w in win.items() if p + shift >= 0 and [x[form] for x in td[p + shift : p + shift + size]] == w]
                if not hit or not (len(hit) + size - 1 >= decontam.LEAST_TOKENS or len(hit) >= decontam.LEAST_SHARE * len(win)):
                    continue
                slots = [(ti[p][1], td[p + shift][1]) for p in range(min(hit), max(hit) + size) if ti[p][0] in ("<n>", "<p>", "<u>") and 0 <= p + shift < len(td) and td[p + shift][0] == ti[p][0]]
                pairs = len(set(slots))
                broken = 2 * pairs - len({a for a, _ in slots}) - len({b for _, b in slots})
                if broken <= decontam.SLACK * pairs or sum(a == b for a, b in slots) >= decontam.SAME * len(slots):
                    got = (len(hit), len(win), len(slots), sum(a != b for a, b in slots))
                    best = max(best or got, got)
            if best:
                out[d, item] = best
    return out


def found(spark, docs, items):
    got = decontam.leaks(frame(spark, docs), spark.createDataFrame(items, ITEMS)).collect()
    return {(None if r["_doc"] == NO_ID else r["_doc"], r["item_id"]): (r["n_matched"], r["n_windows"], r["n_slots"], r["n_changed"]) for r in got}


QUESTION = 'A train leaves London at 9 am and covers 120 km in 2 hours before it meets Anna, who walks 5 km "in a day" with Berta.'
CHANGED = "A train leaves Paris at 7 am and covers 350 km in 3 hours before it meets Carla, who walks 8 km in a day with Dora."
UNEVEN = "A train leaves Paris at 7 am and covers 350 km in 3 hours before it meets Carla, who walks 350 km in a day with Carla."


def test_copy_changed_values_and_inconsistent_slots(spark):
    docs = [(1, f"Some talk first. {QUESTION} More talk."), (2, f"Intro here.\n{CHANGED}\nThe end."), (3, UNEVEN), (4, "A train leaves now, nothing else is alike here at all."), (5, None), (6, ""), (None, CHANGED), (2, f"Intro here.\n{CHANGED}\nThe end.")]
    items = [(1, QUESTION), (2, None), (3, ""), (4, "Too few words"), (5, QUESTION)]
    got = found(spark, docs, items)
    assert got == brute(docs, items)
    assert {k[0] for k in got} == {1, 2, None} and got[2, 1][3] > 0 and got[1, 1][3] == 0


def test_random_texts_against_brute_force(spark):
    rng = random.Random(6)
    vocab = vocabulary(rng, 60)

    def sentence(n):
        w = [rng.choice(vocab) for _ in range(n)]
        for i in range(n):
            x = rng.random()
            w[i] = str(rng.randint(1, 999)) if x < 0.08 else w[i].capitalize() if x < 0.15 else "km" if x < 0.18 else f"({w[i]})," if x < 0.22 else w[i]
        return " ".join(w) + rng.choice([".", "?", '!"', "\n"])

    items = [(i, " ".join(sentence(rng.randint(2, 16)) for _ in range(rng.randint(1, 4)))) for i in range(30)]
    docs = []
    for i in range(60):
        parts = [sentence(rng.randint(3, 20)) for _ in range(6)]
        if i % 2:
            q = items[i % 30][1]
            parts.insert(3, re.sub(r"\d+", lambda m: str(int(m[0]) + 1), q) if i % 3 else q)
        docs.append((i, " ".join(parts)))
    got = found(spark, docs, items)
    assert got == brute(docs, items) and len(got) >= 25


def test_decontaminate_keeps_the_rest(spark):
    rows = corpus()
    docs = clashing(frame(spark, [*rows, (900, f"x. {CHANGED}")]))
    items = spark.createDataFrame([(1, QUESTION, "own")], ITEMS + ", size string")
    out = decontam.decontaminate(docs, items)
    assert out.columns == docs.columns and out.exceptAll(docs.where("doc_id is null or doc_id <> 900")).isEmpty() and out.count() == len(rows)
    assert decontam.decontaminate(frame(spark, rows), items.limit(0)).count() == len(rows)
    assert decontam.decontaminate(frame(spark, []), items).count() == 0


def test_large_benchmark_is_joined_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BROADCAST_WINDOWS", 0)
    docs, items = [(1, QUESTION), (2, CHANGED)], [(1, QUESTION)]
    assert found(spark, docs, items) == brute(docs, items)


def test_plan_is_native(spark):
    plan = decontam.leaks(frame(spark, [(1, QUESTION)]), spark.createDataFrame([(1, QUESTION)], ITEMS))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_query(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    holders = {(d, i) for d, t in docs for i, x in items if len(tokens(x)) >= 13 and x in t}
    got = {(r["doc_id"], r["item_id"]) for r in decontam.op4_query(spark, sf_dir).collect()}
    assert holders <= got and got == set(brute(docs, items))


def test_short_items(spark):
    docs = [(1, "Yes, the answer is here."), (2, "He asked: What is 12 times 7? Nobody knew."), (3, "What is 13 times 8?"), (4, "One two three four."), (5, "one Two three"), (6, "Read 1 2 3 4 5 6 7 8 9 10 aloud"), (7, "Read 1 2 3 4 5 6 7 8 9 11 aloud")]
    words = "alpha beta gamma delta epsilon zeta eta".split()
    items = [(1, "Yes"), (2, "What is 12 times 7?"), (3, "one two three"), (4, "1 2 3 4 5 6 7 8 9 10")] + [(10 + n, " ".join(words[:n])) for n in range(1, 8)]
    docs += [(20 + n, "so " + " ".join(words[:n]) + " and on") for n in range(1, 8)]
    got = found(spark, docs, items)
    assert got == brute(docs, items)
    assert {(2, 2), (6, 4)} <= set(got) and not {d for d, i in got if i in (1, 3)} and {(d, i) for d, i in got if i > 10} == {(20 + d, 10 + i) for i in range(4, 8) for d in range(i, 8)}


def test_a_clash_of_few_slots_is_no_escape(spark):
    item = "A shop sells 2 apples and 2 pears for 14 coins while Anna buys 6 plums and 9 figs from Berta and then 3 nuts for 8 coins in Rome."
    uneven = item.replace("2 apples", "3 apples").replace("2 pears", "5 pears")
    typo = item.replace("14 coins", "9 coins")
    docs, items = [(1, uneven), (2, typo), (3, f"Once. {typo} Then.")], [(1, item)]
    got = found(spark, docs, items)
    assert got == brute(docs, items) and {d for d, _ in got} == {1, 2, 3}
