import hashlib
import random
import re

import pytest

from rowloom.llm.decontaminate import contamination, drop_leaked


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window=8):
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for item, body in items:
            v = words(body)
            n = min(window, len(v))
            if item is None or not n:
                continue
            wins = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)}
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in wins:
                    hit.update(range(i, i + n))
                    found.add(str(item))
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(found), digest, len(found) >= 2))
    return sorted(out, key=str)


@pytest.mark.parametrize("one_word", [False, True])
@pytest.mark.parametrize("limit", [300_000, 0])
def test_against_brute_force(spark, one_word, limit):
    rng = random.Random(4)
    text = lambda n: " ".join(rng.choice(["the", "of", "An", "é"]) + rng.choice(["", "x", "Y", "9"]) for _ in range(n))
    items = [(i, text(rng.randrange(5, 30))) for i in range(15)] + [(3, "again the same id here now and then some more"), (20, ""), (21, None), (None, "never counted " * 9), (22, "the of the")]
    items += [(23, "Anx")] if one_word else []
    docs = []
    for i in range(60):
        parts = [text(rng.randrange(0, 40))]
        if i % 2:
            v = items[rng.randrange(15)][1].split()
            parts.append(", ".join(v[rng.randrange(3) :]))
            parts.append(text(5))
        docs.append((i, " ".join(parts)))
    docs += [(60, None), (61, ""), (62, "  ..."), (5, docs[5][1]), (None, docs[7][1]), (63, docs[7][1] * 300)]
    d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, w string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((tuple(r) for r in contamination(d, b, broadcast_windows=limit).collect()), key=str)
    assert got == brute(docs, items)


@pytest.mark.parametrize("limit", [300_000, 20])
def test_windows_that_many_items_share(spark, limit):
    """What is broadcast is counted with its items; separators of every kind; columns that clash."""
    passage = " ".join(f"word{i}" for i in range(12))
    items = [(i, f"own{i} {passage} end{i}") for i in range(40)]
    rng = random.Random(2)
    marks = [chr(c) for c in [*range(1, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]]
    docs = [(i, "".join(w + rng.choice(marks) for w in (passage.upper() if i % 2 else f"x {passage[:40]} y").split())) for i in range(60)] + [(60, None), (3, None)]
    d = spark.createDataFrame([(*r, "x", 1, 2) for r in docs], "doc_id long, text string, words string, row_key int, doc int")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((tuple(r) for r in contamination(d, b, broadcast_windows=limit).collect()), key=str)
    assert got == brute(docs, items) and max(r[3] for r in got) == 40
    kept = drop_leaked(d, b)
    assert kept.columns == d.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted([str(i) for i in range(0, 60, 2)] + ["60", "3"])


def test_leaked_documents_go(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    docs = spark.createDataFrame([(1, "a b c"), (2, f"x {passage} y"), (3, None), (4, "short item")], "doc_id long, text string")
    b = spark.createDataFrame([(1, passage), (2, "short item")], "item_id long, text string")
    assert sorted(r.doc_id for r in drop_leaked(docs, b).collect()) == [1, 3, 4]


def test_empty(spark):
    d, b = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert contamination(d, b).count() == 0
    assert contamination(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), b).first().n_items == 0
