import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowloom.llm.quality_classifier import PAGE, SIZES, Described, Logistic, Ones, Ranges, buckets, classify, fit, loss_gradient, metadata, narrowed, present

SF = "/root/testdata/sf0.1"


def test_grams_against_brute_force():
    texts = ["The cat, sat\non a mat", "", "é", "abcdefgh  abcdefgh", "x"]
    owner, found = buckets(texts)
    same = lambda x, y: sorted(map(sorted, x.values())) == sorted(map(sorted, y.values()))
    words = {}
    for i, t in enumerate(texts):
        for w in t.lower().split():
            words.setdefault(w, set()).add(i)
    for n, x in zip((*SIZES, 0), found):
        want = {} if n else words
        for i, t in enumerate(texts):
            s = b" " + t.lower().encode().replace(b"\n", b" ") + b" " * max(SIZES)
            for k in range(len(t.encode()) + 1 if n else 0):
                if b" " not in s[k + 1 : k + n - 1]:
                    want.setdefault(s[k : k + n], set()).add(i)
        got = {}
        for i, b in zip(owner.tolist(), x.tolist()):
            if b >= 0:
                got.setdefault(b, set()).add(i)
        assert same(got, want), n
    i, f = present(["aaaa aaaa", "bbbb"], np.arange(1 << 20, dtype=np.int32))
    assert set(i.tolist()) == {0, 1} and len(set(zip(i.tolist(), f.tolist()))) == len(i)


def test_logistic_reaches_the_optimum():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 5)).astype(np.float32)
    y = (rng.random(300) < 1 / (1 + np.exp(-(x @ [1, -2, 0, 0.5, 0] + 0.3)))).astype(np.float32)
    m = Logistic(x, y, np.ones(300), 1e-3)
    g = x.T @ (1 / (1 + np.exp(-m.logits(x))) - y) / 300 + 1e-3 * m.w
    assert np.abs(g).max() < 1e-4


def test_columns_of_ones_are_a_matrix():
    rng = np.random.default_rng(2)
    dense = (rng.random((40, 7)) < 0.3).astype(float)
    owner, column = np.nonzero(dense)
    ones, w, g = Ones(owner, column, 40, 7), rng.normal(size=7), rng.normal(size=40)
    assert np.allclose(ones @ w, dense @ w) and np.allclose(ones.back(g), dense.T @ g)
    y, weight = (rng.random(40) < 0.5).astype(float), rng.random(40)
    one, two = Logistic(ones, y, weight, 1e-2), Logistic(dense, y, weight, 1e-2)
    assert np.allclose(one.w, two.w) and abs(one.w0 - two.w0) < 1e-9
    # with what others add: two steps from their gradient come near the fit of both together
    more = (rng.random((400, 7)) < 0.3).astype(float)
    label = (rng.random(400) < 1 / (1 + np.exp(-(more @ w)))).astype(float)
    x, z = np.vstack([more[:200], more[200:]]), label
    whole = Logistic(x, z, np.ones(400), 1e-2, rounds=2000)
    half = [Ones(*np.nonzero(part), 200, 7) for part in (more[:200], more[200:])]
    model = Logistic(half[0], label[:200], np.ones(200), 1e-2, rounds=2000)
    first = np.abs(model.w - whole.w).max()
    for _ in range(2):
        linear = loss_gradient(half[1], model, label[200:], np.ones(200)) - loss_gradient(half[0], model, label[:200], np.ones(200))
        model = Logistic(half[0], label[:200], np.ones(200), 1e-2, rounds=2000, linear=linear, scale=2.0, total=400.0, start=model)
    assert np.abs(model.w - whole.w).max() < 0.1 * first


def test_places_of_the_page_view():
    for args in ((None, None, None, ""), ("s", "en", 10**12, "a\nb"), ("", "", -5, "x" * 10_000), ("é" * 99, "zz", 0, "\n" * 3000)):
        found = metadata(*args)
        assert len(set(found)) == 5 and all(0 <= x < PAGE for x in found)
    ranges = Ranges(np.random.default_rng(0).random((50, 8)))
    for x in (-1e9, 0.0, 0.5, 1.0, 1e9):
        found = ranges.places(np.full((3, 8), x))
        assert found.shape == (3, 8) and found.min() >= 0 and found.max() < PAGE and len(set(found[0].tolist())) == 8


@pytest.fixture(scope="module")
def trained(spark):
    """Of the labels two thirds are shown; the rest is judged. With three rounds of exchange, and with none."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    shown = labels.where("doc_id % 3 <> 0")
    truth = {r.doc_id: (r.quality, r.toxic) for r in labels.where("doc_id % 3 = 0").collect()}
    out = []
    for rounds in (3, 0):
        model, whole = fit(narrowed(docs), shown, 8192, rounds, 0.97, 0.003)
        out.append((model, [Described(r.raw, model.features) for r in whole.collect()]))
    return docs, shown, truth, out


def kept_by(model, parts):
    return {int(d): bool(k) for x in parts for d, k in zip(x.doc, model.score(x)[3])}


def test_held_out_accuracy(trained):
    _, _, truth, ((model, parts), _) = trained
    kept = kept_by(model, parts)
    share = lambda kind: np.mean([kept[d] for d, t in truth.items() if t == kind])
    print({k: round(float(share(k)), 4) for k in ((1, 0), (0, 0), (0, 1), (1, 1))}, model.exchanged)
    assert share((1, 0)) > 0.98 and share((0, 0)) < 0.1 and share((0, 1)) < 0.1 and share((1, 1)) < 0.2


def test_both_views_count(trained):
    """Either one taken away changes the scores and what is kept; labels go both ways, and change both views."""
    _, _, _, ((model, parts), (alone, _)) = trained
    assert len(model.exchanged) == 3 and not alone.exchanged
    assert all(r["bad to content"] > 0 and r["good to page"] > 0 and r["bad to page"] > 0 for r in model.exchanged)
    assert sum(r["good to content"] for r in model.exchanged) > 0
    assert all(not np.allclose(a.w, b.w) for a, b in zip(model.views, alone.views))
    assert min(model.both.w) > 0.1 * max(model.both.w)
    whole = kept_by(model, parts)
    for view in (0, 1):
        held = model.both.w
        model.both.w = np.where(np.arange(2) == view, 0.0, held)
        assert sum(whole[d] != k for d, k in kept_by(model, parts).items()) > 20
        model.both.w = held


def test_unlabelled_documents_beyond_any_number(trained):
    """What is handed over grows with the documents: all that are not drawn are judged."""
    _, _, _, ((model, parts), _) = trained
    free = sum(int(x.free.sum()) for x in parts)
    assert free == sum(len(x.doc) for x in parts) - len({int(d) for x in parts for d, f in zip(x.doc, x.free) if not f})
    assert max(r["good to page"] + r["bad to page"] for r in model.exchanged) > 0.2 * free


def test_nulls_ties_and_clashing_columns(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("aeioulmnrst") for _ in range(rng.randrange(2, 8)))
    rows = []
    for i in range(160):
        words = [word() for _ in range(60)]
        if i % 4 == 0:
            words[rng.randrange(60)] = "grumblefix"
        rows.append((i, " ".join(words), f"s{i % 3}", None if i % 5 == 0 else "en", None if i % 7 == 0 else 300, 0.5))
    rows += [(200, None, None, None, None, None), (None, "a b", "s1", "en", 3, 0.1), (1, rows[1][1], "s1", "en", 300, 0.5), (201, "", "", "", -5, 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long, score double")
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(120)] + [(None, 1, 0), (5, None, None), (6, 1, None)], "doc_id long, quality int, toxic int")
    got = classify(docs, labels, max_clean_loss=0.0).collect()
    assert len(got) == len(rows)
    fresh = [r for r in got if r.doc_id is not None and 120 <= r.doc_id < 160]
    assert sum(r.kept == (r.doc_id % 4 != 0) for r in fresh) >= 0.9 * len(fresh)
    assert len({tuple(r) for r in got if r.doc_id == 1}) == 1


@pytest.mark.parametrize("n", [0, 2])
def test_few_labels_judge_nothing(spark, n):
    docs = spark.createDataFrame([(i, "some words") for i in range(4)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(n)], "doc_id long, quality int, toxic int")
    assert [(r.score, r.kept) for r in classify(docs, labels).collect()] == [(0.5, True)] * 4
    assert classify(docs.limit(0), labels).count() == 0
