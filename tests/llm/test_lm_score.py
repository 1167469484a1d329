import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from rowloom.llm.common import narrow
from rowloom.llm.lm_score import END, HELD_OUT, SAMPLES, STRENGTH, Pairs, draw, fit, numbers_of, score_documents, stirling, uniform, word_hash
from rowloom.llm.packing import pack, unpack


def brute(rows):
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + ["\n"]
    c = Counter(w for d, t in rows if not held(d) for w in words(t))
    n, v = sum(c.values()), len(c)
    out = []
    for d, t in rows:
        w = words(t)
        out.append((d, held(d), len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 6)))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(8)
    vocab = {k: [f"{k}{i}" for i in range(300)] for k in "ab"}
    rows = []
    for i in range(300):
        k = "ab"[i % 2]
        rows.append((i, " ".join(w + ("e" if k == "a" else "o") for w in rng.choices(vocab[k], weights=[1 / (j + 1) for j in range(300)], k=rng.randrange(5, 80)))))
    return rows + [(400, None), (401, ""), (402, " \n"), (3, rows[3][1]), (None, "null id"), (403, "THE The é É"), (404, "long " * 30_000)]


def test_base_columns_and_model(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, block int")
    got = score_documents(docs).collect()
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=str) == brute(rows)
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    unseen = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 300]
    perplexity = lambda f: 10 ** (-sum(map(f, unseen)) / sum(r.n_tokens for r in unseen))
    assert perplexity(lambda r: r.score) < 0.8 * perplexity(lambda r: r.base_score)


def fitted(spark, rows, homes):
    """One slab of all rows: its words, pairs, and what the homes answer about them."""
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    cut, answered, hot, parent = fit(narrow(docs).withColumn("held_out", F.expr(HELD_OUT)), homes)
    (row,) = cut.collect()
    (_, _, _, _, end, in_home), (ids,), (hashes,) = unpack(row.docs), unpack(row.ids), unpack(row.vocabulary)
    pairs = Pairs(ids, int(end[0]), in_home, numbers_of(hashes, hot))
    parts = [unpack(r.blob) for r in sorted(answered.collect(), key=lambda r: r.home)]
    return pairs, hashes, [np.concatenate(x).astype(float) for x in zip(*parts)], parent, hot


def test_probabilities_sum_to_one(spark):
    """In every restaurant the seated customers' shares and what is left to the parent make up all customers, and in the parent."""
    for homes in (1, 3):
        pairs, hashes, (count, *rest), parent, hot = fitted(spark, corpus(), homes)
        customers, tables, value = np.array(rest[:SAMPLES]), np.array(rest[SAMPLES : 2 * SAMPLES]), rest[-1]
        seated = np.bincount(pairs.u, weights=value, minlength=len(hashes))
        assert np.allclose(seated + parent.discount * tables.mean(axis=0), count, rtol=1e-5)
        whole = customers.sum(axis=1) + parent.new * (parent.vocabulary + 1)
        assert np.allclose(whole, STRENGTH + parent.customers, rtol=1e-5)
        assert 0 < len(hot) < len(hashes) and (count > 0).sum() == parent.vocabulary


def test_counts_against_brute_force(spark):
    rows = corpus()
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    want, single = Counter(), Counter()
    for d, t in rows:
        words = [END, *(t or "").encode().lower().split(), END]
        want.update({p: 0 for p in zip(words, words[1:])} if held(d) else Counter(zip(words, words[1:])))
        single.update({w: 0 for w in words} if held(d) else Counter(words[1:]))
    pairs, hashes, (count, *rest), parent, _ = fitted(spark, rows, 2)
    assert {int(h): int(c) for h, c in zip(hashes, count)} == {word_hash(w): n for w, n in single.items()}
    value = {(int(hashes[u]), int(hashes[w])): v for u, w, v in zip(pairs.u, pairs.w, rest[-1])}
    assert set(value) == {(word_hash(u), word_hash(w)) for u, w in want}
    for (u, w), n in want.items():
        v = value[word_hash(u), word_hash(w)]
        assert v == 0 if n == 0 else math.isclose(v, 1 - parent.discount, rel_tol=1e-5) if n == 1 else (n * (1 - parent.discount)) * (1 - 1e-5) <= v <= (n - parent.discount) * (1 + 1e-5)


def partitions(items):
    if not items:
        yield []
        return
    for rest in partitions(items[1:]):
        yield [[items[0]], *rest]
        for i in range(len(rest)):
            yield [*rest[:i], [items[0], *rest[i]], *rest[i + 1 :]]


def test_stirling_numbers_against_all_seatings():
    d = 0.4
    found = stirling(d, 8)
    for n in range(1, 8):
        want = Counter()
        for seating in partitions(list(range(n))):
            want[len(seating)] += math.prod(math.gamma(len(x) - d) / math.gamma(1 - d) for x in seating)
        for t in range(1, n + 1):
            assert math.isclose(math.exp(found[n, t]), want[t], rel_tol=1e-9)


def test_draws_follow_the_conditional():
    d, trials = 0.6, 40_000
    key = np.arange(trials, dtype=np.uint64)
    inner = stirling(d)
    for n, a in ((2, 0.7), (7, 2.0), (40, 0.3)):
        weight = np.array([math.exp(inner[n, t] + sum(math.log((a + d * i) * 0.2) for i in range(t))) for t in range(1, n + 1)])
        got = draw(np.full(trials, n), np.full(trials, a), d, np.full(trials, 0.2), 0.0, inner, d, uniform(key, 1), key, 0)
        share = np.bincount(got, minlength=n + 1)[1:] / trials
        assert np.abs(share - weight / weight.sum()).max() < 0.01
    # beyond the table: against a table that goes further
    long = stirling(d, 2000)
    for n in (300, 2000):
        weight = np.array([long[n, t] + sum(math.log((500 + d * i) * 0.01) for i in range(t)) for t in range(1, n + 1)])
        weight = np.exp(weight - weight.max())
        mean = (weight * np.arange(1, n + 1)).sum() / weight.sum()
        got = draw(np.full(2000, n), np.full(2000, 500.0), d, np.full(2000, 0.01), 0.0, inner, d, uniform(key[:2000], 1), key[:2000], 0)
        assert abs(got.mean() - mean) < 0.05 * mean and got.min() >= 1 and got.max() <= n


def test_scores_do_not_depend_on_batches_and_splits(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string")
    runs = []
    for parts, batch in ((1, 10_000), (7, 20)):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        runs.append(sorted(((str(r.doc_id), round(r.score, 6)) for r in score_documents(docs.repartition(parts)).collect())))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert runs[0] == runs[1]


def test_packing():
    arrays = [np.arange(1000), np.zeros(0, dtype=np.int64), np.array([-5, 2**40]), np.array([2**63 + 1], dtype=np.uint64), np.array([True, False]), np.linspace(0, 1, 50, dtype=np.float32)]
    got = unpack(pack(*arrays))
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(arrays, got, strict=True))


def test_each_preceding_word_is_a_context(spark):
    """All words end alike, so that they are of one class; each decides the next one."""
    rng = random.Random(6)
    rows = []
    for i in range(400):
        at = rng.randrange(200)
        rows.append((i, " ".join(f"{(at + j) % 200}xx" for j in range(40))))
    got = [r for r in score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.held_out]
    perplexity = lambda f: 10 ** (-sum(map(f, got)) / sum(r.n_tokens for r in got))
    assert perplexity(lambda r: r.score) < 0.1 * perplexity(lambda r: r.base_score)


def test_empty(spark):
    assert score_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    only = score_documents(spark.createDataFrame([(i, "a") for i in range(40) if zlib.crc32(str(i).encode()) % 7 == 2], "doc_id long, text string")).collect()
    assert only and all(r.n_known == 0 and r.train_tokens == 0 for r in only)
