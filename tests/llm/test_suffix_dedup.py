import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowloom.llm.common import narrow, with_key
from rowloom.llm.suffix_array import equal_runs, suffix_array
from rowloom.llm.suffix_dedup import dedup_bytes, of_documents, repeated_minimizers, repeated_stretches, shared_parts


def brute(rows, length):
    seen, out = {}, []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        b = (text or "").encode()
        gone = set()
        for i in range(len(b) - length + 1):
            s = b[i : i + length]
            if s in seen:
                gone.update(range(i, i + length))
            else:
                seen[s] = doc
        spans = sum(1 for i in gone if i - 1 not in gone)
        kept = bytes(x for i, x in enumerate(b) if i not in gone)
        out.append((doc, len(b), len(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_two_stage_sorting():
    rng = random.Random(1)
    for alphabet in (b"ab", b"abc\xc3\xa9 \0", b"a"):
        pieces = [bytes(rng.choices(alphabet, k=rng.randrange(1, 60))) for _ in range(80)]
        data = b"".join(p + b"\xff" for p in pieces)
        got = suffix_array(np.frombuffer(data, dtype=np.uint8), 70)
        assert sorted(got.tolist()) == list(range(len(data)))
        keys = [data[i : i + 70] for i in got.tolist()]
        assert keys == sorted(keys)
        whole = [i for i in got.tolist() if i + 5 <= len(data)]
        classes = equal_runs(np.frombuffer(data, dtype=np.uint8), np.array(whole), 5).tolist()
        for (i, c), (j, d) in zip(zip(whole, classes), zip(whole[1:], classes[1:])):
            assert (c == d) == (data[i : i + 5] == data[j : j + 5])


@pytest.mark.parametrize("dense", [100_000, 1])
def test_against_brute_force(spark, dense):
    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("abcdefgh é\n") for _ in range(n))
    shared = [text(rng.randrange(90, 400)) for _ in range(6)]
    rows = []
    for i in range(80):
        parts = [text(rng.randrange(150))]
        for _ in range(rng.randrange(4)):
            s = rng.choice(shared)
            a = rng.randrange(40)
            parts += [s[a : len(s) - rng.randrange(40)], text(rng.randrange(60))]
        rows.append((i, "".join(parts)))
    rows += [(100, rows[4][1]), (101, rows[4][1]), (102, None), (103, ""), (104, "xy" * 400), (105, "xy" * 300 + shared[0]), (106, "z" * 99), (107, "z" * 99), (108, "ab c" * 5000), (None, shared[1])]
    rows += [(110 + i, text(30) + shared[2] + text(30)) for i in range(40)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, found int")
    got = sorted((tuple(r) for r in dedup_bytes(docs, dense=dense).collect()), key=str)
    assert got == brute(rows, 100)


def test_a_phrase_that_many_documents_share(spark):
    """90 bytes in surroundings of their own hold no repeat, and 130 bytes do; the minimizers of either have more stretches than a
    task may hold, so that strings are dealt out one by one."""
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    notice, passage = text(90), text(130)
    rows = [(i, text(60) + (passage if i % 10 == 0 else notice) + text(60)) for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    data = with_key(narrow(docs))
    minimizers = of_documents(data, repeated_minimizers(data, 100), 100)
    parts = repeated_stretches(data, minimizers, 100).where("row_key is null")
    assert parts.groupBy("m").count().agg(F.max("count")).first()[0] > 400
    for dense in (100_000, 100):
        got = sorted((tuple(r) for r in dedup_bytes(docs, dense=dense).collect()), key=str)
        assert got == brute(rows, 100)
    assert 119 * 130 <= sum(r[2] for r in got) < 119 * 134  # what borders on the passage may agree by chance


def test_parts_that_drop_out_hold_no_common_string():
    rng = random.Random(7)
    text = lambda n: bytes(rng.choices(b"abcd", k=n))
    for _ in range(60):
        size, core = 100, text(32)
        group = []
        around = [(text(68), text(68)) for _ in range(3)]
        for i in range(6):
            left, right = rng.choice(around)[0][rng.randrange(69) :], rng.choice(around)[1][: rng.randrange(69)]
            if len(left) + 32 + len(right) >= size:
                group.append((i, i, 0, len(left), left + core + right))
        kept = shared_parts(group, size)
        strings = lambda x: [x[i : i + size] for i in range(len(x) - size + 1)]
        for j, (_, _, _, c, x) in enumerate(group):
            covered = {(i0 + k) for i, i0, y in kept if i == j for k in range(len(y) - size + 1)}
            for k, y in enumerate(strings(x)):
                # equal strings have the core at the same place
                if any(y == g[4][c2 - c + k : c2 - c + k + size] for jj, g in enumerate(group) if jj != j for c2 in [g[3]] if c2 - c + k >= 0):
                    assert k in covered


def test_repeated_rows_and_empty(spark):
    t = "".join(random.Random(2).choices("abcdefgh", k=300))
    got = dedup_bytes(spark.createDataFrame([(1, t), (1, t), (2, t)], "doc_id long, text string"), texts=True).collect()
    assert sorted((r.doc_id, r.n_removed, bytes(r.kept)) for r in got) == [(1, 0, t.encode()), (1, 0, t.encode()), (2, 300, b"")]
    assert dedup_bytes(spark.createDataFrame([], "doc_id long, text string")).count() == 0
