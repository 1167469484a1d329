import random
import re

import pytest
import xxhash

from rowloom.llm.components import components
from rowloom.llm.simhash import group_links, keep_one, near_duplicates, variant_links

SCHEMA = "doc_id long, text string"


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    """fps: list; returns the index of each one's component."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("hot", [100_000, 40])
def test_links_match_brute_force(spark, hot):
    rng = random.Random(5)
    fps = set()
    for _ in range(60):
        base = rng.getrandbits(64)
        fps.add(base)
        for _ in range(rng.randrange(12)):
            x = base
            for _ in range(rng.randrange(1, 5)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    dense = rng.getrandbits(64)  # one tight group
    fps |= {dense ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(1500)}
    fps = sorted(fps)
    signed = [x - 2**64 if x >= 2**63 else x for x in fps]
    links = variant_links(spark.createDataFrame([(x,) for x in signed], "fp long"), hot)
    pairs = [(r.a % 2**64, r.b % 2**64) for r in links.collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in pairs)
    place = {x: i for i, x in enumerate(fps)}
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        x, y = find(place[a]), find(place[b])
        root[max(x, y)] = min(x, y)
    assert [find(i) for i in range(len(fps))] == brute_components(fps)
    roots = {r.node: r.root for r in components(links).collect()}
    assert len({roots.get(x, x) for x in signed}) == len(set(brute_components(fps)))


def test_documents(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    base = [" ".join(rng.choices(words, k=120)) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i, t in enumerate(base[:6]):
        near = t.split()
        near[60] = "CHANGED"
        rows += [(100 + i, " ".join(near)), (200 + i, t.upper())]
    rows += [(300, None), (301, ""), (302, " \n"), (303, "one"), (304, "ONE"), (None, base[0]), (5, base[5]), (305, "Ä b"), (306, "x " * 50_000)]
    docs = spark.createDataFrame([(*r, "src") for r in rows], SCHEMA + ", component_id string")  # a clashing name
    got = near_duplicates(docs).collect()
    fps = [brute_fingerprint(t) for _, t in rows]
    comps = brute_components(fps)
    least = {}
    for (d, _), c in zip(rows, comps):
        if d is not None:
            least[c] = min(d, least.get(c, d))
    want = sorted(((d, f"{f:016x}", least[c]) for (d, _), f, c in zip(rows, fps, comps)), key=str)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=str) == want
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(least.values()))


def test_unrelated_rows_without_doc_id_all_stay(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choices([f"w{i}" for i in range(300)], k=80)) for _ in range(6)]
    rows = [(None, t) for t in texts] + [(None, texts[0]), (7, texts[1])]
    kept = keep_one(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted([(None, t) for t in texts if t != texts[1]] + [(7, texts[1])], key=str)


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_large_groups_are_cut_again(monkeypatch):
    """With so small a limit that pieces are cut several times over."""
    import numpy as np

    from rowloom.llm import simhash

    monkeypatch.setattr(simhash, "DENSE", 8)
    rng = random.Random(3)
    fixed = rng.getrandbits(32) << 32
    for bit in (0, 7):
        centres = [rng.getrandbits(32) for _ in range(12)]
        fps = sorted({fixed | (c ^ (1 << rng.randrange(32)) ^ (1 << rng.randrange(32))) ^ (rng.randrange(2) << 32 + bit) for c in centres for _ in range(60)})
        side = lambda x: x >> 32 + bit & 1  # noqa: E731, B023
        want = [(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if (a ^ b).bit_count() <= 3 and (bit == 0 or side(a) != side(b)) and (a & (2**32 - 1) ^ b & (2**32 - 1)).bit_count() >= 2]
        got = group_links(np.array(fps, dtype=np.uint64), 1, bit)
        assert all((a ^ b).bit_count() <= 3 for a, b in got)

        def sets(pairs):
            root = {x: x for x in fps}  # noqa: B023

            def find(x):
                while root[x] != x:  # noqa: B023
                    x = root[x]  # noqa: B023
                return x

            for a, b in pairs:
                root[max(find(a), find(b))] = min(find(a), find(b))
            return [find(x) for x in fps]  # noqa: B023

        assert sets(got) == sets(want) and len(got) < len(fps)
