import hashlib
import random
import struct

import public_tokenizers
import pytest

import corpus_pipeline
from corpus_pipeline import STAGES

from .test_decontaminate import words
from .test_quality_rules import brute as quality
from .test_simhash import brute_components, brute_fingerprint
from .test_substring_dedup import brute as without_repeats

STAGE = dict(STAGES)
NAMES = ["quality_rules", "simhash_near_dedup", "substring_dedup", "benchmark_decontamination", "bpe_codec"]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng, n):
    return " ".join(f"{rng.choice('bcdfgklmnprst')}{rng.choice('aeiou')}{rng.randrange(900)}" for _ in range(n)).capitalize() + "."


def corpus():
    rng = random.Random(21)
    body = lambda k: " ".join(sentence(rng, rng.randrange(4, 14)) for _ in range(k))
    items = [(1, body(3)), (2, body(4)), (3, "short item of six words only"), (None, body(3)), (4, None), (5, "")]
    shared = [body(6), body(7)]
    texts = [body(rng.randrange(4, 12)) for _ in range(40)]
    texts += [f"{body(3)} {shared[i % 2]} {body(3)}" for i in range(10)]
    texts += [f"{body(3)} {items[i % 2][1]} {body(3)}" for i in range(6)] + [f"{body(3)} short item of six words only. {body(2)}"]
    texts += [texts[3], texts[3], texts[4].replace("a", "a", 1) + " end", texts[5].upper()]  # copies
    texts += ["too short", "", None, " ".join(["again and again this one line"] * 30), body(2000)]
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    return rows + [rows[7], (None, texts[8], None, None, None), (None, body(5), None, None, None), (11, body(5), "en", "s", 9)], items


def near(rows):
    prints = [brute_fingerprint(r[1]) for r in rows]
    groups = {}
    for r, c in zip(rows, brute_components(prints)):
        groups.setdefault(c, []).append(r)
    out = []
    for group in groups.values():
        least = min((r[0] is None, r[0] or 0) for r in group)
        out.append([r for r in group if (r[0] is None, r[0] or 0) == least])
    return out  # one of each list stays


def leaked(text, items):
    w, found, full = words(text), set(), False
    for item, body in items:
        v = words(body)
        n = min(8, len(v))
        if item is None or not n:
            continue
        wins = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)}
        if any(tuple(w[i : i + n]) in wins for i in range(len(w) - n + 1)):
            found.add(item)
            full = full or n == 8
    return full or len(found) >= 2


def tokens(text):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = model.encode(text or "", add_special_tokens=False).ids
    decoded = model.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def ordered(rows):
    return sorted(map(str, map(tuple, rows)))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    rows, items = corpus()
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder):
    """Each against brute force, on rows with columns whose names the stages use themselves."""
    assert list(STAGE) == NAMES and [f.__name__ for f in STAGE.values()] == NAMES
    rows, items = corpus()
    docs = spark.createDataFrame([(*r, i, 1, "k") for i, r in enumerate(rows)], COLUMNS + ", row_key int, doc int, root string")
    full = [(*r, i, 1, "k") for i, r in enumerate(rows)]

    got = STAGE["quality_rules"](spark, docs, folder)
    assert got.columns == docs.columns and ordered(got.collect()) == ordered(r for r in full if not quality(r[1])[5])

    got = STAGE["simhash_near_dedup"](spark, docs, folder)
    kept, groups = [tuple(r) for r in got.collect()], near(full)
    assert got.columns == docs.columns and len(kept) == len(groups)
    assert all(len([k for k in kept if k in group]) == 1 for group in groups)

    got = STAGE["substring_dedup"](spark, docs, folder)
    want = without_repeats([r[:2] for r in full])
    assert got.columns == docs.columns
    assert ordered(got.collect()) == ordered((r[0], want[i], r[2], r[3], None if want[i] is None else len(want[i]), *r[5:]) for i, r in enumerate(full))

    got = STAGE["benchmark_decontamination"](spark, docs, folder)
    assert got.columns == docs.columns and ordered(got.collect()) == ordered(r for r in full if not leaked(r[1], items))
    assert sum(leaked(r[1], items) for r in full) >= 6

    got = STAGE["bpe_codec"](spark, docs, folder)
    assert ordered(got.collect()) == ordered((r[0], *tokens(r[1])) for r in full)


def test_run_is_one_stage_after_the_other(spark, folder):
    rows, items = corpus()
    kept = [r for r in rows if not quality(r[1])[5]]
    kept = [min(group, key=str) for group in near(kept)]  # rows of a group that tie are alike here
    text = without_repeats([r[:2] for r in kept])
    kept = [(r[0], text[i]) for i, r in enumerate(kept) if not leaked(text[i], items)]
    got = corpus_pipeline.run(spark, folder).collect()
    assert 30 < len(got) < len(rows) and ordered(got) == ordered((d, *tokens(t)) for d, t in kept)


def test_empty_tables(spark, tmp_path):
    for name, schema in (("documents", COLUMNS), ("benchmark", "item_id long, text string"), ("labels", "doc_id long, quality int, toxic int")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
