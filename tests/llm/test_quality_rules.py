import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowloom.llm.quality_rules import IsolationForest, keep_good, path_constant, quality_rules

SF = "/root/testdata/sf0.1"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows, hit = {}, set()
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    for at in windows.values():
        if len(at) > 1:
            hit.update(j for i in at for j in range(i, i + 8))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(hit), len(words) < 20 or 100 * len(hit) > 30 * len(words)


def hostile():
    rng = random.Random(3)
    texts = [None, "", " ", "\n\n", "a", "a\x1cb c\x85d\u2003e\xa0f", "# * $ % & | < > ##", "é ü\x0bx\x0cy\rz\tw", "x " * 40_000, "one two three four five six seven eight " * 2, "same line\nsame line\n same line\nsame line \r\n\t\n"]
    for _ in range(60):
        lines = [" ".join(rng.choice("ab#é$XY9") * rng.randrange(1, 5) for _ in range(rng.randrange(30))) for _ in range(rng.randrange(1, 8))]
        texts.append("\n".join(lines + rng.sample(lines, rng.randrange(len(lines)))))
    return texts


def test_counts_against_brute_force(spark):
    texts = hostile()
    rows = [(i, t) for i, t in enumerate(texts)] + [(7, texts[7]), (None, texts[12])]
    docs = spark.createDataFrame([(*r, 1.0, "x") for r in rows], "doc_id long, text string, anomaly double, kept string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality_rules(docs, labels).collect()
    assert sorted((str(r.doc_id), *(r[c] for c in COUNTS)) for r in got) == sorted((str(d), *brute(t)) for d, t in rows)
    assert all(r.kept == (not r.base_failed) for r in got)  # nothing to calibrate with
    stay = keep_good(docs, labels)
    assert stay.columns == docs.columns
    assert sorted(map(str, stay.collect())) == sorted(str(r) for r in docs.collect() if not brute(r.text)[5])


def test_paths_isolate_the_odd_one():
    rng = np.random.default_rng(0)
    rows = np.vstack([rng.normal(size=(300, 2)), [[9.0, -9.0]]])
    score = IsolationForest(rows, trees=50, seed=1).score(rows)
    assert score.argmax() == 300 and score[300] > 0.6 and np.median(score) < 0.5
    assert path_constant(1) == 0 and path_constant(2) == 1 and abs(path_constant(256) - 10.24) < 0.01


def test_paths_against_a_walk():
    """The vectorised descent against following each tree by hand."""
    rng = np.random.default_rng(4)
    rows = rng.normal(size=(120, 3))
    forest = IsolationForest(rows, trees=9, sample=64, seed=2)
    for x, s in zip(rows[:20], forest.score(rows[:20])):
        total = 0.0
        for feature, cut, child, path in forest.trees:
            node = 0
            while feature[node] >= 0:
                node = child[node] + int(x[feature[node]] > cut[node])
            total += path[node]
        assert abs(s - 2 ** (-total / 9 / path_constant(64))) < 1e-12


def test_held_out_documents(spark):
    """Of the labels two thirds are shown; the rest is judged."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    judged = quality_rules(docs, labels.where("doc_id % 3 <> 0")).where("not base_failed").join(labels.where("doc_id % 3 = 0"), "doc_id")
    kept = {r.quality: r.kept for r in judged.groupBy("quality").agg(F.avg(F.col("kept").cast("double")).alias("kept")).collect()}
    assert kept[1] > 0.98 and kept[0] < 0.05, kept


@pytest.mark.parametrize("labelled", [[], [(1, 1, 0)], [(None, 1, 0), (2, None, None)], [(i, 1, 0) for i in range(20)], [(i, 0, 0) for i in range(20)]])
def test_few_and_one_sided_labels(spark, labelled):
    docs = spark.createDataFrame([(i % 30, " ".join(f"w{i}x{j}" for j in range(20 + i))) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame(labelled, "doc_id long, quality int, toxic int")
    got = quality_rules(docs, labels).collect()
    assert len(got) == 40 and sum(r.kept for r in got) >= 20
    assert quality_rules(docs.limit(0), labels).count() == 0 and keep_good(docs.limit(0), labels).count() == 0


def test_the_fit_does_not_depend_on_splits(spark):
    """Repeated doc_ids too."""
    rng = random.Random(5)
    rows = [(i % 50, " ".join(rng.choice(["word", "other", "#####", "X9"]) for _ in range(rng.randrange(20, 60)))) for i in range(120)]
    labels = spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(50)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    runs = [sorted((r.doc_id, r.n_symbols, round(r.anomaly, 9), r.kept) for r in quality_rules(docs.repartition(n), labels, max_labelled=30).collect()) for n in (1, 5)]
    assert runs[0] == runs[1]
