"""Quality rules, and an isolation forest over their statistics.

Every text gets a row of rule statistics. Rules that labelled rejects break far more often than clean documents do (by the range
of clean documents) are selected, and an isolation forest (random axis splits over small subsamples) over the values of these
statistics gives an anomaly score: the shorter the mean path to a row's leaf, the more anomalous the document. Selection, forest
and threshold are fitted on a bounded sample of labelled documents; scoring covers every document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import emit, narrow, slabs

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RATIOS = ("word_length", "symbols", "upper", "digits", "marks", "dup_lines", "repeats", "distinct")
WINDOW = 8
#: Drawn rejects for each drawn clean document.
REJECT_SHARE = 0.05
#: A statistic is selected if this share of the rejects lies outside the range of clean documents.
TELLING = 0.03
SYMBOLS = np.frombuffer(b"#*$%&|<>", dtype=np.uint8)
BLANKS = np.frombuffer(b" \t\n\x0b\x0c\r", dtype=np.uint8)
MULTIPLIER = 0x9E3779B97F4A7C15


def repeated(words: list[bytes]) -> int:
    """Words inside a window of 8 words that occurs at least twice in the text."""
    n = len(words)
    if n <= WINDOW:
        return 0
    h = np.fromiter(map(hash, words), dtype=np.int64, count=n).view(np.uint64)
    step = MULTIPLIER
    for width in (1, 2, 4):
        h = h[:-width] * np.uint64(step) + h[width:]
        step = step * step % 2**64
        h ^= h >> np.uint64(29)
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return 0
    found = np.zeros(len(h), dtype=bool)
    found[order[1:][same]] = True
    found[order[:-1][same]] = True
    edge = np.zeros(n + 1, dtype=np.int64)
    at = np.flatnonzero(found)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    return int((np.cumsum(edge)[:n] > 0).sum())


def measure(text: str) -> tuple[list[int], list[float]]:
    """The counts of a text, and the ratios that the forest sees."""
    raw = text.encode()
    words = raw.split()  # splits bytes at space and \\t-\\r only
    n = len(words)
    if not n:
        return [0] * len(COUNTS), [0.0] * len(RATIOS)
    tally = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    chars = len(text) - int(tally[BLANKS].sum())
    symbols = int(tally[SYMBOLS].sum())
    lines = [x for x in raw.split(b"\n") if x.strip()]
    dup = len(lines) - len(set(lines))
    again = repeated(words)
    ratios = [min(chars / n, 40.0), symbols / chars, int(tally[65:91].sum()) / chars, int(tally[48:58].sum()) / chars, min((int(tally[33]) + int(tally[63])) / n, 2.0), dup / len(lines), again / n, len(set(words)) / n]
    return [n, chars, symbols, dup, again], ratios


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 20 or 100 * n_repeat_words > 30 * n_words


def path_constant(n: float) -> float:
    """Mean path of an unsuccessful search in a tree of n leaves."""
    return 0.0 if n <= 1 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0


class IsolationForest:
    """``weight``: how often a row is drawn; few rejects in a subsample keep them from hiding one another."""

    def __init__(self, rows: np.ndarray, trees: int = 200, sample: int = 256, seed: int = 7, weight: np.ndarray | None = None):
        rng = np.random.default_rng(seed)
        share = np.ones(len(rows)) if weight is None else weight
        self.size = min(sample, int((share > 0).sum()))
        depth = max(1, math.ceil(math.log2(max(2, self.size))))
        self.depth = depth
        self.trees = [self.grow(rows[rng.choice(len(rows), self.size, replace=False, p=share / share.sum())], depth, rng) for _ in range(trees)]

    @staticmethod
    def grow(rows: np.ndarray, depth: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """feature (-1: a leaf), threshold, left child (right is the next), path length at a leaf."""
        feature, cut, child, path = [-1], [0.0], [0], [0.0]
        todo = [(0, rows, 0)]
        while todo:
            node, part, level = todo.pop()
            spread = np.flatnonzero(part.max(axis=0) > part.min(axis=0)) if len(part) > 1 and level < depth else []
            if not len(spread):
                path[node] = level + path_constant(len(part))
                continue
            f = int(rng.choice(spread))
            lo, hi = part[:, f].min(), part[:, f].max()
            at = float(rng.uniform(lo, hi))
            feature[node], cut[node], child[node] = f, at, len(feature)
            left = part[:, f] <= at
            for side in (part[left], part[~left]):
                todo.append((len(feature), side, level + 1))
                feature.append(-1)
                cut.append(0.0)
                child.append(0)
                path.append(0.0)
        return np.array(feature), np.array(cut), np.array(child), np.array(path)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """2 to the power of minus the mean path over the expected one: near 1 anomalous, under 0.5 ordinary."""
        total = np.zeros(len(rows))
        each = np.arange(len(rows))
        for feature, cut, child, path in self.trees:
            node = np.zeros(len(rows), dtype=np.int64)
            for _ in range(self.depth):
                f = feature[node]
                node = np.where(f < 0, node, child[node] + (rows[each, f] > cut[node]))
            total += path[node]
        return 2.0 ** (-total / len(self.trees) / max(path_constant(self.size), 1e-9))


class Verdict:
    """The selected statistics, the forest and the threshold; without enough labelled rows only the base rules judge."""

    def __init__(self, ratios: np.ndarray, good: np.ndarray, max_clean_loss: float):
        self.forest, self.threshold = None, math.inf
        if good.sum() < 8:
            return
        self.used = np.ones(ratios.shape[1], dtype=bool)
        if not good.all():
            low, high = np.quantile(ratios[good], [max_clean_loss, 1 - max_clean_loss], axis=0)
            outside = (ratios < low) | (ratios > high)
            telling = outside[~good].mean(axis=0) > 5 * outside[good].mean(axis=0) + TELLING
            self.used = telling if telling.any() else self.used
        self.forest = IsolationForest(ratios[:, self.used], weight=np.where(good, 1.0, REJECT_SHARE * good.sum() / max(1, (~good).sum())))
        scores = self.score(ratios)
        clean, bad = np.sort(scores[good]), scores[~good]
        top = clean[max(0, math.ceil((1 - max_clean_loss) * len(clean)) - 1)]
        above = bad[bad > top]
        self.threshold = float((top + above.min()) / 2 if len(above) else clean[-1])

    def score(self, ratios: list[list[float]] | np.ndarray) -> np.ndarray:
        rows = np.array(ratios, dtype=float).reshape(-1, len(RATIOS))
        return self.forest.score(rows[:, self.used]) if self.forest else np.zeros(len(rows))


def labelled_sample(docs: DataFrame, labels: DataFrame, max_labelled: int) -> DataFrame:
    """At most ``max_labelled`` labelled documents (doc_id, text, quality, toxic), drawn by a hash of doc_id."""
    ids = labels.where("doc_id is not null and quality is not null").groupBy(labels.doc_id.cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    return narrow(docs).join(F.broadcast(ids), "doc_id")  # the limit bounds what is broadcast


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = 4096, max_clean_loss: float = 0.003) -> Verdict:
    """Statistics of the sample are collected, texts are not: at most ``max_labelled`` short rows, of a repeated doc_id the least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in slabs(batches):
            found = [measure(x) for x in t.column("text").to_pylist()]
            failed = [base_failed(c[0], c[4]) for c, _ in found]
            yield from emit({"doc_id": t.column("doc_id"), "good": [q > 0 for q in t.column("quality").to_pylist()], "failed": failed, "ratios": [r for _, r in found]}, pa.schema([("doc_id", pa.int64()), ("good", pa.bool_()), ("failed", pa.bool_()), ("ratios", pa.list_(pa.float64()))]))

    each = labelled_sample(docs, labels, max_labelled).mapInArrow(run, "doc_id long, good boolean, failed boolean, ratios array<double>")
    rows = each.groupBy("doc_id").agg(F.min(F.struct("failed", "ratios", "good")).alias("x")).select("x.*").collect()
    rows = sorted((tuple(r.ratios), r.good) for r in rows if not r.failed)
    return Verdict(np.array([r for r, _ in rows], dtype=float).reshape(-1, len(RATIOS)), np.array([g for _, g in rows], dtype=bool), max_clean_loss)


SCHEMA = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in COUNTS), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("anomaly", pa.float64())])


def judge(texts: list[str], verdict: Verdict) -> tuple[list[list[int]], list[bool], np.ndarray, list[bool]]:
    found = [measure(x) for x in texts]
    counts, scores = [c for c, _ in found], verdict.score([r for _, r in found])
    failed = [base_failed(c[0], c[4]) for c in counts]
    return counts, failed, scores, [not f and s <= verdict.threshold for f, s in zip(failed, scores.tolist())]


def quality_rules(docs: DataFrame, labels: DataFrame, max_labelled: int = 4096, max_clean_loss: float = 0.003) -> DataFrame:
    """One row per row of ``docs``: doc_id, the counts, base_failed, kept, anomaly.

    ``labels`` (doc_id, quality, toxic) calibrates the threshold so that at most ``max_clean_loss`` of the sampled documents of
    quality 1 are lost. The only bounds are the documented sample sizes of the fit; all documents are measured and judged, and
    nothing is shuffled. Null and empty texts have no words and fail the base rules; repeated rows each give a row; a null
    doc_id stays null; empty tables give no rows; without labels the base rules alone decide; further columns are ignored.
    """
    verdict = fit(docs, labels, max_labelled, max_clean_loss)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in slabs(batches):
            counts, failed, scores, kept = judge(t.column("text").to_pylist(), verdict)
            yield from emit({"doc_id": t.column("doc_id"), **{c: [x[i] for x in counts] for i, c in enumerate(COUNTS)}, "base_failed": failed, "kept": kept, "anomaly": scores}, SCHEMA)

    return narrow(docs).mapInArrow(run, "doc_id long, " + "".join(f"{c} long, " for c in COUNTS) + "base_failed boolean, kept boolean, anomaly double")


def keep_good(docs: DataFrame, labels: DataFrame, max_labelled: int = 4096, max_clean_loss: float = 0.003) -> DataFrame:
    """The rows of ``docs`` that ``quality_rules`` keeps, with all their columns.

    Null and empty texts go (they fail the base rules); repeated rows stay or go together; an empty table gives no rows; without
    labels the base rules alone decide; no column name is reserved.
    """
    verdict = fit(docs, labels, max_labelled, max_clean_loss)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in slabs(batches):
            kept = judge([x or "" for x in t.column("text").to_pylist()], verdict)[3]
            yield from t.filter(pa.array(kept, pa.bool_())).to_batches()

    return docs.mapInArrow(run, docs.schema)
