"""Quality classifier by co-training of a text-content view and a page-metadata view.

The content view sees which of the telling character n-grams and words a text holds. The page view sees source, language, length
and layout (lines, their length, and in which step each ratio of the quality rules lies outside the range of good documents), but
no words. Both are logistic regressions. From round to round each view labels the unlabelled documents of which it is confident,
and hands them to the other one. Each view is then calibrated on labelled rows that no training saw, the calibrated views are
combined, and the combination scores every document. A document is good if its quality is 1 and it is not toxic.

At most ``max_labelled`` labelled documents are drawn, by a hash of doc_id; their short descriptions are fitted on the driver.
All other documents count as unlabelled: they are described once, in packed rows that stay in the shared folder, and what they
add to the gradients of a round is summed where they are. A round starts from these sums and the labelled rows: as both come from
the same kind of documents, the labelled rows stand for the curvature of the others, and two such steps are enough. The classes of
handed documents weigh no more than the labelled rows of their class. Texts are read once for the sample and once for all.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, emit, slabs, stored
from .packing import grouped, pack, unpack
from .quality_rules import RATIOS, measure

SIZES = (4, 5, 6, 8)
BUCKET_BITS = 20
SLAB = 1_000_000
MULTIPLIER = 0x9E3779B1
BLANK = np.isin(np.arange(256), np.frombuffer(b" \t\n\x0b\x0c\r", dtype=np.uint8))
#: Places of the page view: sources, languages, and steps of length, lines, length of lines; then STEPS for each ratio.
SOURCES, LANGS, LENGTHS = 256, 32, 24
STEPS = 9
PAGE = SOURCES + LANGS + 3 * LENGTHS + STEPS * len(RATIOS)
CLIP = 12.0
#: What chance alone does not reach among a million n-grams.
MIN_CHI = 30.0
#: Of labelled documents: good; toxic; of low quality only.
KINDS = ("good", "harsh", "poor")
SHRINK = (3e-4, 1e-3)
#: A handed document weighs so much at most.
HANDED = 0.5
INNER = 2


def buckets(texts: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The text number of each byte; for each size the bucket of the n-gram from there on (-1: it would cross a blank), and last
    that of the whole word that begins there (-1: none does)."""
    raw = [x.lower().encode() for x in texts]
    owner = np.repeat(np.arange(len(raw)), [len(x) + 1 for x in raw])
    data = np.frombuffer(b" " + b" ".join(raw) + b" " * max(SIZES), dtype=np.uint8)
    blank = BLANK[data]
    data = np.where(blank, np.uint8(32), data).astype(np.uint32)
    blank = blank.astype(np.int32)
    seen = np.append(0, np.cumsum(blank))
    n = len(owner)
    mixed = lambda h, j: (((h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B + 2 * j)) >> np.uint32(32 - BUCKET_BITS)).astype(np.int32)
    h, out = np.zeros(n, dtype=np.uint32), []
    for j in range(max(SIZES)):
        h = h * np.uint32(MULTIPLIER) + data[j : j + n] + np.uint32(1)
        if j + 1 in SIZES:
            inner = seen[j : j + n] - seen[1 : 1 + n]  # blanks at the places 1 .. j-1 of the n-gram
            out.append(np.where(inner == 0, mixed(h, j), -1))
    words = np.full(n, -1, dtype=np.int32)
    starts = np.flatnonzero((blank[:-1] == 1) & (blank[1:] == 0)) + 1
    if len(starts):
        at = np.arange(len(data)) - np.repeat(np.append(0, starts), np.diff(np.append(np.append(0, starts), len(data))))
        power = np.cumprod(np.full(int(at.max()) + 1, MULTIPLIER, dtype=np.uint32), dtype=np.uint32)
        words[starts - 1] = mixed(np.add.reduceat(np.where(blank == 1, np.uint32(0), (data + np.uint32(1)) * power[at]), starts, dtype=np.uint32), 31)
    return owner, [*out, words]


def present(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature) of all distinct features; ``table``: the feature of each bucket, or -1."""
    owner, found = buckets(texts)
    codes = []
    for x in found:
        f = np.where(x >= 0, table[x], -1)
        at = np.flatnonzero(f >= 0)
        codes.append(owner[at] << 32 | f[at].astype(np.int64))
    codes = np.unique(np.concatenate(codes))
    return codes >> 32, codes & (2**32 - 1)


def steps(n: int | None) -> int:
    return 0 if n is None else 1 + min(LENGTHS - 2, max(0, int(n)).bit_length())


def metadata(source: str | None, lang: str | None, n_chars: int | None, text: str) -> list[int]:
    """Five places of the page view."""
    of = lambda x, n: 0 if x is None else 1 + xxhash.xxh32_intdigest(x.encode()) % (n - 1)
    lines = text.count("\n") + 1
    base = SOURCES + LANGS
    return [of(source, SOURCES), SOURCES + of(lang, LANGS), base + steps(n_chars), base + LENGTHS + steps(lines), base + 2 * LENGTHS + steps(len(text) // lines)]


class Ranges:
    """Of the ratios, in good documents."""

    def __init__(self, ratios: np.ndarray):
        self.low, self.high = np.quantile(ratios, [0.003, 0.997], axis=0)
        self.scale = np.maximum(self.high - self.low, 0.01)

    def places(self, ratios: np.ndarray) -> np.ndarray:
        """How far outside, in STEPS steps of the page view for each ratio."""
        out = (np.maximum(ratios - self.high, 0) - np.maximum(self.low - ratios, 0)) / self.scale
        step = np.sign(out) * np.minimum(np.ceil(np.log2(1 + 8 * np.abs(out))), STEPS // 2)
        return SOURCES + LANGS + 3 * LENGTHS + STEPS * np.arange(len(RATIOS)) + STEPS // 2 + step.astype(np.int64)


class Ones:
    """A matrix of ones and zeros: the columns that each row has."""

    def __init__(self, owner: np.ndarray, column: np.ndarray, rows: int, columns: int):
        self.owner, self.column, self.shape = owner, column, (rows, columns)

    def __matmul__(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner, weights=w[self.column], minlength=self.shape[0])

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, weights=g[self.owner], minlength=self.shape[1])


class Logistic:
    """L2-regularised logistic regression by accelerated gradient descent; the intercept is not shrunk. ``linear`` (the intercept's
    last) is added to the gradient of the summed losses, ``scale`` multiplies it, ``total`` divides both."""

    def __init__(self, x: Ones | np.ndarray, y: np.ndarray, weight: np.ndarray, shrink: float, rounds: int = 400, linear: np.ndarray | None = None, scale: float = 1.0, total: float | None = None, start: Logistic | None = None):
        back = x.back if isinstance(x, Ones) else lambda g: x.T @ g
        total = total or weight.sum()
        linear = np.zeros(x.shape[1] + 1) if linear is None else linear
        v, norm = np.ones(x.shape[1]), 1.0
        for _ in range(20):  # the largest curvature
            v = back(weight * (x @ v))
            norm = float(np.linalg.norm(v)) or 1.0
            v /= norm
        step = 1.0 / (0.25 * scale * (norm + weight.sum()) / total + shrink)
        w, w0 = (start.w, start.w0) if start else (np.zeros(x.shape[1]), 0.0)
        ahead, ahead0, t = w, w0, 1.0
        for _ in range(rounds):
            g = scale * weight * (sigmoid(x @ ahead + ahead0) - y)
            new, new0 = ahead - step * ((back(g) + linear[:-1]) / total + shrink * ahead), ahead0 - step * float(g.sum() + linear[-1]) / total
            t, last = (1 + math.sqrt(1 + 4 * t * t)) / 2, t
            k = (last - 1) / t
            ahead, ahead0 = new + k * (new - w), new0 + k * (new0 - w0)
            w, w0 = new, new0
        self.w, self.w0 = w, w0

    def logits(self, x: Ones | np.ndarray) -> np.ndarray:
        return x @ self.w + self.w0


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40.0, 40.0)))


def loss_gradient(x: Ones, model: Logistic, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Of the summed loss; the intercept's comes last."""
    g = weight * (sigmoid(model.logits(x)) - y)
    return np.append(x.back(g), g.sum())


class Described:
    """Descriptions of some documents: the telling n-grams and words, the places of the page view, and whether one is free, that
    is, not among the labelled rows."""

    def __init__(self, raw: bytes, features: int):
        self.doc, self.none, self.free, sizes, found, page = unpack(raw)
        n = len(self.doc)
        self.views = [Ones(grouped(sizes), found, n, features), Ones(np.repeat(np.arange(n), len(page) // max(n, 1)), page, n, PAGE)]


def handed(described: Described, teachers: list[Logistic], sure: float) -> list[np.ndarray]:
    """For each view the label that the other one gives: -1 if it is not confident, or if the document is not free."""
    out = []
    for i in (0, 1):
        p = sigmoid(teachers[1 - i].logits(described.views[1 - i]))
        out.append(np.where(described.free == 0, -1, np.where(p >= sure, 1, np.where(p <= 1 - sure, 0, -1))))
    return out


class Model:
    """Both views, their calibration, the combination and the threshold. All of a fixed size."""

    def __init__(self, table: np.ndarray, features: int, ranges: Ranges | None):
        self.table, self.features, self.ranges = table, features, ranges
        self.views: list[Logistic] = []
        self.exchanged: list[dict[str, int]] = []  # labels handed over in each round
        self.threshold = -math.inf

    def calibrate(self, x: list[Ones], y: np.ndarray, max_clean_loss: float) -> None:
        logits = np.stack([np.clip(m.logits(v), -CLIP, CLIP) for m, v in zip(self.views, x)], axis=1)
        labels, ones = y.astype(float), np.ones(len(y))
        self.scales = [Logistic(logits[:, i : i + 1], labels, ones, 1e-4) for i in (0, 1)]
        for s in self.scales:
            s.w = np.maximum(s.w, 0)
        calibrated = np.stack([s.logits(logits[:, i : i + 1]) for i, s in enumerate(self.scales)], axis=1)
        self.both = Logistic(calibrated, labels, ones, 1e-2)
        self.both.w = np.maximum(self.both.w, 0)  # a view may count for nothing, but not against itself
        score = self.both.logits(calibrated)
        clean, bad = np.sort(score[y == 1]), score[y == 0]
        floor = clean[min(len(clean) - 1, int(max_clean_loss * len(clean)))]
        under = bad[bad < floor]
        self.threshold = float((floor + under.max()) / 2 if len(under) else clean[0])

    def score(self, x: Described) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities of being good by content, by page and by both; kept."""
        n = len(x.doc)
        if not self.views:
            return np.full(n, 0.5), np.full(n, 0.5), np.full(n, 0.5), np.ones(n, dtype=bool)
        views = [s.logits(np.clip(m.logits(v), -CLIP, CLIP)[:, None]) for s, m, v in zip(self.scales, self.views, x.views)]
        both = self.both.logits(np.stack(views, axis=1))
        return sigmoid(views[0]), sigmoid(views[1]), sigmoid(both), both >= self.threshold


def narrowed(docs: DataFrame) -> DataFrame:
    """What the two views read; columns that are missing count as null."""
    have = set(docs.columns)
    of = lambda c, kind: (docs[c] if c in have else F.lit(None)).cast(kind).alias(c)
    return docs.select(of("doc_id", "long"), F.coalesce(docs["text"], F.lit("")).alias("text"), of("source", "string"), of("lang", "string"), of("n_chars", "long"))


def draw(labels: DataFrame, max_labelled: int) -> DataFrame:
    """(doc_id, label, toxic, apart) of the labels that the fit sees."""
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    known = known.agg((F.min("quality") > 0).alias("fine"), (F.max(F.coalesce("toxic", F.lit(0))) > 0).alias("toxic")).select("doc_id", (F.col("fine") & ~F.col("toxic")).alias("label"), "toxic")
    drawn = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    return stored(drawn.withColumn("apart", F.pmod(F.xxhash64(F.lit("apart"), "doc_id"), F.lit(4)) == 0))


def sample(docs: DataFrame, drawn: DataFrame) -> DataFrame:
    """The labelled documents of the fit, one row for each doc_id (the least of several)."""
    rows = docs.join(F.broadcast(drawn), "doc_id")  # max_labelled bounds what is broadcast
    return stored(rows.groupBy("doc_id", "label", "toxic", "apart").agg(F.min(F.struct("text", "source", "lang", "n_chars")).alias("x")).select("doc_id", "label", "toxic", "apart", "x.*"))


def telling(labelled: DataFrame) -> tuple[np.ndarray, int]:
    """The feature of each bucket: all n-grams and words that toxic documents, or others of low quality, have more often than good
    ones, and by more than chance explains (chi-squared). Not more than there are buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((3, 1 << BUCKET_BITS), dtype=np.int64)
        n = np.zeros(3, dtype=np.int64)
        every = np.arange(1 << BUCKET_BITS, dtype=np.int32)
        for t in slabs(batches, limit=SLAB):
            kind = np.array([0 if good else 1 if toxic else 2 for good, toxic in zip(t.column("label").to_pylist(), t.column("toxic").to_pylist())])
            owner, found = present(t.column("text").to_pylist(), every)
            for k in range(3):
                held[k] += np.bincount(found[kind[owner] == k], minlength=1 << BUCKET_BITS)
                n[k] += (kind == k).sum()
        at = np.flatnonzero(held.sum(axis=0))
        yield from emit({"b": np.append(-1, at), **{c: np.append(n[k], held[k, at]) for k, c in enumerate(KINDS)}}, pa.schema([("b", pa.int64()), *((c, pa.int64()) for c in KINDS)]))

    counts = stored(labelled.where("not apart").select("text", "label", "toxic").mapInArrow(run, "b long, good long, harsh long, poor long").groupBy("b").agg(*[F.sum(c).alias(c) for c in KINDS]))
    table = np.full(1 << BUCKET_BITS, -1, dtype=np.int32)
    whole = counts.where("b = -1").first()
    best: set[int] = set()
    for kind in KINDS[1:]:
        if whole is not None and whole.good and whole[kind]:
            n_good, n_bad = float(whole.good), float(whole[kind])
            n = n_good + n_bad
            a, b, df = F.col("good") / n_good, F.col(kind) / n_bad, (F.col("good") + F.col(kind)) / n
            chi = n_good * n_bad / n * (a - b) * (a - b) / (df * (1.0 + 1.0 / n - df))
            best |= {r.b for r in counts.where(f"b >= 0 and good + {kind} > 0").where((chi >= MIN_CHI) & (b > a)).select("b").collect()}
    discard(counts)
    table[sorted(best)] = np.arange(len(best))
    return table, len(best)


RAW = pa.schema([("raw", pa.binary())])


def describe(docs: DataFrame, table: np.ndarray, ranges: Ranges) -> DataFrame:
    """(raw): a packed row for each slab of ``docs``, which has a column free."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in slabs(batches, limit=SLAB):
            texts = t.column("text").to_pylist()
            owner, found = present(texts, table)
            ratios = np.array([measure(x)[1] for x in texts], dtype=float).reshape(len(texts), len(RATIOS))
            page = np.array([metadata(*x) for x in zip(*(t.column(c).to_pylist() for c in ("source", "lang", "n_chars")), texts)], dtype=np.int64)
            page = np.concatenate([page.reshape(len(texts), 5), ranges.places(ratios)], axis=1)
            doc = t.column("doc_id")
            raw = pack(doc.fill_null(0).to_numpy(), doc.is_null().to_numpy(), t.column("free").to_numpy(), np.bincount(owner, minlength=len(texts)), found, page.reshape(-1))
            yield from emit({"raw": [raw]}, RAW)

    return docs.mapInArrow(run, "raw binary")


def labelled_rows(drawn: DataFrame) -> list:
    """(doc_id, ratios, label, apart) of the labelled sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in slabs(batches, limit=SLAB):
            ratios = [measure(x)[1] for x in t.column("text").to_pylist()]
            yield pa.record_batch({"doc_id": t.column("doc_id").combine_chunks(), "ratios": pa.array(ratios, pa.list_(pa.float64())), "label": t.column("label").combine_chunks(), "apart": t.column("apart").combine_chunks()})

    found = drawn.select("doc_id", "text", "label", "apart").mapInArrow(run, "doc_id long, ratios array<double>, label boolean, apart boolean").collect()  # max_labelled rows
    return sorted(found, key=lambda r: r.doc_id)


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int, rounds: int, sure: float, max_clean_loss: float) -> tuple[Model, DataFrame]:
    """The model, and the descriptions of all documents."""
    drawn = draw(labels, max_labelled)
    ours = sample(docs, drawn)
    rows = labelled_rows(ours)
    y, apart = np.array([r.label for r in rows], dtype=np.int64), np.array([r.apart for r in rows], dtype=bool)
    known = ~apart
    if min((y[known] == 0).sum(), (y[known] == 1).sum(), (y[apart] == 0).sum(), (y[apart] == 1).sum()) < 4:
        model = Model(np.full(1 << BUCKET_BITS, -1, dtype=np.int32), 0, None)  # too few labels of a kind: nothing is judged
        anywhere = Ranges(np.zeros((1, len(RATIOS))))
        return model, stored(describe(docs.withColumn("free", F.lit(True)), model.table, anywhere))
    table, features = telling(ours)
    ranges = Ranges(np.array([r.ratios for r in rows])[known & (y == 1)])
    model = Model(table, features, ranges)
    marked = docs.join(F.broadcast(drawn.select("doc_id", F.lit(False).alias("free"))), "doc_id", "left").withColumn("free", F.coalesce("free", F.lit(True)))
    whole = stored(describe(marked, table, ranges))

    parts = [Described(r.raw, features) for r in describe(ours.withColumn("free", F.lit(False)), table, ranges).collect()]  # of max_labelled rows
    place = np.argsort(np.argsort(np.concatenate([p.doc for p in parts])))
    starts = np.cumsum([0] + [len(p.doc) for p in parts])
    mine = []
    for i, columns in enumerate((features, PAGE)):
        owner = np.concatenate([place[a + p.views[i].owner] for a, p in zip(starts, parts)])
        mine.append((owner, np.concatenate([p.views[i].column for p in parts]), columns))

    def chosen(rows_: np.ndarray) -> list[Ones]:
        number = np.cumsum(rows_) - 1
        return [Ones(number[owner[rows_[owner]]], column[rows_[owner]], int(rows_.sum()), columns) for owner, column, columns in mine]

    x, labels_, ones = chosen(known), y[known].astype(float), np.ones(int(known.sum()))
    model.views = [Logistic(v, labels_, ones, s) for v, s in zip(x, SHRINK)]
    for _ in range(rounds):
        teachers = model.views
        counted = counts_of(whole, features, teachers, sure)
        model.exchanged.append({"good to content": counted[0][1], "bad to content": counted[0][0], "good to page": counted[1][1], "bad to page": counted[1][0]})
        weights = [[min(HANDED, float((labels_ == c).sum()) / max(counted[i][c], 1)) for c in (0, 1)] for i in (0, 1)]
        added = [sum(weights[i][c] * counted[i][c] for c in (0, 1)) for i in (0, 1)]
        models = teachers
        for _ in range(INNER):
            theirs = gradients(whole, features, teachers, sure, weights, models)
            ahead = []
            for i, (v, s) in enumerate(zip(x, SHRINK)):
                tau = added[i] / len(labels_)
                linear = theirs[i] - tau * loss_gradient(v, models[i], labels_, ones)
                ahead.append(Logistic(v, labels_, ones, s, linear=linear, scale=1 + tau, total=len(labels_) + added[i], start=models[i]))
            models = ahead
        model.views = models
    model.calibrate(chosen(apart), y[apart], max_clean_loss)
    discard(drawn, ours)
    return model, whole


def counts_of(whole: DataFrame, features: int, teachers: list[Logistic], sure: float) -> list[list[int]]:
    """How many labels 0 and 1 are handed to the content view, and to the page view."""
    names = [f"v{i}c{c}" for i in (0, 1) for c in (0, 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column("raw").to_pylist():
                given = handed(Described(raw, features), teachers, sure)
                yield pa.record_batch({f"v{i}c{c}": pa.array([int((given[i] == c).sum())], pa.int64()) for i in (0, 1) for c in (0, 1)})

    found = whole.mapInArrow(run, ", ".join(f"{c} long" for c in names)).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names]).first()
    return [[found[f"v{i}c{c}"] for c in (0, 1)] for i in (0, 1)]


def gradients(whole: DataFrame, features: int, teachers: list[Logistic], sure: float, weights: list[list[float]], models: list[Logistic]) -> list[np.ndarray]:
    """What the handed documents add to the gradient of each view's summed loss at ``models``."""
    schema = pa.schema([("view", pa.int32()), ("i", pa.int32()), ("g", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros(features + 1), np.zeros(PAGE + 1)]
        for batch in batches:
            for raw in batch.column("raw").to_pylist():
                described = Described(raw, features)
                for i, given in enumerate(handed(described, teachers, sure)):
                    weight = np.where(given < 0, 0.0, np.where(given > 0, weights[i][1], weights[i][0]))
                    total[i] += loss_gradient(described.views[i], models[i], given, weight)
        for i in (0, 1):
            at = np.flatnonzero(total[i])
            yield from emit({"view": np.full(len(at), i), "i": at, "g": total[i][at]}, schema)

    out = [np.zeros(features + 1), np.zeros(PAGE + 1)]
    for r in whole.mapInArrow(run, "view int, i int, g double").groupBy("view", "i").agg(F.sum("g").alias("g")).collect():  # a row for each feature
        out[r.view][r.i] = r.g
    return out


OUT = pa.schema([("doc_id", pa.int64()), ("content_score", pa.float64()), ("page_score", pa.float64()), ("score", pa.float64()), ("kept", pa.bool_())])


def classify(docs: DataFrame, labels: DataFrame, max_labelled: int = 8192, rounds: int = 3, sure: float = 0.97, max_clean_loss: float = 0.003) -> DataFrame:
    """One row per row of ``docs``: doc_id, the calibrated probabilities of being good by content (content_score), by the page
    (page_score) and by both (score), and kept.

    ``labels`` (doc_id, quality, toxic): at most ``max_labelled`` of them are used, all other documents are unlabelled ones; the
    threshold loses at most ``max_clean_loss`` of the good rows set apart. Every document is described over its whole text, without
    a shuffle. Null texts count as empty; missing or null source, lang and n_chars are a value of their own; labels without doc_id
    or quality are left out, a null toxic is 0, of repeated labels the worst holds, of repeated rows of a labelled doc_id the fit
    takes the least; with fewer than 4 training or calibration rows of a class every score is one half and all rows are kept;
    repeated rows each give a row; a null doc_id stays null; an empty table gives no rows; further columns are ignored.
    """
    model, whole = fit(narrowed(docs), labels, max_labelled, rounds, sure, max_clean_loss)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column("raw").to_pylist():
                x = Described(raw, model.features)
                content, page, score, kept = model.score(x)
                yield from emit({"doc_id": pa.array(x.doc, pa.int64(), mask=x.none > 0), "content_score": content, "page_score": page, "score": score, "kept": kept}, OUT)

    return whole.mapInArrow(run, "doc_id long, content_score double, page_score double, score double, kept boolean")
