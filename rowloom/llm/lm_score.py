"""Language-model scores from a hierarchical Pitman-Yor process over words.

Every observed preceding word has a restaurant of its own (texts begin in that of the end); all of them share one parent, whose
base gives each of the V known words and one class of all unknown words the same share. A customer of a word's restaurant is a
training token seen after that word; each of its tables is a customer of the parent.

The seating is sampled by Gibbs. What the restaurants hold of a dish is kept as its numbers of customers and tables from sweep to
sweep; a sweep takes the customers of one dish out of one restaurant after the other and draws their tables anew from the full
conditional (generalised Stirling numbers; customers beyond the first STIRLING join in growing parties, with the odds that those
still to come leave), then those of the parent. Predictive probabilities are averaged over the last SAMPLES sweeps.

How it is spread out: texts are cut into slabs, tokenised once, and kept as word numbers; texts are never shuffled. Words are dealt
to R homes by a hash. A slab sends each home the distinct pairs whose first word lives there, packed and with counts; the home
merges them, and sends what it knows of each second word to that word's home, where all of a dish is together and the sweeps run.
The tables go back to the first words' homes, which answer every slab in the order it asked in, so that answers need no keys.
Pairs after a very frequent word (HOT_SHARES bounds how many there are) are dealt by both words. Within a home the tables that
other homes hold are known as of the least seating, carried on by the share of further customers that opened tables here.
Words travel as 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, emit, narrow, release, slabs, stored
from .packing import grouped, pack, rising, unpack

BURN_IN = 3
SAMPLES = 2
STRENGTH = 5.0
STIRLING = 256
ROUNDS = 8
END = b"\n"  # no word can have it
SLAB = 6_000_000
HOME_BYTES = 8_000_000
#: A word is frequent if more than a home's share of all tokens is its own; between 1,000 and 100,000 words can be.
HOT_SHARES = (0.001, 0.00001)
#: Homes are asked in so many turns, so that only a share of the pairs is on its way at a time.
TURNS = 2
HELD_OUT = "coalesce(crc32(cast(doc_id as string)) % 7 = 2, false)"


def word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


def home(hashes: np.ndarray, homes: int) -> np.ndarray:
    return ((hashes >> np.uint64(33)) % np.uint64(homes)).astype(np.int64)


# 1. Slabs

SLABS = pa.schema([("slab", pa.int64()), ("trained", pa.int64()), ("docs", pa.binary()), ("ids", pa.binary()), ("vocabulary", pa.binary()), ("hot_w", pa.list_(pa.int64())), ("hot_n", pa.list_(pa.int64()))])
SLAB_KINDS = "slab long, trained long, docs binary, ids binary, vocabulary binary, hot_w array<long>, hot_n array<long>"


def tokens(texts: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words, and for all tokens of all texts the word's number; tokens of each text."""
    known: dict[bytes, int] = {END: 0}
    ids, sizes = [], []
    number = known.setdefault
    for text in texts:
        words = text.encode().lower().split()
        ids += [number(w, len(known)) for w in words]
        ids.append(0)
        sizes.append(len(words) + 1)
    return list(known), np.array(ids, dtype=np.int64), np.array(sizes, dtype=np.int64)


def make_slabs(docs: DataFrame, homes: int, share: float) -> DataFrame:
    """A row for each slab of text. Words are numbered by home and hash; ``docs``: doc_id, its nulls, held out, sizes; the number of
    the end; words of each home. ``hot_w``: words of at least this share of the slab's training tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i, t in enumerate(slabs(batches, limit=SLAB)):
            words, at, sizes = tokens(t.column("text").to_pylist())
            hashes = np.fromiter(map(word_hash, words), dtype=np.uint64, count=len(words))
            lives = home(hashes, homes)
            order = np.lexsort((hashes, lives))
            rank = np.empty(len(order), dtype=np.int64)
            rank[order] = np.arange(len(order))
            ids, held = rank[at], t.column("held_out").to_numpy()
            ours = np.bincount(ids[~held[grouped(sizes)]], minlength=len(words))
            trained, hashes = int(ours.sum()), hashes[order]
            hot = np.flatnonzero(ours >= max(1.0, share * trained))
            ids_of, none = t.column("doc_id"), t.column("doc_id").is_null().to_numpy()
            about = pack(ids_of.fill_null(0).to_numpy(), none, held, sizes, np.array([rank[0]]), np.bincount(lives, minlength=homes))
            row = {"slab": TaskContext.get().partitionId() << 32 | i, "trained": trained, "docs": about, "ids": pack(ids), "vocabulary": pack(hashes), "hot_w": hashes[hot].view(np.int64).tolist(), "hot_n": ours[hot].tolist()}
            yield from emit({c: [v] for c, v in row.items()}, SLABS)

    return stored(docs.mapInArrow(run, SLAB_KINDS))


def hot_words(cut: DataFrame, share: float) -> np.ndarray:
    """Hashes of words of at least this share of all training tokens, by what slabs report: at most 1 / share of them, and all of
    twice that share."""
    each = cut.select(F.explode(F.arrays_zip("hot_w", "hot_n")).alias("x")).groupBy("x.hot_w").agg(F.sum("x.hot_n").alias("n"))
    total = cut.agg(F.sum("trained")).first()[0] or 0
    return np.array(sorted(r.hot_w for r in each.where(F.col("n") >= max(1.0, share * total)).select("hot_w").collect()), dtype=np.int64).view(np.uint64)


class Pairs:
    """The distinct pairs of neighbours in a slab, by the home that is asked for them; there, pairs after a frequent word come last."""

    def __init__(self, ids: np.ndarray, end: int, sizes_of_homes: np.ndarray, hot: np.ndarray):
        """``hot``: for each word its number among the frequent ones, or -1."""
        n, homes = len(hot), len(sizes_of_homes)
        before = np.append(end, ids[:-1])  # after an end begins a text
        keys, self.of_token = np.unique(before * n + ids, return_inverse=True)
        self.before = before
        u, w, lives = keys // n, keys % n, grouped(sizes_of_homes)
        frequent = hot[u] >= 0
        asked = np.where(frequent, (lives[u] + lives[w]) % homes, lives[u])
        self.order = np.argsort(2 * asked + frequent, kind="stable")
        self.u, self.w, self.hot = u[self.order], w[self.order], hot[u[self.order]]
        self.cuts = np.searchsorted((2 * asked + frequent)[self.order], np.arange(2 * homes + 1))


# 2. Homes of first words

#: Rows between the steps. to: a home, or of HOT rows the number of a frequent word; slab: that asked, or a home; s0..s6: sums.
OWN, ASKS, DISHES, HOT, SUMS, TABLES, WORDS = range(7)
ROW = pa.schema([("kind", pa.int32()), ("to", pa.int32()), ("slab", pa.int64()), ("blob", pa.binary()), *((f"s{i}", pa.float64()) for i in range(7))])
ROW_KINDS = "kind int, to int, slab long, blob binary, " + ", ".join(f"s{i} double" for i in range(7))


def rows_of(rows: list[tuple]) -> pa.Table:
    """(kind, to, slab, blob, sums)"""
    columns = {"kind": [r[0] for r in rows], "to": [r[1] for r in rows], "slab": [r[2] for r in rows], "blob": pa.array([r[3] for r in rows], pa.binary())}
    return pa.table(columns | {f"s{i}": [float(r[4][i]) if i < len(r[4]) else 0.0 for r in rows] for i in range(7)}, schema=ROW)


def ask(cut: DataFrame, hot: np.ndarray, turn: int) -> DataFrame:
    """(to, slab, blob): what a slab asks the homes of this turn for: its words there; of pairs the numbers of the second words, and the counts."""
    schema = pa.schema([("to", pa.int32()), ("slab", pa.int64()), ("blob", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for slab, docs, ids, vocabulary in zip(*(batch.column(c).to_pylist() for c in ("slab", "docs", "ids", "vocabulary"))):
                (_, _, held, sizes, end, in_home), (at,), (hashes,) = unpack(docs), unpack(ids), unpack(vocabulary)
                pairs = Pairs(at, int(end[0]), in_home, numbers_of(hashes, hot))
                train = held[grouped(sizes)] == 0
                n = np.bincount(pairs.of_token[train], minlength=len(pairs.order))[pairs.order]
                first = np.append(0, np.cumsum(in_home))
                blobs = []
                for x in range(turn, len(in_home), TURNS):
                    a, b, c = pairs.cuts[2 * x : 2 * x + 3].tolist()
                    if first[x] == first[x + 1] and a == c:
                        continue
                    seconds, second = np.unique(pairs.w[a:c], return_inverse=True)
                    followers = np.bincount(pairs.u[a:b] - first[x], minlength=int(in_home[x]))
                    blobs.append((x, slab, pack(hashes[first[x] : first[x + 1]], followers, hashes[seconds], second, n[a:c], pairs.hot[b:c])))
                for i in range(0, len(blobs), 64):
                    part = blobs[i : i + 64]
                    yield from emit({c: [r[j] for r in part] for j, c in enumerate(schema.names)}, schema)

    return cut.select("slab", "docs", "ids", "vocabulary").mapInArrow(run, "to int, slab long, blob binary")


def numbers_of(hashes: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """The place of each hash among the sorted (as signed numbers) frequent ones, or -1."""
    if not len(hot):
        return np.full(len(hashes), -1)
    signed, own = hot.view(np.int64), hashes.view(np.int64)
    at = np.minimum(np.searchsorted(signed, own), len(hot) - 1)
    return np.where(signed[at] == own, at, -1)


def merge(asked: pa.Table, homes: int, hot: np.ndarray) -> pa.Table:
    """All that a home is asked for, put together: its words and pairs, where each slab finds its own, and what dishes' homes need."""
    me = asked.column("to")[0].as_py()
    slab_ids = asked.column("slab").to_pylist()
    parts = [unpack(x) for x in asked.column("blob").to_pylist()]
    join = lambda i, kind: np.concatenate([p[i].astype(kind) for p in parts])
    words, word_of = np.unique(join(0, np.uint64), return_inverse=True)
    dishes, dish_of = np.unique(join(2, np.uint64), return_inverse=True)
    lives = home(dishes, homes)
    by_home = np.argsort(lives, kind="stable")  # the order that slabs have as well
    rank = np.empty(len(by_home), dtype=np.int64)
    rank[by_home] = np.arange(len(by_home))
    dishes, lives, dish_of = dishes[by_home], lives[by_home], rank[dish_of]
    word_at, dish_at = np.cumsum([0] + [len(p[0]) for p in parts]), np.cumsum([0] + [len(p[2]) for p in parts])
    u, w, n, frequent = [], [], [], []
    for i, p in enumerate(parts):
        mine = word_of[word_at[i] : word_at[i + 1]]
        u += [mine[grouped(p[1])], len(words) + p[5]]
        w.append(dish_of[dish_at[i] : dish_at[i + 1]][p[3]])
        n.append(p[4])
        frequent.append(len(p[5]))
    u, w, n = np.concatenate(u), np.concatenate(w), np.concatenate(n)
    keys, place = np.unique(u * max(len(dishes), 1) + w, return_inverse=True)
    count = np.bincount(place, weights=n, minlength=len(keys)).astype(np.int64)
    u, w = keys // max(len(dishes), 1), keys % max(len(dishes), 1)
    plain = int(np.searchsorted(u, len(words)))
    kinds = int(u.max()) + 1 if len(u) else 0
    distinct, customers = np.bincount(u, weights=count > 0, minlength=kinds), np.bincount(u, weights=count, minlength=kinds)
    followers = np.bincount(u[:plain], minlength=len(words))
    rows = [(OWN, me, -1, pack(words, followers, count), ())]
    at = 0
    for i, p in enumerate(parts):
        size = len(p[4])
        mine = place[at : at + size]
        cut = size - frequent[i]
        rows.append((ASKS, me, slab_ids[i], pack(rising(word_of[word_at[i] : word_at[i + 1]]), rising(mine[:cut]), rising(mine[cut:])), ()))
        at += size
    known, ours = distinct[: len(words)] > 0, customers[: len(words)]
    rows.append((SUMS, me, -1, None, ((count == 1).sum(), (count == 2).sum(), (count > 0).sum(), count.sum(), (ours == 1).sum(), (ours == 2).sum(), known.sum())))
    rows += [(HOT, h - len(words), -1, None, (distinct[h], customers[h])) for h in range(len(words), kinds) if customers[h]]
    # for the homes of the dishes: pairs of one customer as a number, others one by one
    first = (np.append(words, hot) & np.uint64(2**32 - 1)).astype(np.int64)
    d, e = distinct[u], customers[u] - distinct[u]
    d[plain:], e[plain:] = u[plain:] - len(words), 0
    singles = np.bincount(w, weights=count == 1, minlength=len(dishes)).astype(np.int64)
    several = np.flatnonzero(count > 1)
    several = several[np.argsort(w[several], kind="stable")]
    ends = np.searchsorted(lives, np.arange(homes + 1))
    cuts = np.searchsorted(w[several], ends)
    for q in np.unique(lives[w[count > 0]]).tolist():
        mine = several[cuts[q] : cuts[q + 1]]
        held = ends[q] + np.flatnonzero(singles[ends[q] : ends[q + 1]])
        names, name = np.unique(np.concatenate([held, w[mine]]), return_inverse=True)
        of = np.bincount(name[: len(held)], weights=singles[held], minlength=len(names)).astype(np.int64)
        rows.append((DISHES, q, me, pack(dishes[names], of, name[len(held) :], count[mine], mine, (mine >= plain).astype(np.int64), d[mine].astype(np.int64), e[mine].astype(np.int64), first[u[mine]]), ()))
    return rows_of(rows)


# 3. Homes of second words: the sweeps


def uniform(key: np.ndarray, *more: int) -> np.ndarray:
    """A number in (0, 1) for each key, the same wherever and whenever it is drawn."""
    x = key.astype(np.uint64)
    for m in more:
        x = (x + np.uint64((m * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(32)
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


def stirling(discount: float, top: int = STIRLING) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers: seatings of n customers at t tables, up to the weights of new tables."""
    out = np.full((top + 1, top + 1), -np.inf)
    out[1, 1] = 0.0
    t = np.arange(1, top + 1)
    with np.errstate(divide="ignore"):
        for n in range(1, top):
            out[n + 1, 1:] = np.logaddexp(out[n, :-1], out[n, 1:] + np.log(np.maximum(n - discount * t, 1e-300)))
            out[n + 1, n + 2 :] = -np.inf
    return out


def draw(n: np.ndarray, open_: np.ndarray, slope: float, share: np.ndarray, grow: np.ndarray | float, table: np.ndarray, discount: float, u: np.ndarray, key: np.ndarray, sweep: int) -> np.ndarray:
    """Tables of n customers of a dish, from the conditional given all others. With i tables of its own, the next one is new with
    weight (open_ + slope i) (share + grow i). ``u``: the random number that decides."""
    t = np.minimum(n, 1)
    grow = np.broadcast_to(grow, n.shape)
    for width in (2, 4, 8, 16, 32, 64, 128, STIRLING):
        more = width == STIRLING
        at = np.flatnonzero((n > (width // 2 if width > 2 else 1)) & ((n <= width) | more))
        for part in np.array_split(at, 1 + len(at) * width // 250_000):
            if len(part):
                i = np.arange(width)
                new = (open_[part, None] + slope * i) * (share[part, None] + grow[part, None] * i)
                first = np.minimum(n[part], width)
                weight = np.cumsum(np.log(new), axis=1) + table[first, 1 : width + 1]
                if more:  # what all seatings of those who come later weigh, if few of them open tables
                    each = np.where(i < first[:, None], new - discount * (i + 1), 0.0)
                    weight += log_gamma(n[part, None] + each) - log_gamma(first[:, None] + each)
                p = np.cumsum(np.exp(weight - weight.max(axis=1, keepdims=True)), axis=1)
                t[part] = np.minimum(1 + (p < u[part, None] * p[:, -1:]).sum(axis=1), first)
    at = np.flatnonzero(n > STIRLING)
    seated, step = STIRLING, 0
    while len(at):
        party = np.minimum(seated // 16, n[at] - seated)
        here = seated + (party - 1) / 2
        new = (open_[at] + slope * t[at]) * (share[at] + grow[at] * t[at])
        change = slope * share[at] + grow[at] * (open_[at] + 2 * slope * t[at]) - discount  # of all weights by one more table
        old = here - discount * t[at]
        new *= ((n[at] + old - here + new) / (old + new)) ** change  # for those who come later
        t[at] += np.minimum(np.floor(party * new / (new + old) + uniform(key[at], sweep, 1000 + step)).astype(np.int64), party)
        seated, step = seated + seated // 16, step + 1
        at = at[n[at] > seated]
    return t


def log_gamma(x: np.ndarray) -> np.ndarray:
    """For numbers that are not small."""
    x = np.maximum(x, 0.5)
    return (x - 0.5) * np.log(x) - x + 1 / (12 * x)


class Known:
    """What all homes know of the whole: discounts, sizes, and the frequent first words."""

    def __init__(self, sums: list[float], hot: np.ndarray):
        once, twice, self.pairs, self.trained, alone, two, kinds = sums
        bound = lambda x: min(max(x, 0.05), 0.95)
        self.discount, self.root_discount = bound((once + 1) / (once + 2 * twice + 2)), bound((alone + 1) / (alone + 2 * two + 2))
        self.hot = hot  # distinct followers and customers of each
        self.words = kinds + float((hot[:, 0] > 0).sum())


def sweeps(parts: list[list[np.ndarray]], homes_of: list[int], known: Known) -> tuple:
    """Dishes' hashes, tokens, singles; of pairs with several customers: home, place there, the frequent first word (or -1),
    customers, and for the last sweeps their tables; for the last sweeps the parent's customers and tables of each dish."""
    join = lambda i, kind=np.int64: np.concatenate([p[i].astype(kind) for p in parts])
    words, word = np.unique(join(0, np.uint64), return_inverse=True)
    single = np.bincount(word, weights=join(1), minlength=len(words)).astype(np.int64)
    at = np.cumsum([0] + [len(p[0]) for p in parts])
    dish = np.concatenate([word[a:][p[2]] for a, p in zip(at, parts)]).astype(np.int64)
    n, place, frequent, d, e, first = (join(i) for i in range(3, 9))
    house = np.repeat(homes_of, [len(p[3]) for p in parts])
    key = words[dish] ^ first.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    hot = np.where(frequent == 1, d, -1)
    if len(known.hot):
        d = np.where(hot >= 0, known.hot[hot, 0], d)
        e = np.where(hot >= 0, known.hot[hot, 1] - known.hot[hot, 0], e)
    order = np.lexsort((key, dish))
    dish, n, place, house, key, hot, d, e = (x[order] for x in (dish, n, place, house, key, hot, d, e))
    size = np.bincount(dish, minlength=len(words))
    nth = np.arange(len(dish)) - (np.cumsum(size) - size)[dish]
    turn = nth * ROUNDS // np.maximum(size[dish], ROUNDS)
    rounds = [np.flatnonzero(turn == x) for x in range(ROUNDS)]
    inner, outer = stirling(known.discount), stirling(known.root_discount)
    t = np.ones(len(n), dtype=np.int64)
    c0 = single + size
    t0 = np.minimum(c0, 1)
    base = 1.0 / (known.words + 1.0)
    kept = []
    for sweep in range(BURN_IN + SAMPLES):
        extra, further = float((t - 1).sum()), float((n - 1).sum())
        rate = extra / further if further else 0.0
        customers = known.pairs + rate * max(known.trained - known.pairs, 0.0)
        more = float(np.maximum(c0 - 1, 0).sum())
        tables = known.words + (float((t0 - np.minimum(c0, 1)).sum()) / more if more else 0.0) * max(customers - known.words, 0.0)
        new = (STRENGTH + known.root_discount * tables) * base
        scale = 1.0 / (STRENGTH + customers)
        for r, mine in enumerate(rounds):
            if not len(mine):
                continue
            others = d[mine] + rate * e[mine] - t[mine]
            left = c0[dish[mine]] - t[mine]
            share = (np.maximum(left - known.root_discount * np.minimum(t0[dish[mine]], left), 0.0) + new) * scale
            drawn = draw(n[mine], STRENGTH + known.discount * np.maximum(others, 0.0), known.discount, share, scale, inner, known.discount, uniform(key[mine], sweep, r), key[mine], sweep)
            c0 = c0 + np.bincount(dish[mine], weights=drawn - t[mine], minlength=len(words)).astype(np.int64)
            t[mine] = drawn
        t0 = draw(c0, np.maximum(STRENGTH + known.root_discount * (tables - t0), STRENGTH), known.root_discount, np.full(len(words), base), 0.0, outer, known.root_discount, uniform(words, sweep, 99), words, sweep)
        if sweep >= BURN_IN:
            kept.append((t.copy(), c0, t0))
    tokens_of = single + np.bincount(dish, weights=n, minlength=len(words)).astype(np.int64)
    return words, tokens_of, house, place, hot, n, kept


def seat(dishes: pa.Table, known: Known) -> pa.Table:
    me = dishes.column("to")[0].as_py()
    order = np.argsort(dishes.column("slab").to_numpy(), kind="stable")
    blobs, homes_of = dishes.column("blob").to_pylist(), dishes.column("slab").to_pylist()
    words, count, house, place, hot, n, kept = sweeps([unpack(blobs[i]) for i in order], [homes_of[i] for i in order], known)
    rows = [(WORDS, me, -1, pack(words, count, *[(c0 - known.root_discount * t0).astype(np.float32) for _, c0, t0 in kept]), ())]
    rows.append((SUMS, me, -1, None, [float(x.sum()) for _, c0, t0 in kept for x in (c0, t0)]))
    back = np.lexsort((place, house))
    cuts = np.flatnonzero(np.diff(house[back], prepend=-1))
    for mine in np.split(back, cuts[1:]) if len(back) else []:
        rows.append((TABLES, int(house[mine[0]]), me, pack(rising(place[mine]), *[t[mine] for t, _, _ in kept]), ()))
    for h in np.unique(hot[hot >= 0]).tolist():
        rows.append((HOT, h, -1, None, [float((t[hot == h] - 1).sum()) for t, _, _ in kept]))
    return rows_of(rows)


# 4. Answers, and scores


def answer(own: pa.Table, found: pa.Table, known: Known, hot_words_: np.ndarray, hot_tables: np.ndarray) -> list[tuple[int, int, bytes]]:
    """(slab, home, blob): for a slab's words tokens, the parent's customers less discounts, and tables in their restaurants, the
    last two for each sample; for its pairs what the seated customers give them."""
    kinds = own.column("kind").to_pylist()
    blobs, slab_ids, me = own.column("blob").to_pylist(), own.column("slab").to_pylist(), own.column("to")[0].as_py()
    words, followers, count = unpack(blobs[kinds.index(OWN)])
    tables = np.repeat(np.minimum(count, 1)[None, :], SAMPLES, axis=0)
    seen, parent = np.zeros(len(words), dtype=np.int64), np.zeros((SAMPLES, len(words)), dtype=np.float32)
    for kind, raw in zip(found.column("kind").to_pylist(), found.column("blob").to_pylist()):
        if kind == TABLES:
            place, *t = unpack(raw)
            tables[:, np.cumsum(place)] = t
        elif kind == WORDS:
            names, n, *c = unpack(raw)
            at = np.minimum(np.searchsorted(names, words), max(len(names) - 1, 0))
            same = names[at] == words if len(names) else np.zeros(len(words), dtype=bool)
            seen[same] = n[at[same]]
            parent[:, same] = np.stack(c)[:, at[same]]
    value = (count - known.discount * tables.mean(axis=0)).astype(np.float32)
    value[count == 0] = 0
    plain = int(followers.sum())
    restaurant = np.stack([np.bincount(grouped(followers), weights=t[:plain], minlength=len(words)) for t in tables]).astype(np.float32)
    numbers = numbers_of(words, hot_words_)
    if len(hot_words_):
        restaurant[:, numbers >= 0] = hot_tables[numbers[numbers >= 0]].T
    out = []
    for kind, slab, raw in zip(kinds, slab_ids, blobs):
        if kind == ASKS:
            w, a, b = (np.cumsum(x) for x in unpack(raw))
            out.append((slab, me, pack(seen[w], *parent[:, w], *restaurant[:, w], value[np.concatenate([a, b]).astype(np.int64)])))
    return out


SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
SCORED_KINDS = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


class Parent:
    """The shared parent as of each sample: V, N, customers, and the share of each word that no table serves."""

    def __init__(self, known: Known, sums: list[float], vocabulary: int, trained: int):
        self.vocabulary, self.trained, self.discount = vocabulary, trained, known.discount
        self.customers, tables = np.array(sums[0::2]), np.array(sums[1::2])
        self.new = (STRENGTH + known.root_discount * tables) / (vocabulary + 1.0)


def fit(data: DataFrame, homes: int) -> tuple[DataFrame, DataFrame, np.ndarray, Parent]:
    """The slabs, the homes' answers to them (slab, home, blob), the frequent words, and the parent."""
    spark = data.sparkSession
    share = min(HOT_SHARES[0], max(HOT_SHARES[1], 1 / homes))
    cut = make_slabs(data, homes, share)
    hot = hot_words(cut, share)
    sums = [F.sum(f"s{i}").alias(f"s{i}") for i in range(7)]

    turns = []
    for turn in range(min(TURNS, homes)):
        turns.append(stored(ask(cut, hot, turn).groupBy("to").applyInArrow(lambda t: merge(t, homes, hot), ROW_KINDS)))
        release(spark)
    merged = reduce(DataFrame.unionByName, turns)
    of_hot = np.zeros((len(hot), 2))
    for r in merged.where(F.col("kind") == HOT).groupBy("to").agg(*sums[:2]).collect():  # a row for each frequent word
        of_hot[r.to] = r.s0, r.s1
    known = Known([x or 0.0 for x in merged.where(F.col("kind") == SUMS).agg(*sums).first()], of_hot)

    seated = stored(merged.where(F.col("kind") == DISHES).select("to", "slab", "blob").groupBy("to").applyInArrow(lambda t: seat(t, known), ROW_KINDS))
    release(spark)
    tables = np.repeat(of_hot[:, :1], SAMPLES, axis=1)
    for r in seated.where(F.col("kind") == HOT).groupBy("to").agg(*sums[:SAMPLES]).collect():
        tables[r.to] += [r[f"s{i}"] for i in range(SAMPLES)]
    whole = [x or 0.0 for x in seated.where(F.col("kind") == SUMS).agg(*sums[: 2 * SAMPLES]).first()]
    parent = Parent(known, whole, round(known.words), round(known.trained))
    schema = pa.schema([("slab", pa.int64()), ("home", pa.int32()), ("blob", pa.binary())])

    def answers(left: pa.Table, right: pa.Table) -> pa.Table:
        found = answer(left, right, known, hot, tables) if left.num_rows else []
        return pa.table({c: [r[i] for r in found] for i, c in enumerate(schema.names)}, schema=schema)

    here = lambda df, *kinds: df.where(F.col("kind").isin(*kinds)).select("kind", "to", "slab", "blob").groupBy("to")
    answered = stored(here(merged, OWN, ASKS).cogroup(here(seated, TABLES, WORDS)).applyInArrow(answers, "slab long, home int, blob binary"))
    release(spark)
    discard(*turns, seated)
    return cut, answered, hot, parent


def score_slab(docs: bytes, ids: bytes, hot: np.ndarray, answers: list[tuple[int, bytes]], parent: Parent) -> dict:
    (doc, none, held, sizes, end, in_home), (at,) = unpack(docs), unpack(ids)
    numbers = np.full(int(in_home.sum()), -1)
    numbers[hot] = 0
    pairs = Pairs(at, int(end[0]), in_home, numbers)
    parts = [unpack(x) for _, x in sorted(answers)]
    join = lambda i: np.concatenate([p[i] for p in parts]).astype(np.float64)
    count = join(0)
    value = np.empty(len(pairs.order))
    value[pairs.order] = join(-1)
    starts, before = np.cumsum(sizes) - sizes, pairs.before
    p = np.zeros(len(at))
    for s in range(SAMPLES):
        of_parent = (join(1 + s) + parent.new[s]) / (STRENGTH + parent.customers[s])
        p += (STRENGTH + parent.discount * join(1 + SAMPLES + s))[before] * of_parent[at]
    p = (p / SAMPLES + value[pairs.of_token]) / (STRENGTH + count[before])
    base = np.log10((count + 1.0) / (parent.trained + parent.vocabulary + 1.0))
    add = lambda x: np.add.reduceat(x, starts)
    return {"doc_id": pa.array(doc, pa.int64(), mask=none > 0), "held_out": held > 0, "n_tokens": sizes, "n_known": add((count > 0).astype(np.int64)[at]), "train_tokens": np.full(len(sizes), parent.trained), "base_score": add(base[at]), "score": add(np.log10(p))}


def score_documents(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    Learns from the documents whose crc32(doc_id as text) mod 7 is not 2 (a null doc_id is learned from). Scores do not depend on
    how rows are batched or split. Null and empty texts are an end alone; repeated rows count and score each; without training
    documents every token is unknown (probability 1 in a vocabulary of none); an empty table gives no rows; further columns are
    ignored.
    """
    data = narrow(docs).withColumn("held_out", F.expr(HELD_OUT))
    homes = max(1, math.ceil((data.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0) / HOME_BYTES))
    cut, answered, hot, parent = fit(data, homes)

    def lighter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of the vocabulary only the numbers of frequent words are needed now."""
        for b in batches:
            found = [np.flatnonzero(numbers_of(unpack(x)[0], hot) >= 0).tolist() for x in b.column("vocabulary").to_pylist()]
            yield pa.record_batch({"slab": b.column("slab"), "docs": b.column("docs"), "ids": b.column("ids"), "hot": pa.array(found, pa.list_(pa.int64()))})

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return SCORED.empty_table()
        replies = list(zip(right.column("home").to_pylist(), right.column("blob").to_pylist()))
        row = {c: left.column(c)[0].as_py() for c in ("docs", "ids", "hot")}
        return pa.table(score_slab(row["docs"], row["ids"], np.array(row["hot"], dtype=np.int64), replies, parent), schema=SCORED)

    light = cut.select("slab", "docs", "ids", "vocabulary").mapInArrow(lighter, "slab long, docs binary, ids binary, hot array<long>")
    result = stored(light.groupBy("slab").cogroup(answered.groupBy("slab")).applyInArrow(score, SCORED_KINDS))
    discard(cut, answered)
    return result
