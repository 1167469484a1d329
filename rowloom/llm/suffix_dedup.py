"""Exact substring dedup over bytes with partitioned suffix arrays.

Every string of ``length`` bytes is assigned to its minimizer, the least of its hashed 32-byte substrings (the leftmost of
equals), so equal strings share one. A maximal run of neighbouring strings with the same minimizer is one *stretch* of text.

1. Minimizers are counted over all documents; only those that occur twice can hold a repeat.
2. Stretches of such minimizers, each distinct one once for every HELD bytes of text, are dealt out by minimizer. Copies of a
   stretch collapse to the earliest. Where a minimizer has several different stretches, each is cut into the strings that begin
   far before the minimizer and those that begin close to it; parts that agree with no other in the bytes that all their strings
   hold drop out. A suffix array over the others (two-stage sorting) and its adjacent common prefixes give all classes of equal
   strings, and which of a stretch's strings start earlier elsewhere.
3. The verdicts (earliest place of a stretch, and a bit for each of its strings) join the documents' stretches again, and the
   texts are cut.

A minimizer with more than ``dense`` stretches (a phrase that many texts share, each in its own surroundings) would make one
task hold them all. The strings of its distinct stretches are dealt out one by one instead, by a hash of 128 bits; the earliest
place of each is a grouping with partial aggregation.

Only hashes, repeated stretches and verdicts travel besides the texts; stretches are compared as bytes within a minimizer, and
known by (minimizer, hash) outside. Tables between the steps are kept in the shared folder until they have been read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEY, discard, emit, narrow, release, slabs, stored, with_key
from .suffix_array import STOP, equal_runs, suffix_array

CORE = 32
SLAB = 2_000_000
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
ROOT = 0x9E3779B97F4A7C15
#: Stretches are sorted together up to about so many bytes.
SORTED_BYTES = 1_500_000
#: Stretches found in so many bytes of text are handed on together.
HELD = 16_000_000


def core_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the CORE bytes from each place on."""
    h = data.astype(np.uint64) + np.uint64(1)
    power, width = ROOT, 1
    while width < CORE:
        h = h[:-width] * np.uint64(power) + h[width:]
        power, width = power * power % 2**64, 2 * width
    for m in MIX:
        h ^= h >> np.uint64(31)
        h *= np.uint64(m)
    return h ^ (h >> np.uint64(29))


def stretches(data: np.ndarray, lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts that follow one another in ``data``: text number, its start, first and last string (by place in data), minimizer
    and its place."""
    ends = np.cumsum(lengths)
    none = np.zeros(0, dtype=np.int64)
    if len(data) < size:
        return none, ends - lengths, none, none, none, none
    hashes = core_hashes(data)
    bits = np.uint64(max(1, int(len(data)).bit_length()))
    least = (hashes >> bits << bits) | np.arange(len(hashes), dtype=np.uint64)
    span, width = size - CORE + 1, 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if span > width:
        least = np.minimum(least[: -(span - width)], least[span - width :])
    place = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    text = np.repeat(np.arange(len(lengths)), lengths)
    valid = text[: len(place)] == text[size - 1 :]
    begins = valid & np.append(True, (place[1:] != place[:-1]) | ~valid[:-1])
    a = np.flatnonzero(begins)
    stops = valid & np.append(begins[1:] | ~valid[1:], True)
    b = np.flatnonzero(stops)
    return text[a], ends - lengths, a, b, hashes[place[a]].view(np.int64), place[a]


def raw(column: pa.ChunkedArray) -> tuple[bytes, np.ndarray]:
    parts = [x.encode() for x in column.to_pylist()]
    return b"".join(parts), np.array([len(x) for x in parts], dtype=np.int64)


def occurrences(batches: Iterator[pa.RecordBatch], size: int):
    """(table, bytes, stretches) for each slab."""
    for t in slabs(batches, limit=SLAB):
        data, lengths = raw(t.column("text"))
        yield t, data, stretches(np.frombuffer(data, dtype=np.uint8), lengths, size)


def repeated_minimizers(docs: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, (_, _, _, _, minimizer, _) in occurrences(batches, size):
            m, n = np.unique(minimizer, return_counts=True)
            yield from emit({"m": m, "n": n}, pa.schema([("m", pa.int64()), ("n", pa.int64())]))

    return stored(docs.select("text").mapInArrow(run, "m long, n long").groupBy("m").agg(F.sum("n").alias("n")).where("n > 1").select("m"))


def of_documents(docs: DataFrame, repeated: DataFrame, size: int) -> DataFrame:
    """(doc, row_key, ms): the repeated minimizers of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, _, (text, _, _, _, minimizer, _) in occurrences(batches, size):
            order = np.lexsort((minimizer, text))
            text, minimizer = text[order], minimizer[order]
            new = np.append(True, (text[1:] != text[:-1]) | (minimizer[1:] != minimizer[:-1])) if len(text) else np.zeros(0, bool)
            columns = {"m": minimizer[new]} | {c: t.column(c).to_numpy()[text[new]] for c in KEY}
            yield from emit(columns, pa.schema([(c, pa.int64()) for c in columns]))

    rows = docs.select(*KEY, "text").mapInArrow(run, "m long, doc long, row_key long")
    return stored(rows.join(repeated.hint("merge"), "m").groupBy(*KEY).agg(F.collect_set("m").alias("ms")))


PART = pa.schema([("m", pa.int64()), ("h", pa.int64()), ("doc", pa.int64()), ("start", pa.int64()), ("n", pa.int64()), ("core", pa.int32()), ("stretch", pa.binary()), ("row_key", pa.int64())])
PART_KINDS = "m long, h long, doc long, start long, n long, core int, stretch binary, row_key long"


def stretch_hash(s: bytes) -> int:
    return xxhash.xxh3_64_intdigest(s) - 2**63


def repeated_stretches(docs: DataFrame, minimizers: DataFrame, size: int) -> DataFrame:
    """Two kinds of rows: distinct stretches with their first place, copies and place of the minimizer (row_key null), and
    (m, h, doc, row_key)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[bytes, list] = {}
        volume = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal volume
            rows = list(found.values())
            columns = {c: [r[i] for r in rows] for i, c in enumerate(("m", "h", "doc", "start", "n", "core"))}
            yield from emit(columns | {"stretch": list(found), "row_key": pa.nulls(len(rows), pa.int64())}, PART, 20_000)
            found.clear()
            volume = 0

        for t, data, (text, base, a, b, minimizer, place) in occurrences(batches, size):
            docs_, keys, wanted = t.column("doc").to_pylist(), t.column("row_key").to_pylist(), t.column("ms").to_pylist()
            cuts = np.searchsorted(text, np.arange(len(docs_) + 1))
            own: list[tuple[int, int, int, int]] = []
            for i, ms in enumerate(wanted):
                lo, hi = int(cuts[i]), int(cuts[i + 1])
                at = lo + np.flatnonzero(np.isin(minimizer[lo:hi], np.array(ms, dtype=np.int64)))
                doc, offset, mine = docs_[i], int(base[i]), set()
                for x, y, m, p in zip(a[at].tolist(), b[at].tolist(), minimizer[at].tolist(), place[at].tolist()):
                    s = data[x : y + size]
                    if (known := found.get(s)) is None:
                        h = stretch_hash(s)
                        found[s] = [m, h, doc, x - offset, 1, p - x]
                    else:
                        h = known[1]
                        known[4] += 1
                        if (doc, x - offset) < (known[2], known[3]):
                            known[2:4] = doc, x - offset
                    mine.add((m, h))
                own += [(m, h, doc, keys[i]) for m, h in mine]
            none = pa.nulls(len(own), pa.int64())
            yield from emit({"m": [o[0] for o in own], "h": [o[1] for o in own], "doc": [o[2] for o in own], "start": none, "n": none, "core": pa.nulls(len(own), pa.int32()), "stretch": pa.nulls(len(own), pa.binary()), "row_key": [o[3] for o in own]}, PART)
            volume += len(data)
            if volume >= HELD:
                yield from flush()
        yield from flush()

    joined = docs.join(minimizers.hint("merge"), KEY)
    return stored(joined.select(*KEY, "text", "ms").mapInArrow(run, PART_KINDS))


Stretch = tuple[int, int, int, int, bytes]  # h, doc, start, place of the minimizer, bytes


def shared_parts(group: list[Stretch], size: int) -> list[tuple[int, int, bytes]]:
    """(number in the group, first string, bytes) of parts that agree with another's in all that their strings have in common."""
    half = (size - CORE) // 2
    by_key: dict[bytes, list[tuple[int, int, bytes]]] = {}
    for i, (_, _, _, core, s) in enumerate(group):
        strings = len(s) - size + 1
        near = min(max(0, core - half), strings)  # strings from here on begin at most ``half`` bytes before the minimizer
        if near < strings:
            by_key.setdefault(b">" + s[core : core + size - half], []).append((i, near, s[near:]))
        if near:
            by_key.setdefault(b"<" + s[core - half - 1 : core + CORE], []).append((i, 0, s[: near - 1 + size]))
    return [x for found in by_key.values() if len(found) > 1 for x in found]


def earlier(parts: list[tuple[int, int, bytes]], size: int) -> list[np.ndarray]:
    """For parts (doc, start, bytes): which of each one's strings start earlier in another."""
    data = np.frombuffer(b"".join(x[2] + bytes([STOP]) for x in parts), dtype=np.uint8)
    lengths = np.array([len(x[2]) + 1 for x in parts])
    begin = np.cumsum(lengths) - lengths
    owner = np.repeat(np.arange(len(parts)), lengths)
    offset = np.arange(len(data)) - begin[owner]
    whole = offset + size < lengths[owner]  # a full string is left before the end
    order = suffix_array(data, size)
    order = order[whole[order]]
    classes = equal_runs(data, order, size)
    doc, start = np.array([x[0] for x in parts]), np.array([x[1] for x in parts])
    d, p = doc[owner[order]], start[owner[order]] + offset[order]
    rank = np.lexsort((p, d, classes))
    lead = np.append(True, np.diff(classes[rank]) > 0)
    first = rank[np.maximum.accumulate(np.where(lead, np.arange(len(rank)), 0))]
    later = np.zeros(len(order), dtype=bool)
    later[rank] = (d[rank] != d[first]) | (p[rank] != p[first])
    flags = np.zeros(len(data), dtype=bool)
    flags[order] = later
    return [flags[o : o + len(x[2]) - size + 1] for x, o in zip(parts, begin.tolist())]


VERDICT = pa.schema([("m", pa.int64()), ("h", pa.int64()), ("first_doc", pa.int64()), ("first_start", pa.int64()), ("bits", pa.binary())])
VERDICT_KINDS = "m long, h long, first_doc long, first_start long, bits binary"


def verdicts(rows: DataFrame, size: int) -> DataFrame:
    """(m, h, first_doc, first_start, bits) for stretches with a string that is not everywhere the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        waiting: list[tuple[int, list[Stretch], list[int]]] = []
        parts: list[tuple[int, int, int, bytes]] = []  # number among the waiting, in that group, first string, bytes
        volume = 0
        current: dict[bytes, list] = {}  # h, doc, start, core, copies
        minimizer = None

        def close() -> None:
            nonlocal volume
            if len(current) > 1:
                group: list[Stretch] = [(*x[:4], s) for s, x in current.items()]
                if found := shared_parts(group, size):
                    parts.extend((len(waiting), *x) for x in found)
                    waiting.append((minimizer, group, [x[4] for x in current.values()]))
                    volume += sum(len(x[2]) for x in found)
                    current.clear()
            out.extend((minimizer, x[0], x[1], x[2], None) for x in current.values() if x[4] > 1)
            current.clear()

        def solve() -> None:
            nonlocal volume
            if parts:
                flags = [[None] * len(group) for _, group, _ in waiting]
                found = earlier([(waiting[w][1][i][1], waiting[w][1][i][2] + at, s) for w, i, at, s in parts], size)
                for (w, i, at, _), f in zip(parts, found):
                    if f.any():
                        if flags[w][i] is None:
                            flags[w][i] = np.zeros(len(waiting[w][1][i][4]) - size + 1, dtype=bool)
                        flags[w][i][at : at + len(f)] |= f
                for (m, group, copies), of in zip(waiting, flags):
                    out.extend((m, h, doc, start, None if f is None else np.packbits(f).tobytes()) for (h, doc, start, _, _), n, f in zip(group, copies, of) if n > 1 or f is not None)
            waiting.clear()
            parts.clear()
            volume = 0

        def flush() -> Iterator[pa.RecordBatch]:
            if out:
                yield from emit({c: [r[i] for r in out] for i, c in enumerate(VERDICT.names)}, VERDICT)
                out.clear()

        for batch in batches:
            for m, h, doc, start, n, core, s in zip(*(batch.column(i).to_pylist() for i in range(7))):
                if m != minimizer:
                    if current:
                        close()
                    if volume >= SORTED_BYTES:
                        solve()
                    minimizer = m
                if (known := current.get(s)) is None:
                    current[s] = [h, doc, start, core, n]
                else:
                    known[4] += n
                    if (doc, start) < (known[1], known[2]):
                        known[1:3] = doc, start
            yield from flush()
        close()
        solve()
        yield from flush()

    return rows.repartition("m").sortWithinPartitions("m").mapInArrow(run, VERDICT_KINDS)


def dense_verdicts(rows: DataFrame, size: int) -> DataFrame:
    """The same for stretches of minimizers that have very many: each string goes by itself, none by its minimizer."""
    least = F.min(F.struct("doc", "start")).alias("first")
    each = stored(rows.groupBy("m", "h").agg(least, F.sum("n").alias("n"), F.first("stretch").alias("stretch")).select("m", "h", "first.doc", "first.start", "n", "stretch"))

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("m", pa.int64()), ("h", pa.int64()), ("i", pa.int32()), ("doc", pa.int64()), ("start", pa.int64()), ("g", pa.binary())])
        for batch in batches:
            found = []
            for m, h, doc, start, s in zip(*(batch.column(c).to_pylist() for c in ("m", "h", "doc", "start", "stretch"))):
                found += [(m, h, i, doc, start + i, xxhash.xxh3_128_digest(s[i : i + size])) for i in range(len(s) - size + 1)]
            yield from emit({c: [r[i] for r in found] for i, c in enumerate(schema.names)}, schema)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = []
            for at in batch.column("at").to_pylist():
                f = np.zeros(max(at) + 1 if at else 0, dtype=bool)
                f[at or []] = True
                bits.append(np.packbits(f).tobytes() if at else None)
            yield pa.record_batch([*(batch.column(c) for c in ("m", "h", "first_doc", "first_start")), pa.array(bits, pa.binary())], schema=VERDICT)

    all_ = each.mapInArrow(strings, "m long, h long, i int, doc long, start long, g binary")
    firsts = all_.groupBy("g").agg(least, F.count("*").alias("places")).where("places > 1").select("g", "first")
    later = all_.join(firsts.hint("merge"), "g").where((F.col("doc") != F.col("first.doc")) | (F.col("start") != F.col("first.start")))
    flagged = later.groupBy("m", "h").agg(F.collect_set("i").alias("at"))  # as many numbers as a stretch has strings
    judged = each.join(flagged.hint("merge"), ["m", "h"], "left").where("n > 1 or at is not null")
    return judged.select("m", "h", F.col("doc").alias("first_doc"), F.col("start").alias("first_start"), "at").mapInArrow(packed, VERDICT_KINDS)


def all_verdicts(parts: DataFrame, size: int, dense: int) -> DataFrame:
    rows = parts.where("row_key is null").select("m", "h", "doc", "start", "n", "core", "stretch")
    heavy = stored(rows.groupBy("m").count().where(F.col("count") > dense).select("m"))
    if heavy.isEmpty():
        discard(heavy)
        return stored(verdicts(rows, size))
    light = verdicts(rows.join(heavy.hint("merge"), "m", "left_anti"), size)
    found = stored(light.unionByName(dense_verdicts(rows.join(heavy.hint("merge"), "m", "left_semi"), size)))
    discard(heavy)
    return found


def removed(text: bytes, own: tuple[np.ndarray, np.ndarray, np.ndarray], found: dict[tuple[int, int], tuple[int | None, bytes | None]], size: int) -> np.ndarray:
    """Which bytes go. ``own``: first and last string, and minimizer, of the text's stretches. ``found``: for a stretch (by
    minimizer and hash), where its first occurrence starts if that is in this document, and its bits."""
    edge = np.zeros(len(text) + 1, dtype=np.int64)
    wanted = np.flatnonzero(np.isin(own[2], np.array([m for m, _ in found])))
    for x, y, m in zip(*(z[wanted].tolist() for z in own)):
        v = found.get((m, stretch_hash(text[x : y + size])))
        if v is None:
            continue
        if v[0] != x:
            edge[x] += 1
            edge[y + size] -= 1
        elif v[1]:
            at = x + np.flatnonzero(np.unpackbits(np.frombuffer(v[1], dtype=np.uint8)))
            edge[at] += 1  # places differ from each other
            edge[at + size] -= 1
    return np.cumsum(edge[:-1]) > 0


OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def dedup_bytes(docs: DataFrame, length: int = 100, texts: bool = False, dense: int = 100_000) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256; with ``texts`` also
    kept (binary: a cut may fall inside a character).

    A byte goes if a string of ``length`` bytes covers it that also starts earlier: in a smaller doc_id, or in the same document
    at an earlier place. Null and empty texts have no bytes; a null doc_id comes before all others; rows that repeat a doc_id
    are not held against one another beyond what they hold against themselves; an empty table gives no rows; further columns
    are ignored. ``dense`` does not change the result.
    """
    spark, data = docs.sparkSession, with_key(narrow(docs))
    repeated = repeated_minimizers(data, length)
    minimizers = of_documents(data, repeated, length)
    discard(repeated)
    release(spark)
    parts = repeated_stretches(data, minimizers, length)
    discard(minimizers)
    release(spark)
    found = all_verdicts(parts, length, dense)
    release(spark)
    own = parts.where("row_key is not null").select("m", "h", "doc", "row_key")
    again = own.join(found.hint("merge"), ["m", "h"])
    here = F.col("doc") == F.col("first_doc")
    results = stored(again.groupBy(*KEY).agg(F.collect_list(F.struct("m", "h", F.when(here, F.col("first_start")).alias("start"), F.when(here, F.col("bits")).alias("bits"))).alias("found")))
    discard(parts, found)
    release(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in slabs(batches, limit=SLAB):
            rows = []
            data, lengths = raw(t.column("text"))
            text, base, a, b, minimizer, _ = stretches(np.frombuffer(data, dtype=np.uint8), lengths, length)
            cuts = np.searchsorted(text, np.arange(len(lengths) + 1)).tolist()
            hits = (t.column(c).to_pylist() for c in ("m", "h", "start", "bits"))
            for i, (doc, o, n, m, *of) in enumerate(zip(t.column("doc_id").to_pylist(), base.tolist(), lengths.tolist(), *hits)):
                kept, gone, spans = data[o : o + n], 0, 0
                if m:
                    own = slice(cuts[i], cuts[i + 1])
                    mask = removed(kept, (a[own] - o, b[own] - o, minimizer[own]), dict(zip(zip(m, of[0]), zip(of[1], of[2]))), length)
                    gone = int(mask.sum())
                    if gone:
                        spans = int(mask[0]) + int((mask[1:] & ~mask[:-1]).sum())
                        kept = np.frombuffer(kept, dtype=np.uint8)[~mask].tobytes()
                rows.append((doc, n, gone, spans, hashlib.sha256(kept).hexdigest(), kept))
            schema = OUT.append(pa.field("kept", pa.binary())) if texts else OUT
            yield from emit({c: [r[i] for r in rows] for i, c in enumerate(schema.names)}, schema)

    joined = data.join(results.hint("merge"), KEY, "left").select("doc_id", "text", "found.m", "found.h", "found.start", "found.bits")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if texts else ""))
