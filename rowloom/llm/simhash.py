"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint of 64 bits is cut into two segments of 32. If two fingerprints differ in at most 3 bits, one segment differs in at
most one, so the two agree in one of the 32 variants of that segment that blank out a single bit. Every distinct fingerprint is
indexed under its 64 variants; an equality join on the variant brings candidates together, and the full distance verifies them.

A pair may share several variants; it is looked at under one of them only (the first fitting segment, and there the differing
bit, or bit 0 if there is none). Of the links found under a variant only a spanning forest is passed on. In the other segment at
most 3 bits differ, so that one of any 4 pieces of it agrees: a variant of more than HOT fingerprints is dealt out by its bytes
before it reaches a task, and groups beyond DENSE are cut in the task by pieces of the bits that are still free, again and again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FIRST, checkpoint, discard, emit, keyed, narrow, slabs, stored, with_key
from .components import components

MAX_BITS = 3
SEGMENT_BITS = 32
#: Groups beyond this many fingerprints are cut further.
DENSE = 1024
#: Variants beyond this many are dealt out by (byte, its value) as well.
HOT = 100_000


def fingerprint(text: str) -> int:
    """Bit majority over the XXH64 (seed 42) of all 3-word shingles."""
    words = text.encode().lower().split()  # bytes: lower-cases A-Z, splits at space and \\t-\\r
    if not words:
        return 0
    if len(words) < 3:
        digests, n = xxhash.xxh64_digest(b" ".join(words), 42), 1
    else:
        joined, at, n = b" ".join(words), 0, len(words) - 2
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
        starts = np.concatenate([[0], ends[:-3]]).tolist()
        digest = xxhash.xxh64_digest
        digests = b"".join([digest(joined[a:b], 42) for a, b in zip(starts, (ends[2:] - 1).tolist())])
    bits = np.unpackbits(np.frombuffer(digests, dtype=np.uint8)).reshape(n, 64)
    return int.from_bytes(np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > n).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) for each row; fp is the unsigned fingerprint in the bits of a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in slabs(batches):
            fp = np.array([fingerprint(x) for x in t.column("text").to_pylist()], dtype=np.uint64).view(np.int64)
            columns = {"doc_id": t.column("doc_id"), "row_key": t.column("row_key"), "fp": fp}
            yield from emit(columns, pa.schema([(c, pa.int64()) for c in columns]))

    return with_key(narrow(docs)).select("doc_id", "row_key", "text").mapInArrow(run, "doc_id long, row_key long, fp long")


class Forest:
    """Union-find over the members of one group."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, i: int) -> int:
        p = self.parent
        while p[i] != i:
            p[i] = p[p[i]]
            i = p[i]
        return i

    def join(self, i: int, j: int) -> bool:
        a, b = self.find(i), self.find(j)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
        return a != b


def near(left: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within MAX_BITS, of a bounded block at a time."""
    step = max(1, 250_000 // max(1, len(right)))
    for i in range(0, len(left), step):
        a, b = np.nonzero(np.bitwise_count(left[i : i + step, None] ^ right[None, :]) <= MAX_BITS)
        yield a + i, b


def group_links(fps: np.ndarray, segment: int, bit: int) -> list[tuple[int, int]]:
    """A spanning forest of the links that belong to this variant. ``fps``: distinct, alike in the segment but for ``bit``."""
    forest, out = Forest(len(fps)), []
    known = np.arange(len(fps))  # equal numbers: connected already
    shift = np.uint64(SEGMENT_BITS * segment)
    upper = np.uint64(2**32 - 1)
    side = (fps >> (shift + np.uint64(bit))) & np.uint64(1)

    def links(a: np.ndarray, b: np.ndarray) -> None:
        """Between members a and members b; the same array twice: within it."""
        for i, j in near(fps[a], fps[b]):
            i, j = a[i], b[j]
            keep = (known[i] != known[j]) & ((i < j) if a is b else True)
            if segment:  # the first segment fits these as well
                keep &= np.bitwise_count((fps[i] ^ fps[j]) & upper) >= 2
            for x, y in zip(i[keep].tolist(), j[keep].tolist()):
                if forest.join(x, y):
                    out.append((int(fps[x]), int(fps[y])))
            if keep.any() and len(known) > 64:
                known[:] = [forest.find(x) for x in range(len(known))]

    def cut(a: np.ndarray, b: np.ndarray, free: list[int]) -> None:
        """``free``: bits of the other segment that members need not share."""
        if not len(a) or not len(b):
            return
        if len(a) * len(b) <= DENSE * DENSE or len(free) < 4:
            return links(a, b)
        for piece in range(4):
            own = free[piece::4]
            value = lambda of: sum(((other[of] >> np.uint64(x)) & np.uint64(1)) << np.uint64(i) for i, x in enumerate(own))  # noqa: E731, B023
            va, rest = value(a), [x for x in free if x not in own]
            vb = va if a is b else value(b)
            for v in np.intersect1d(va, vb).tolist():
                x = a[va == v]
                cut(x, x if a is b else b[vb == v], rest)

    zero, one = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    other = (fps >> (np.uint64(SEGMENT_BITS) - shift)) & upper
    for a, b in [(zero, one)] + ([(zero, zero), (one, one)] if bit == 0 else []):
        cut(a, b, list(range(SEGMENT_BITS)))
    return out


def by_variant(fps: DataFrame, hot: int) -> DataFrame:
    """(key, part, fp): every fingerprint under its variants; part is -1, or of variants beyond ``hot`` members a byte of the
    other segment with its number."""
    i, mask = F.col("i"), F.lit(2**32 - 1).cast("long")
    segment = F.expr("shiftrightunsigned(fp, 32 * (i div 32))").bitwiseAND(mask)
    key = F.expr("shiftleft(cast(i as long), 32)").bitwiseOR(segment.bitwiseAND(F.expr("~shiftleft(1L, i % 32)")))
    spread = fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # 64 rows come of each
    index = spread.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i")).select(key.alias("key"), "fp")
    whole = lambda df: df.select("key", F.lit(-1).alias("part"), "fp")
    heavy = stored(index.groupBy("key").count().where(F.col("count") > hot).select("key"))
    if heavy.isEmpty():
        discard(heavy)
        return whole(index)
    light = index.join(heavy.hint("merge"), "key", "left_anti")
    other = "shiftrightunsigned(fp, 32 * (1 - cast(shiftrightunsigned(key, 37) as int)))"
    cut = index.join(heavy.hint("merge"), "key", "left_semi").select("key", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("byte"), "fp")
    return whole(light).unionByName(cut.select("key", F.expr(f"cast(byte * 256 + (shiftrightunsigned({other}, 8 * byte) & 255) as int) part"), "fp"))


def variant_links(fps: DataFrame, hot: int = HOT) -> DataFrame:
    """Links (a, b) between distinct fingerprints, enough to connect all that are linked. ``fps``: one column fp, distinct."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        out: list[tuple[int, int]] = []
        rest_k, rest_p, rest_f = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def groups(keys: np.ndarray, parts: np.ndarray, values: np.ndarray) -> None:
            cuts = np.flatnonzero(np.diff(keys) | np.diff(parts)) + 1
            lo, hi = np.append(0, cuts), np.append(cuts, len(keys))
            two = lo[hi - lo == 2]
            x, y, k = values[two], values[two + 1], keys[two]
            seg, bit, diff = k >> 37, ((k >> 32) & 31).astype(np.uint64), x ^ y
            own = (diff >> (np.uint64(32) * seg.astype(np.uint64))) & np.uint64(2**32 - 1)
            fits = (np.bitwise_count(diff) <= MAX_BITS) & ((own != 0) | (bit == 0)) & ((seg == 0) | (np.bitwise_count(diff & np.uint64(2**32 - 1)) >= 2))
            out.extend(zip(x[fits].tolist(), y[fits].tolist()))
            for a, b in zip(lo[hi - lo > 2].tolist(), hi[hi - lo > 2].tolist()):
                out.extend(group_links(values[a:b], int(keys[a] >> 37), int((keys[a] >> 32) & 31)))

        def flush() -> Iterator[pa.RecordBatch]:
            if out:
                pairs = np.array(out, dtype=np.uint64).view(np.int64).reshape(-1, 2)
                out.clear()
                yield from emit({"a": pairs[:, 0], "b": pairs[:, 1]}, schema)

        for batch in batches:
            keys = np.concatenate([rest_k, batch.column(0).to_numpy()])
            parts = np.concatenate([rest_p, batch.column(1).to_numpy()])
            values = np.concatenate([rest_f, batch.column(2).to_numpy().view(np.uint64)])
            if not len(keys):
                continue
            last = int(np.flatnonzero((keys != keys[-1]) | (parts != parts[-1])).max(initial=-1)) + 1  # the last group may go on
            rest_k, rest_p, rest_f = keys[last:], parts[last:], values[last:]
            if last:
                groups(keys[:last], parts[:last], values[:last])
            yield from flush()
        if len(rest_k):
            groups(rest_k, rest_p, rest_f)
        yield from flush()

    index = by_variant(fps, hot)
    return index.repartition("key", "part").sortWithinPartitions("key", "part").mapInArrow(run, "a long, b long")


def rooted(docs: DataFrame) -> DataFrame:
    """The columns of near_duplicates and root: a fingerprint of the component's own, which it has whatever its doc_ids are."""
    fps = checkpoint(fingerprints(docs))
    distinct = checkpoint(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = components(variant_links(distinct.select("fp")))
    roots = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = roots.join(least, "root").select("fp", "component_id", "root")
    return fps.join(ids, "fp").select("doc_id", "row_key", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "root")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, row_key, fingerprint (16 hex digits), component_id.

    Fingerprints link at 3 or fewer differing bits; component_id is the smallest doc_id reachable over links, itself included.
    Equal fingerprints meet by grouping, never as pairs. Null, empty and blank texts have the fingerprint zero, linked like any
    other; repeated rows share everything; a null doc_id never becomes a component_id unless its component has no other; empty
    tables give no rows; further columns are ignored. row_key is a hash of the text.
    """
    return rooted(docs).drop("root")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each component: that of its smallest doc_id (ties: of the smallest hash of the text), all columns
    kept. A null doc_id stays only where its component has no other; of repeated rows one stays; null and empty texts are alike;
    an empty table gives no rows; no column name is reserved.
    """
    first = rooted(docs).groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")).alias("first"))
    rows, key = keyed(docs)
    chosen = first.select(F.coalesce("first.doc_id", F.lit(FIRST)).alias(key[0]), F.col("first.row_key").alias(key[1]))
    return rows.join(chosen.distinct().hint("merge"), key, "left_semi").dropDuplicates(key).drop(*key)
