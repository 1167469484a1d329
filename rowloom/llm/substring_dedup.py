"""Substring dedup by sliding sentence spans.

A text is cut into sentences (whatever ends in ., ! or ? before white space, or at a line break; very long ones also after the
word of the least hash of any WINDOW words, so that pieces are short and any 50 words shared by two of them hold a span of 2 pieces
and 16 words that both have). From each sentence a span runs over consecutive ones until it holds ``several`` whole sentences
of any length, or at least ``min_sentences`` pieces with ``min_words`` words; and likewise one that ends at it. Spans are hashed
(96 bits) over their lower-cased words and joined globally. The first occurrence of a span is the one in the smallest doc_id,
there the earliest; sentences covered by any other occurrence are removed.

Only (hash, doc_id) travel, once per document and span. Which hashes repeat comes from a grouping with partial aggregation, so a passage in a third of all documents costs one row for each task; sending the verdicts back is an equi-join
with unique keys on one side, whose hot keys adaptive execution splits. Repeats inside a document are found where the text is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import emit, keyed, narrow, slabs, stored, with_key

#: Ends a sentence if the match ends in white space.
BREAK = re.compile(r"[\n.!?…。！？]+(?:[\"'”’)\]]*\s+)?")
LONG_WORDS = 32
WINDOW = 8
SLAB = 2_000_000
#: 96 bits of a hash.
HASH = np.dtype([("a", "<i8"), ("b", "<i4")])


def cuts(bare: list[str]) -> np.ndarray:
    """After which words a long sentence is cut: the last of the least hashes of any WINDOW words, and , ; or :."""
    h = np.array([xxhash.xxh32_intdigest(w) if w else 2**32 for w in bare], dtype=np.int64)
    windows = np.lib.stride_tricks.sliding_window_view(h, WINDOW)[:, ::-1]
    out = np.array([w[-1:] in (",", ";", ":") for w in bare])
    out[np.arange(WINDOW - 1, len(bare)) - windows.argmin(axis=1)] = True
    return out


def sentences(text: str) -> tuple[list[str], list[bool]]:
    """Pieces that join to the text, and which of them are whole sentences."""
    out, whole = [], []
    start = 0
    ends = [end for m in BREAK.finditer(text) if text[(end := m.end()) - 1].isspace()]
    if not ends or ends[-1] != len(text):
        ends.append(len(text))
    for end in ends:
        s = text[start:end]
        if end - start > 2 * LONG_WORDS and len(words := re.findall(r"\S+\s*|^\s+", s)) > LONG_WORDS:
            ends_here = np.flatnonzero(cuts([w.strip().lower() for w in words])) + 1
            at = [0, *ends_here.tolist(), len(words)]
            parts = ["".join(words[a:b]) for a, b in zip(at, at[1:]) if a < b]
            out += parts
            whole += [False] * len(parts)
        elif s:
            out.append(s)
            whole.append(True)
        start = end
    return out, whole


def spans(pieces: list[str], whole: list[bool], min_sentences: int, min_words: int, several: int) -> list[tuple[bytes, int, int]]:
    """(hash, first piece, end) of each distinct run; white space and case do not count."""
    normal = [b" ".join(x.split()) for x in "\0".join(pieces).lower().encode().split(b"\0")] if not any("\0" in x for x in pieces) else [b" ".join(x.lower().encode().split()) for x in pieces]
    full = [i for i, w in enumerate(normal) if w]  # pieces without a word neither count nor separate
    joined = [normal[i] for i in full]
    sizes = [x.count(b" ") + 1 for x in joined]
    own = [whole[i] for i in full]
    n = len(full)
    if n < min_sentences:
        return []
    runs: list[tuple[int, int]] = []
    total, count, end = 0, 0, 0
    ends = [0] * n  # of the run that starts at each piece
    for start in range(n):
        while count < several and (total < min_words or end - start < min_sentences):
            if end == n:
                break
            total += sizes[end]
            count += own[end]
            end += 1
        else:
            runs.append((start, end))
            ends[start] = end
            total -= sizes[start]
            count -= own[start]
            continue
        break
    total, count, start = 0, 0, n
    for end in range(n, 0, -1):
        while count < several and (total < min_words or end - start < min_sentences):
            if not start:
                break
            start -= 1
            total += sizes[start]
            count += own[start]
        else:
            if ends[start] != end:
                runs.append((start, end))
            total -= sizes[end - 1]
            count -= own[end - 1]
            continue
        break
    runs.sort()
    digest = xxhash.xxh3_128_digest
    return [(digest(b" ".join(joined[a:b]))[: HASH.itemsize], full[a], full[b - 1] + 1) for a, b in runs]


def cleaned(text: str, repeated: set[bytes], min_sentences: int, min_words: int, several: int) -> tuple[str, int, int]:
    """The text without covered sentences, how many there were, how many went. ``repeated``: hashes with an earlier document."""
    pieces, whole = sentences(text)
    seen: set[bytes] = set()
    gone: set[int] = set()
    for h, a, b in spans(pieces, whole, min_sentences, min_words, several):
        if h in repeated or h in seen:
            gone.update(range(a, b))
        seen.add(h)
    return ("".join([x for i, x in enumerate(pieces) if i not in gone]) if gone else text), len(pieces), len(gone)


def repeated_spans(docs: DataFrame, min_sentences: int, min_words: int, several: int) -> DataFrame:
    """(doc, hashes): the spans of a document that a smaller doc_id has as well, each of two numbers a and b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int32()), ("doc", pa.int64())])
        for t in slabs(batches, limit=SLAB):
            found = [{x for x, _, _ in spans(*sentences(text), min_sentences, min_words, several)} for text in t.column("text").to_pylist()]
            parts = np.frombuffer(b"".join([x for own in found for x in own]), dtype=HASH)
            yield from emit({"a": parts["a"], "b": parts["b"], "doc": np.repeat(t.column("doc").to_numpy(), [len(x) for x in found])}, schema)

    rows = stored(with_key(narrow(docs)).select("doc", "text").mapInArrow(run, "a long, b int, doc long"))
    shared = rows.groupBy("a", "b").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").select("a", "b", "first")
    again = rows.join(shared.hint("merge"), ["a", "b"]).where("doc > first")
    return again.groupBy("doc").agg(F.collect_set(F.struct("a", "b")).alias("hashes"))


def dedup_spans(docs: DataFrame, min_sentences: int = 2, min_words: int = 16, several: int = 3) -> DataFrame:
    """``docs`` with ``text`` cleaned, all other columns as they are, and n_sentences and n_removed (long) in front of them.

    Rows of the same doc_id are not held against each other; a null doc_id comes before all others; exact repeats inside one
    text are removed too. Null and empty texts stay as they are; a text whose every sentence is covered becomes empty; rows are
    never dropped; an empty table gives no rows; clashing names (n_sentences, n_removed) are replaced, no other is reserved.
    """
    hits = repeated_spans(docs, min_sentences, min_words, several)
    rest = docs.drop("n_sentences", "n_removed")
    rows, key = keyed(rest)
    given = ["hashes_a", "hashes_b"]
    while {c.lower() for c in rows.columns} & set(given):
        given = [c + "_" for c in given]
    hits = hits.select(F.col("doc").alias(key[0]), *[F.col(f"hashes.{c}").alias(g) for c, g in zip("ab", given)])
    joined = rows.join(hits.hint("merge"), key[0], "left").select(*rest.columns, *given)
    names = rest.columns
    kinds = ["n_sentences long", "n_removed long", *(f"`{c}` {t}" for c, t in rest.dtypes)]

    def hashes(a: list[int] | None, b: list[int] | None) -> set[bytes]:
        both = np.empty(len(a or ()), dtype=HASH)
        both["a"], both["b"] = a or [], b or []
        return {x.tobytes() for x in both}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in slabs(batches, limit=SLAB):
            found = [(x, 0, 0) if x is None else cleaned(x, hashes(a, b), min_sentences, min_words, several) for x, a, b in zip(*(t.column(c).to_pylist() for c in ("text", *given)))]
            columns = {"n_sentences": pa.array([n for _, n, _ in found], pa.int64()), "n_removed": pa.array([g for _, _, g in found], pa.int64())}
            columns |= {c: pa.array([x for x, _, _ in found], pa.string()) if c == "text" else t.column(c) for c in names}
            yield from pa.table(columns).to_batches(max_chunksize=20_000)

    return joined.mapInArrow(run, ", ".join(kinds))
