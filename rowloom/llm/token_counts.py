"""Token counts with overlap resynchronisation.

A document is encoded in chunks that overlap. Two encodings of neighbouring chunks are spliced at a boundary of pre-tokens
that both contain. Such a boundary is *proven stable*: the splitting pattern never looks behind the place where a match
begins, so from a common boundary on both encodings must agree; it must lie far enough from the left chunk's end (look-ahead)
and from the right chunk's start (special strings cut in two) to be true in each. Where the overlap holds no such boundary it
is doubled, in the end up to the whole rest of the document, which is always right.

Pieces between boundaries repeat a lot, so each distinct piece is encoded by the tokenizer library once per slab.
"""

from __future__ import annotations

import json
import os
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame

from .common import emit, narrow, slabs

LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
SPACES = "\\t-\\r "
#: Texts of these characters are split by ``re``; all others by the library itself.
PLAIN = re.compile(f"[{SPACES}!-~À-ÖØ-öø-ÿ]*")
PIECE = re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{LETTERS}]+| ?[0-9]+| ?[^{SPACES}0-9{LETTERS}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")
LOOK_AHEAD = 4
KEPT_PIECES = 1_500_000


def byte_chars() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


BYTE_CHARS = byte_chars()


class TokenCounter:
    """Counts as the library's ``encode(text, add_special_tokens=False)`` does.

    ``.json`` files go to ``tokenizers``, ``.model`` files to ``sentencepiece``. Chunking and piecewise counting are used for
    byte-level BPE without a normalizer, where boundaries can be proven; other tokenizers encode whole texts.
    """

    def __init__(self, path: str, chunk_chars: int = 65_536, overlap_chars: int = 1_024):
        self.chunk, self.overlap = chunk_chars, overlap_chars
        self.pieces: dict[str, int] = {}
        self.cleared = 0
        self.sp = None
        if path.endswith(".model"):
            import sentencepiece

            self.sp, self.provable = sentencepiece.SentencePieceProcessor(model_file=path), False
            return
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        spec = json.loads(self.tok.to_str())
        pre = spec["pre_tokenizer"] or {}
        self.provable = not spec["normalizer"] and pre.get("type") == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"]
        special = [x["content"] for x in spec["added_tokens"]]
        self.provable = self.provable and not any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in spec["added_tokens"])
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.specials = frozenset(special)
        self.margin = max([LOOK_AHEAD, *map(len, special)]) + 1

    def learn(self, found: set[str]) -> None:
        if len(self.pieces) > KEPT_PIECES:
            self.pieces.clear()
            self.cleared += 1
        tokenize = self.tok.model.tokenize
        for x in found.difference(self.pieces):
            self.pieces[x] = 1 if x in self.specials else len(tokenize(x.encode().decode("latin-1").translate(BYTE_CHARS)))

    def split(self, text: str) -> list[str] | None:
        """Pieces of a plain text that join to it, special strings whole; None if only the library can split it."""
        if not PLAIN.fullmatch(text):
            return None
        if self.special is None or not self.special.search(text):
            return PIECE.findall(text)
        return [y for x in self.special.split(text) for y in ([x] if x in self.specials else PIECE.findall(x))]

    def spans(self, text: str) -> tuple[list[int], list[int]]:
        """Starts of pre-tokens in a chunk, and the tokens before each; both end with the totals."""
        if (found := self.split(text)) is not None:
            self.learn(set(found))
            return [0, *accumulate(map(len, found))], [0, *accumulate(map(self.pieces.__getitem__, found))]
        enc = self.tok.encode(text, add_special_tokens=False)
        starts, before, last = [], [], object()
        for i, (word, (a, _)) in enumerate(zip(enc.word_ids, enc.offsets)):
            if word is None or word != last:
                starts.append(a)
                before.append(i)
            last = word
        return [*starts, len(text)], [*before, len(enc.ids)]

    def spliced(self, text: str) -> int:
        n, base, overlap = len(text), 0, self.overlap
        end = min(n, self.chunk)
        starts, before = self.spans(text[:end])
        first, total = 0, 0
        while end < n:
            low = max(base + 1, end - overlap)
            stop = min(n, low + max(self.chunk, 2 * overlap))
            right, counts = self.spans(text[low:stop])
            mine = {low + s: i for i, s in enumerate(right[:-1]) if s >= self.margin}
            at = bisect_left(starts, end - base - self.margin)
            cut = next((i for i in range(min(at, len(starts) - 1), first, -1) if base + starts[i] in mine and base + starts[i] <= end - self.margin), None)
            if cut is not None:
                total += before[cut] - before[first]
                first, base, starts, before, end, overlap = mine[base + starts[cut]], low, right, counts, stop, self.overlap
            elif low <= base + starts[first] + 1:  # the overlap is all there is: encode more from the last proven place
                base += starts[first]
                end = min(n, base + 2 * (end - base) + self.chunk)
                starts, before = self.spans(text[base:end])
                first = 0
            else:
                overlap *= 2
        return total + before[-1] - before[first]

    def count(self, texts: list[str]) -> list[int]:
        if self.sp is not None:
            return [len(x) for x in self.sp.encode(texts, num_threads=1)]
        if not self.provable:
            return [len(x) for x in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        out: list[int] = []
        for i in range(0, len(texts), 512):
            part = texts[i : i + 512]
            split = [self.split(x) if len(x) <= self.chunk else None for x in part]
            wanted = set().union(*(x for x in split if x is not None))
            self.learn(wanted)
            known, cleared = self.pieces.__getitem__, self.cleared
            for text, found in zip(part, split):
                if found is not None:
                    out.append(sum(map(known, found)))
                elif len(text) > self.chunk:
                    out.append(self.spliced(text))
                    if self.cleared != cleared:
                        self.learn(wanted)
                        cleared = self.cleared
                else:
                    out.append(len(self.tok.encode(text, add_special_tokens=False).ids))
        return out


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 1024, chunk_chars: int = 65_536, overlap_chars: int = 1_024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    No shuffle; memory is bounded by a slab of text and the store of known pieces. ``tokenizer`` is a path that executors can
    read. Null and empty texts have 0 bytes and tokens; repeated rows each give a row; a null doc_id stays null; an empty table
    gives no rows; further columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TokenCounter(tokenizer, chunk_chars, overlap_chars)
        for t in slabs(batches):
            texts = t.column("text")
            n = counter.count(texts.to_pylist())
            yield from emit({"doc_id": t.column("doc_id"), "n_bytes": pa.compute.binary_length(texts).cast(pa.int64()), "n_tokens": n, "over_limit": [x > limit for x in n]}, SCHEMA)

    return narrow(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
