"""BPE encoding and decoding over a pair occurrence index.

All distinct words of a slab of texts are laid out as one sequence of symbols. An index maps each adjacent pair that has a
merge rank to all its positions. The active ranks are taken in ascending order from a heap; every occurrence of the pair is
merged, and the position lists of the neighbouring pairs that appear are extended. A position whose pair has changed meanwhile
is recognised when its list is reached and skipped, so nothing has to be deleted from a list. Encoded words are kept for later
slabs, and texts are put together from them.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame

from .common import emit, narrow, slabs
from .token_counts import BYTE_CHARS, LETTERS, PLAIN, SPACES

WORD = re.compile(f"'(?:[stmd]|re|ve|ll)|[{LETTERS}]+|[0-9]|[^{SPACES}0-9{LETTERS}]+")
KEPT_WORDS = 1_000_000
SLAB_CHARS = 24_000_000
#: Between words, and of a symbol that was merged into the one before it.
END, GONE = -1, -2
SHIFT = 20
#: Lists shorter than this are merged position by position, longer ones as arrays.
SHORT = 40


class PairIndexBPE:
    """Merges by rank for words written in byte characters. ``merges``: pairs in the order of their rank."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str = ""):
        self.rules: dict[int, int] = {}
        self.parts: list[tuple[int, int, int]] = []
        for rank, (a, b) in enumerate(merges):
            self.parts.append((vocab[a], vocab[b], vocab[a + b]))
            self.rules.setdefault(vocab[a] << SHIFT | vocab[b], rank)
        self.keys = np.array(sorted(self.rules), dtype=np.int64)
        self.ranks = np.array([self.rules[k] for k in self.keys.tolist()], dtype=np.int64)
        inner = [vocab.get(chr(c), GONE) for c in range(0x180)]
        final = [vocab.get(chr(c) + suffix, GONE) for c in range(0x180)]
        self.inner, self.final = np.array(inner, dtype=np.int32), np.array(final, dtype=np.int32)

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """-1: no rule."""
        if not len(self.keys):
            return np.full(len(left), -1)
        want = left.astype(np.int64) << SHIFT | right
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where((self.keys[at] == want) & (left >= 0) & (right >= 0), self.ranks[at], -1)

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and the number of ids of each word."""
        if not words:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        chars = np.frombuffer(("\0".join(words) + "\0").encode("utf-32-le"), dtype=np.uint32)
        ends = chars == 0
        last = np.append(ends[1:], False) & ~ends
        symbols = np.where(ends, END, np.where(last, self.final[chars], self.inner[chars])).astype(np.int32)
        symbols = symbols[symbols != GONE]
        n = len(symbols)
        sym, nxt, prv = array("i", symbols.tobytes()), array("i", range(1, n + 1)), array("i", range(-1, n - 1))
        v_sym, v_nxt, v_prv = (np.frombuffer(x, dtype=np.int32) for x in (sym, nxt, prv))
        parts, rule = self.parts, self.rules.get

        # the index: for each rank, positions as arrays and as single numbers
        arrays: dict[int, list[np.ndarray]] = {}
        single: dict[int, list[int]] = {}
        heap: list[int] = []

        def index(ranks: np.ndarray, positions: np.ndarray) -> None:
            known = ranks >= 0
            ranks, positions = ranks[known], positions[known]
            order = np.argsort(ranks, kind="stable")
            ranks, positions = ranks[order], positions[order]
            cuts = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(ranks)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo < hi:
                    r = int(ranks[lo])
                    if r not in arrays and r not in single:
                        heapq.heappush(heap, r)
                    arrays.setdefault(r, []).append(positions[lo:hi])

        index(self.ranks_of(v_sym[:-1], v_sym[1:]), np.arange(n - 1, dtype=np.int32))
        while heap:
            r = heapq.heappop(heap)
            a, b, new = parts[r]
            blocks, ones = arrays.pop(r, []), single.pop(r, [])
            if a != b and sum(map(len, blocks)) + len(ones) >= SHORT:
                p = np.concatenate([*blocks, np.array(ones, dtype=np.int32)])
                p = np.sort(p[v_sym[p] == a])
                p = p[np.diff(p, prepend=-1) > 0]
                j = v_nxt[p]
                keep = v_sym[j] == b
                p, j = p[keep], j[keep]
                k = v_nxt[j]
                v_sym[p], v_sym[j], v_nxt[p], v_prv[k] = new, GONE, k, p
                h = v_prv[p]
                p0, h = p, h[h >= 0]
                left = self.ranks_of(v_sym[h], np.full(len(h), new))
                right = self.ranks_of(np.full(len(p0), new), v_sym[k])
                index(np.concatenate([left, right]), np.concatenate([h, p0]))
                continue
            for i in sorted(ones + [x for block in blocks for x in block.tolist()]):
                if sym[i] != a or sym[j := nxt[i]] != b:
                    continue
                k = nxt[j]
                sym[i], sym[j], nxt[i], prv[k] = new, GONE, k, i
                h = prv[i]
                for at, x, y in ((h, sym[h] if h >= 0 else END, new), (i, new, sym[k])):
                    if x >= 0 and y >= 0 and (r2 := rule(x << SHIFT | y)) is not None:
                        if r2 in single:
                            single[r2].append(at)
                        else:
                            if r2 not in arrays:
                                heapq.heappush(heap, r2)
                            single[r2] = [at]
        left = v_sym[v_sym != GONE]
        ends_at = np.flatnonzero(left == END)
        return left[left != END], np.diff(ends_at, prepend=-1) - 1


class WordBPE:
    """Encodes and decodes as the library does with a word-level BPE file (normalizer, pattern, end-of-word suffix, no decoder).

    Words of plain texts are found by ``re``; for other texts the library's own normalizer and pre-tokenizer find them.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        spec = json.loads(self.tok.to_str())
        model, added = spec["model"], spec["added_tokens"]
        if model["type"] != "BPE" or model["unk_token"] or model["byte_fallback"] or spec["decoder"] or any(x["normalized"] or x["lstrip"] or x["rstrip"] or x["single_word"] for x in added):
            raise ValueError("only BPE files without unknown token, byte fallback and decoder are supported")
        self.plain = (spec["normalizer"] or {}).get("normalizers") == [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}] and "[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+" in json.dumps(spec["pre_tokenizer"]).replace("\\\\", "\\")
        self.bpe = PairIndexBPE(model["vocab"], [tuple(x) if isinstance(x, list) else tuple(x.split(" ")) for x in model["merges"]], model["end_of_word_suffix"] or "")
        self.added = {x["content"]: x["id"] for x in added}
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if added else None
        named = {i: t for t, i in [*model["vocab"].items(), *self.added.items()]}
        names = [(named.get(i, "") + " ").encode() for i in range(max(named) + 1)]
        self.letters, self.lengths = np.frombuffer(b"".join(names), dtype=np.uint8), np.array([len(x) for x in names])
        self.offsets = np.cumsum(self.lengths) - self.lengths
        self.ids: dict[str, bytes] = {}
        self.reset()

    def reset(self) -> None:
        """Special strings are stored as words that no text can have, written in upper case."""
        self.ids = {self.mark(x): array("I", [i]).tobytes() for x, i in self.added.items()}

    @staticmethod
    def mark(special: str) -> str:
        return f"\0SPECIAL {special}"

    def words(self, text: str) -> list[str]:
        """Distinctly keyed words: plain ones as they are, others in byte characters behind a NUL."""
        if self.special is not None and self.special.search(text):
            return [y for x in self.special.split(text) for y in ([self.mark(x)] if x in self.added else self.words(x))]
        if self.plain and PLAIN.fullmatch(text):
            return WORD.findall(text.lower())
        if not text:
            return []
        norm = self.tok.normalizer.normalize_str(text) if self.tok.normalizer else text
        return ["\0" + w for w, _ in self.tok.pre_tokenizer.pre_tokenize_str(norm)]

    def learn(self, found: set[str]) -> None:
        if len(self.ids) > KEPT_WORDS:
            self.reset()
        new = list(found.difference(self.ids))
        ids, sizes = self.bpe.encode([w[1:] if w[0] == "\0" else w if w.isascii() else w.encode().decode("latin-1").translate(BYTE_CHARS) for w in new])
        raw, ends = ids.astype("<u4").tobytes(), (4 * np.cumsum(sizes)).tolist()
        self.ids.update((w, raw[lo:hi]) for w, lo, hi in zip(new, [0, *ends], ends))

    def encode(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as little-endian 32-bit integers."""
        split = [self.words(x) for x in texts]
        self.learn(set().union(*split))
        ids = self.ids.__getitem__
        return [b"".join(map(ids, found)) for found in split]

    def decode(self, coded: bytes) -> bytes:
        """Tokens joined by spaces, in UTF-8: what a file without a decoder gives."""
        ids = np.frombuffer(coded, dtype="<u4")
        if not len(ids):
            return b""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        return self.letters[np.repeat(self.offsets[ids] - ends + lengths, lengths) + np.arange(ends[-1])].tobytes()[:-1]


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def encode_decode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = True) -> DataFrame:
    """Encode every whole text and decode the ids again.

    With ``digests``: doc_id, n_tokens, and the SHA-256 of the ids (little-endian unsigned 32-bit) and of the decoded text.
    Without: doc_id, n_tokens, token_ids (array<int>), decoded (string). No shuffle; memory is bounded by a slab of text and the
    store of known words. Null and empty texts have no ids and decode to the empty text; repeated rows each give a row; a null
    doc_id stays null; an empty table gives no rows; further columns are ignored.
    """
    schema = SCHEMA if digests else pa.schema([*SCHEMA][:2] + [("token_ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = WordBPE(tokenizer)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for t in slabs(batches, limit=SLAB_CHARS):
            pairs = [(x, coder.decode(x)) for x in coder.encode(t.column("text").to_pylist())]
            columns = {"doc_id": t.column("doc_id"), "n_tokens": [len(a) // 4 for a, _ in pairs]}
            if digests:
                columns |= {"ids_sha256": [sha(a) for a, _ in pairs], "decoded_sha256": [sha(b) for _, b in pairs]}
            else:
                columns |= {"token_ids": [array("i", a).tolist() for a, _ in pairs], "decoded": [b.decode() for _, b in pairs]}
            yield from emit(columns, schema)

    return narrow(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digests else "token_ids array<int>, decoded string"))
