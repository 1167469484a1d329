import hashlib
import heapq
import os
import random
import struct

import public_tokenizers
import pytest

from rowloom.llm.bpe import PairIndexBPE, WordBPE, encode_decode

from .hostile import rows, texts

os.environ["TOKENIZERS_PARALLELISM"] = "false"
PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(PATH)
    model.no_truncation()
    model.no_padding()
    return model


def test_against_the_library(spark, library):
    data = rows()
    docs = spark.createDataFrame([(*r, "x", 3) for r in data], "doc_id long, text string, n_tokens string, decoded_sha256 int").repartition(3)
    got = encode_decode(docs, PATH)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    want = []
    for doc, text in data:
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want.append((doc, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))


def test_tokens_and_texts(spark, library):
    data = [(i, t) for i, t in enumerate(texts()) if t is None or len(t) < 5000]
    got = {r.doc_id: r for r in encode_decode(spark.createDataFrame(data, "doc_id long, text string"), PATH, digests=False).collect()}
    for doc, text in data:
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert got[doc].token_ids == ids and got[doc].n_tokens == len(ids)
        assert got[doc].decoded == library.decode(ids, skip_special_tokens=False)


def merged(word, ranks):
    """One word, the least rank first, the leftmost of equals."""
    parts = list(word)
    while True:
        found = [(ranks[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in ranks]
        if not found:
            return parts
        rank, _ = heapq.nsmallest(1, found)[0]
        i = 0
        while i < len(parts) - 1:
            if ranks.get((parts[i], parts[i + 1])) == rank:
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            i += 1


def test_merges_against_brute_force():
    """Few letters and many merges, of equal symbols too, in lists above and below the length for arrays."""
    rng = random.Random(6)
    for _ in range(20):
        symbols, merges = list("abc"), []
        for _ in range(25):
            a, b = rng.choice(symbols), rng.choice(symbols)
            if (a, b) not in merges and len(a + b) < 9:
                merges.append((a, b))
                symbols.append(a + b)
        vocab = {s: i for i, s in enumerate(dict.fromkeys(symbols))}
        words = ["".join(rng.choices("abc", k=rng.randrange(1, 40))) for _ in range(rng.choice([3, 300]))]
        ids, sizes = PairIndexBPE(vocab, merges).encode(words)
        ranks = {p: i for i, p in enumerate(merges)}
        want = [[vocab[x] for x in merged(w, ranks)] for w in words]
        assert ids.tolist() == [x for w in want for x in w] and sizes.tolist() == [len(w) for w in want]


def test_full_store_of_words(monkeypatch, library):
    from rowloom.llm import bpe

    monkeypatch.setattr(bpe, "KEPT_WORDS", 20)
    coder, found = WordBPE(PATH), [x or "" for x in texts()[:100]]
    for part in (found[:50], found[50:], found[:50]):
        got = [list(struct.unpack(f"<{len(x) // 4}I", x)) for x in coder.encode(part)]
        assert got == [library.encode(x, add_special_tokens=False).ids for x in part]


def test_empty(spark):
    assert encode_decode(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
