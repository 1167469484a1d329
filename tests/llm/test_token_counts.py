import os

import public_tokenizers
import pytest

from rowloom.llm.token_counts import TokenCounter, count_tokens

from .hostile import rows, texts

os.environ["TOKENIZERS_PARALLELISM"] = "false"


def library(path, found):
    """Counts by the library itself."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return [len(model.encode(x or "")) for x in found]
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    return [len(model.encode(x or "", add_special_tokens=False).ids) for x in found]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_against_the_library(spark, name):
    path, data = public_tokenizers.path(name), rows()
    docs = spark.createDataFrame([(*r, "x", 3) for r in data], "doc_id long, text string, n_tokens string, over_limit int").repartition(3)
    got = count_tokens(docs, path)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    counts = library(path, [t for _, t in data])
    want = [(d, len((t or "").encode()), n, n > 1024) for (d, t), n in zip(data, counts)]
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))


@pytest.mark.parametrize("chunk, overlap", [(7, 2), (64, 8), (300, 40), (5000, 1000)])
def test_splices_against_the_library(chunk, overlap):
    """Chunks so short that nearly every text is spliced, many of them with widened overlaps."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    found = [x for x in texts() if x and len(x) < 4000]
    counter = TokenCounter(path, chunk, overlap)
    assert counter.provable
    assert counter.count(found) == library(path, found)
    assert [counter.spliced(x) for x in found] == library(path, found)


def test_overlaps_widen_until_boundaries_agree():
    """Without a boundary anywhere only the whole rest is right."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    for text in ("a" * 5000, " " * 5000, "!" * 4999 + "a", "<|endoftext|>" * 400, "'" * 3000, "日" * 2000):
        counter = TokenCounter(path, 100, 10)
        assert [counter.spliced(text)] == library(path, [text])


def test_full_store_of_pieces(monkeypatch):
    """The store is cleared meanwhile, which changes nothing."""
    from rowloom.llm import token_counts

    monkeypatch.setattr(token_counts, "KEPT_PIECES", 50)
    path = public_tokenizers.path("byte_bpe_50k.json")
    found = [x or "" for x in texts()][:200]
    counter = TokenCounter(path, 300, 40)
    assert counter.count(found) == library(path, found)
    assert counter.count(found) == library(path, found)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json")).count() == 0
