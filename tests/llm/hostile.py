"""Texts that tokenizers trip over."""

import random


def texts():
    rng = random.Random(11)
    out = [None, "", " ", "\n", "\t\r\n ", "a", "A", "don't I'll we've  they're'd 's", "<|endoftext|>", "x<|endoftext|>y <|startoftext|><|endoftext|>", "<|endoftext", "1234567 12a34", "é É ß ſ İ ı ﬀ Å Å ñ", "日本語のテキスト。", "👩‍👩‍👧 🇩🇪🇫🇷 x", "\x00\x01 \x7f\x85\xa0  ", "áë", "###***$$%%&&||<<>>", "x" * 3000, " " * 500 + "end", "ab" * 700 + " " + "\n" * 300, "퟿\U0010ffff", "﻿bom", "\x1c\x1d\x1e\x1f"]
    alphabet = ["the ", "The", " of", "\n", "  ", "'s", "'", "9", "42", "é", "ß", "日", "👍", "!", "...", "\t", "<|endoftext|>", "<|", "Zz", "\xa0", "́"]
    out += ["".join(rng.choices(alphabet, k=rng.randrange(1, 400))) for _ in range(120)]
    plain = "abcdefghij klmno  pqrst\nuvw'xyz0189.,;!?"
    out += ["".join(rng.choices(plain, k=rng.randrange(1, 3000))) for _ in range(60)]
    out.append(" ".join("".join(rng.choices("abcdeéö19", k=rng.randrange(1, 9))) for _ in range(60_000)))  # beyond a chunk
    out.append("".join(rng.choices("日本語", k=90_000)))
    return out


def rows():
    found = list(enumerate(texts()))
    return found + [(5, found[5][1]), (None, "no id"), (None, None)]
