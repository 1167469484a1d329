import random
import re

from rowloom.llm.substring_dedup import cleaned, dedup_spans, sentences, spans


def brute_pieces(text):
    """Without the code's own cutting; only for texts without sentences of over 32 words."""
    return [x for x in re.split(r"(?<=[.!?]\s)(?=\S)|(?<=\n)", text) if x]


def brute_spans(pieces, whole, min_sentences=2, min_words=16, several=3):
    """The shortest run from each piece on, and up to each piece."""
    full = [i for i, x in enumerate(pieces) if x.split()]
    fits = lambda at: sum(whole[i] for i in at) >= several or len(at) >= min_sentences and sum(len(pieces[i].split()) for i in at) >= min_words
    runs = set()
    for i in range(len(full)):
        runs.update((i, j) for j in [next((j for j in range(i + 1, len(full) + 1) if fits(full[i:j])), None)] if j)
        runs.update((j, i + 1) for j in [next((j for j in range(i, -1, -1) if fits(full[j : i + 1])), None)] if j is not None)
    return [(" ".join(w.lower() for k in full[a:b] for w in pieces[k].split()), full[a], full[b - 1] + 1) for a, b in sorted(runs)] if len(full) >= min_sentences else []


def brute(rows, cut=sentences):
    """rows: (doc_id, text); judged one after the other."""
    seen = {}
    out = {}
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0))
    for i in order:
        doc, text = rows[i]
        pieces, whole = cut(text or "")
        gone, own = set(), set()
        for h, a, b in brute_spans(pieces, whole):
            if h in own or seen.get(h, doc) != doc:
                gone.update(range(a, b))
            own.add(h)
        for h in own:
            seen.setdefault(h, doc)
        out[i] = None if text is None else "".join(x for k, x in enumerate(pieces) if k not in gone)
    return out


def sentence(rng, n=None):
    return " ".join(f"w{rng.randrange(5000)}" for _ in range(n or rng.randrange(1, 14))).capitalize() + rng.choice(".!?")


def test_pieces_join():
    for t in ["", "a", "A. B.\n\nC", "\n\n", "no end " * 100, 'He said "x." Then.', "a.b c", "x.\n y!  "]:
        assert "".join(sentences(t)[0]) == t


def test_against_brute_force(spark):
    rng = random.Random(2)
    shared = [" ".join(sentence(rng) for _ in range(9)) for _ in range(4)]
    endless = " ".join(f"u{rng.randrange(9000)}" for _ in range(120))
    rows = []
    for i in range(60):
        parts = [sentence(rng) for _ in range(rng.randrange(1, 12))]
        if i % 3 == 0:
            parts.insert(rng.randrange(len(parts)), shared[i % 4])
        if i in (7, 8):
            parts.append(endless)
        rows.append((i, rng.choice([" ", "\n"]).join(parts)))
    rows += [(60, rows[3][1]), (61, rows[3][1]), (62, None), (63, ""), (64, (sentence(rng, 30) + " " + sentence(rng, 30) + " ") * 2), (None, shared[0])]
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, n_removed int")
    got = {(r.doc_id): r for r in dedup_spans(docs).collect()}
    want = brute(rows)
    assert len(got) == len(rows)
    for i, (doc, _) in enumerate(rows):
        assert got[doc].text == want[i], doc
    assert got[60].text == "" and got[61].text == "" and got[3].text
    assert got[None].text == shared[0]
    assert shared[1] not in " ".join(got[i].text for i in range(60) if i != min(j for j in range(60) if j % 3 == 0 and j % 4 == 1))
    assert got[7].text.endswith(endless) and len(got[8].text) < len(rows[8][1]) - 500


def test_fifty_shared_words_share_a_span():
    """A passage without an end, in the midst of different sentences."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randrange(1, 8)))
    for i in range(400):
        k = rng.choice([2, 300])  # few different words too
        few = [word() for _ in range(k)]
        passage = rng.choices(few, k=50) if i % 2 else [rng.choice("abcdefghi") for _ in range(50)]
        one, two = ([" ".join([word() for _ in range(rng.randrange(1, 30))] + passage + [word() for _ in range(rng.randrange(1, 30))]) + "." for _ in range(2)])
        hashes = [{h for h, _, _ in spans(*sentences(t), 2, 16, 3)} for t in (one, two)]
        assert hashes[0] & hashes[1], (one, two)
        assert len(cleaned(two, hashes[0], 2, 16, 3)[0]) < len(two)


def test_runs_of_short_sentences():
    """Three whole sentences are a span whatever their length; two short ones are not."""
    assert cleaned("Yes. No. Yes. No. Yes. No.", set(), 2, 16, 3) == ("Yes. No. ", 6, 4)
    assert cleaned("Yes. No. Well. Yes. No.", set(), 2, 16, 3)[2] == 0


def test_sentences_by_hand(spark):
    """Against pieces cut independently, with nulls, repeated rows, clashing names and a very long text."""
    rng = random.Random(12)
    notes = [" ".join(sentence(rng, rng.randrange(1, 5)) for _ in range(4)) for _ in range(3)]
    rows = [(i, " ".join([sentence(rng) for _ in range(5)] + [notes[i % 3]] + [sentence(rng) for _ in range(3)])) for i in range(30)]
    rows += [(90, " ".join(sentence(rng) for _ in range(3000)) + " " + notes[0]), (91, None), (92, ""), (93, " \n "), (None, notes[2]), (None, "Only here. Not there.")]
    docs = spark.createDataFrame([(*r, "x", 1, [2]) for r in rows], "doc_id long, text string, row_key string, doc int, hashes_a array<int>")
    got = dedup_spans(docs)
    assert got.columns == ["n_sentences", "n_removed", *docs.columns]
    want = brute(rows, lambda t: (brute_pieces(t), [True] * len(brute_pieces(t))))
    assert sorted((str(r.doc_id), str(r.text)) for r in got.collect()) == sorted((str(d), str(want[i])) for i, (d, _) in enumerate(rows))
    twice = dedup_spans(spark.createDataFrame([(1, rows[0][1]), (1, rows[0][1])], "doc_id long, text string")).collect()
    assert [r.n_removed for r in twice] == [0, 0]


def test_empty(spark):
    assert dedup_spans(spark.createDataFrame([], "doc_id long, text string")).count() == 0
