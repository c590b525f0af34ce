"""Token counts against the library, whole and in chunks."""

import random

import pytest

from grainspan.llm import tokens

from .helpers import awkward, docs


@pytest.fixture(scope="module")
def library():
    return tokens.load(tokens.default_path())


def direct(library, text):
    return len(library.encode(text or "", add_special_tokens=False).ids)


ALPHABETS = ["ab c", "abcé ñ\n\t ", "a", "ab<|endoftext|> ", "aΣσ 's't d", "é a1 2", "日本語 です ", " ", "'re 've."]


@pytest.mark.parametrize("seed", range(80))
def test_chunks_change_nothing(library, seed):
    rng = random.Random(seed)
    alphabet = ALPHABETS[seed % len(ALPHABETS)]
    text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 3000)))
    if seed % 3 == 0:
        text = text.replace("b", "<|startoftext|>")
    encode = tokens.encoder(tokens.default_path())
    assert tokens.count_long(text, encode, rng.choice([50, 200, 400]), rng.choice([4, 16, 40])) == direct(library, text)


def test_one_long_word(library):
    text = "abc" * 5000
    assert tokens.count_long(text, tokens.encoder(tokens.default_path()), 1000, 50) == direct(library, text)


def test_table(spark, library):
    rows = awkward() + [(9, "Special <|endoftext|> inside"), (10, "word " * 30000)]
    out = tokens.counts(docs(spark, rows), chunk=5000)
    want = sorted(((i, len((t or "").encode()), direct(library, t)) for i, t in rows), key=repr)
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in out.collect()), key=repr) == want
    assert tokens.counts(docs(spark, [])).count() == 0


@pytest.mark.parametrize("seed", range(60))
def test_pieces_are_the_text(library, seed):
    """Counts of pieces add up to the library's own, with marks that combine, other white space and special strings."""
    assert tokens.independent_pieces(tokens.default_path())
    rng = random.Random(seed)
    alphabet = [*ALPHABETS, "e\u0301 \u0308a", "a\u00a0b\u2003c\x1cd \x85", "\u1100\u1161 \u11a8", "İ Σ Σ a", "| <|endoftext|>< "][seed % 14]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 400))) for _ in range(5)]
    if seed % 3 == 0:
        texts = [t.replace("a", "<|endoftext|>") for t in texts]
    assert tokens.PieceCounts(library).of([t.encode() for t in texts]) == [direct(library, t) for t in texts]


def test_few_kept_pieces_change_nothing(library, monkeypatch):
    monkeypatch.setattr(tokens, "PIECES", 7)
    monkeypatch.setattr(tokens, "PIECE_BYTES", 3)
    rng = random.Random(5)
    texts = [" ".join("".join(rng.choice("abcxyz.'s") for _ in range(rng.randint(1, 6))) for _ in range(50)) for _ in range(20)]
    counts = tokens.PieceCounts(library)
    assert counts.of([t.encode() for t in texts]) == [direct(library, t) for t in texts]
    assert len(counts.known) <= 50 + 7 and all(len(p) <= 3 for p in counts.known)


def test_other_tokenizers_encode_whole_texts(spark):
    path = tokens.default_path("byte_bpe_50k.json")
    assert not tokens.independent_pieces(path)
    rows = awkward()
    other = tokens.load(path)
    out = {(r.doc_id, r.n_tokens) for r in tokens.counts(docs(spark, rows), path).collect()}
    assert out == {(i, direct(other, t)) for i, t in rows}


def test_further_columns_with_names_of_the_result(spark, library):
    frame = docs(spark, awkward()).withColumnRenamed("lang", "n_tokens").withColumnRenamed("source", "n_bytes")
    assert {(r.doc_id, r.n_tokens) for r in tokens.counts(frame).collect()} == {(i, direct(library, t)) for i, t in awkward()}
