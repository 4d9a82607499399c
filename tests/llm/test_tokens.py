import random
import sys
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from fathom.llm import huffman, packing, tokens
from fathom.llm.queries import op5_packing, op6_token_files, tokenizer

ODD = [
    "", " ", "  ", "\n", "a  b", "a \n b", " a", "a ", "don't stop'll x", "été  été x", "a　b c", "x<|endoftext|> y z", "tab\tx\r\ny", "\x1ca b\x1f c", "end.\nNew line\n\nTwo", "日本語 テキスト ",
    "é ́x", "ΣΑΣ ΣΑΣ.", "a\x7f b \x00c", "İ I ŉ", "1234 5.6 $%^", "﻿a b", "x" * 3000, "a b \u0085 c",
]


def random_texts(seed, n=80):
    r = random.Random(seed)
    bits = ["É", "×", "A", "B1", "--", " ", " ", " ", "\n", "the", "Ünï", "don't", ".", ",", "12", "word", "\t", " ", "s", "'s", "日", "😀", "<|endoftext|>"]
    return ["".join(r.choice(bits) for _ in range(r.choice([1, 5, 40, 300]))) for _ in range(n)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_same_ids_as_whole_texts(name):
    texts = ODD + random_texts(5)
    want = [x.ids for x in Tokenizer.from_file(tokenizer(name)).encode_batch(texts, add_special_tokens=False)]
    coder = tokens.Encoder(tokenizer(name))
    for _ in range(2):  # the second time from memory
        ids, first = coder.encode(pa.array(texts, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:])] == want


WIDE = "\u0085\u00a0\u1680\u2000\u2005\u200a\u2028\u2029\u202f\u205f\u3000"
NEAR_WIDE = "\u0084\u0086\u00a1\u1681\u167f\u200b\u2010\u2019\u2027\u202a\u205e\u2060\u2fff\u3001×÷Þß"


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_same_ids_around_wide_spaces_and_when_memory_is_full(name, monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 60)
    whole, coder = Tokenizer.from_file(tokenizer(name)), tokens.Encoder(tokenizer(name))
    blocks = [["", ""], [" \n\t ", " "], [x for c in WIDE + NEAR_WIDE for x in (c, f"Ab{c}cd", f"one two {c} three.", f"{c}x")], *[random_texts(seed, 6) for seed in range(8)], []]
    for texts in blocks:
        ids, first = coder.encode(pa.array(texts, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:])] == [x.ids for x in whole.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_steps_for_each_piece(name):
    """Pieces that are known take no step of Python's, new ones three."""
    n, coder = 5000, tokens.Encoder(tokenizer(name))
    column = pa.array([" ".join("".join(chr(97 + k // 26**j % 26) for j in range(4)) for k in range(n))])

    def calls():
        seen = []
        sys.setprofile(lambda frame, event, arg: seen.append(1) if event in ("call", "c_call") else None)
        try:
            coder.encode(column)
        finally:
            sys.setprofile(None)
        return len(seen)

    coder.encode(pa.array(["warm up"]))
    assert calls() < 3.5 * n
    assert calls() < n / 5


@pytest.fixture(scope="module")
def documents(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tokens")
    texts = ODD + random_texts(6) + [None, "long words " * 4000, "more " * 2047, "more " * 2048]
    docs = [(7 * i % 1009 - 50, t) for i, t in enumerate(texts)] + [(None, "x y"), (3, "same"), (3, "same"), (3, "other")]
    spark.createDataFrame([(*d, 1, "n") for d in docs], "doc_id long, text string, ids int, length string").repartition(4).write.parquet(str(path / "documents.parquet"))
    return str(path), docs


def test_packing(spark, documents):
    path, docs = documents
    coder = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    rows = op5_packing(spark, path).collect()
    want, got = [], sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=str)
    for doc_id, text in docs:
        ids = np.array([*coder.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        head = (len(ids) - 1) % 2048 + 1
        cuts = [0, *range(head, len(ids) + 1, 2048)]
        want += [(doc_id, k, a, b - a, zlib.crc32(ids[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert got == sorted(want, key=str)
    in_sequence = defaultdict(list)
    for r in rows:
        in_sequence[r.sequence_id].append((r.offset, r.length))
    for items in in_sequence.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(in_sequence) <= -(-sum(r.length for r in rows) // 2048) + 1


@pytest.mark.parametrize("seed", range(30))
def test_plan(seed):
    r = random.Random(seed)
    capacity = r.choice([1, 2, 3, 7, 50, 2048])
    lengths = [r.randint(1, max(1, capacity if r.random() < 0.5 else capacity // 4)) for _ in range(r.choice([0, 1, 5, 300]))]
    histogram = {n: lengths.count(n) for n in set(lengths)}
    rows, sequences = packing.plan(histogram, capacity)
    places, numbers = defaultdict(list), defaultdict(list)
    for length, low, count, first, offset, each in rows.tolist():
        for k in range(count):
            places[first + k // each].append((offset + k % each * length, length))
            numbers[length].append(low + k)
    assert {n: sorted(x) for n, x in numbers.items()} == {n: list(range(c)) for n, c in histogram.items()}
    assert set(places) == set(range(sequences))
    for items in places.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= capacity
    assert sequences <= 1.25 * -(-sum(lengths) // capacity) + 1 or max(lengths) > capacity // 3


def test_token_files(spark, documents):
    path, docs = documents
    coder = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    rows = sorted(op6_token_files(spark, path).collect(), key=lambda r: r.start)
    ids = {i: np.array([*coder.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for i, t in docs if i != 3}
    at, last = 0, -(10**9)
    for r in rows:
        assert r.start == at
        at += r.n_tokens
        if r.doc_id is not None:
            assert r.doc_id >= last
            last = r.doc_id
        if r.doc_id != 3:
            assert (r.n_tokens, r.ids_crc32) == (len(ids[r.doc_id]), zlib.crc32(ids[r.doc_id]))
    assert rows[-1].doc_id is None
    assert len(rows) == len(docs)


@pytest.mark.parametrize("seed", range(12))
def test_huffman_round_trip(seed):
    r = np.random.default_rng(seed)
    vocabulary = int(r.choice([1, 2, 3, 300, 5000]))
    ids = np.minimum(r.geometric(0.03, int(r.choice([1, 255, 256, 257, 20000]))) - 1, vocabulary - 1) if seed % 2 else r.integers(0, vocabulary, 3000)
    counts = np.bincount(ids, minlength=vocabulary)
    limit = max(1, int(np.ceil(np.log2(vocabulary))) + seed % 4)
    lengths = huffman.code_lengths(counts, limit)
    assert lengths.max() <= limit
    assert sum(2.0 ** -int(x) for x in lengths if x) <= 1
    content = huffman.file_bytes(np.array([5]), np.array([True]), np.array([len(ids)]), ids, lengths, huffman.canonical(lengths)[0])
    doc_ids, known, n, back = huffman.parse(content)
    assert (doc_ids.tolist(), known.tolist(), n.tolist()) == ([5], [True], [len(ids)])
    assert (back == ids).all()


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert op5_packing(spark, str(tmp_path)).count() == op6_token_files(spark, str(tmp_path)).count() == 0
