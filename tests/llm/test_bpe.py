"""BPE against the tokenizers library, text by text."""

import hashlib
import random

import numpy as np
import pytest

from driftloom.llm import bpe


@pytest.fixture(scope="module")
def both():
    from tokenizers import Tokenizer

    path = bpe.tokenizer_path()
    return bpe.ByteBpe(path), Tokenizer.from_file(path)


def _texts():
    rng = random.Random(7)
    fixed = ["", " ", "a", "<|endoftext|>", "x<|endoftext|><|endoftext|> y", "it's we'll don't", " \n\n\t x  ", "\x1c\x1d a"]
    fixed += ["日本語テキスト１２３", "é é", "a" * 3000, "ab" * 2000 + " " * 50, "🏳️‍🌈👩‍👩‍👧"]
    ranges = [(32, 127), (9, 14), (128, 0x250), (0x250, 0x3000), (0x10000, 0x1F700)]
    for _ in range(400):
        fixed.append("".join(chr(rng.randrange(*rng.choice(ranges))) for _ in range(rng.randrange(40))))
        fixed.append("".join(chr(rng.randrange(0x250)) for _ in range(rng.randrange(40))))
    return fixed


def test_same_ids_and_text_as_the_library(both):
    ours, library = both
    for text in _texts():
        want = library.encode(text, add_special_tokens=False).ids
        assert ours.encode(text).tolist() == want, repr(text)
        assert ours.decode(want) == library.decode(want, skip_special_tokens=False), repr(text)


def test_decoding_broken_sequences(both):
    ours, library = both
    rng = random.Random(3)
    for _ in range(300):
        ids = [rng.randrange(50257) for _ in range(rng.randrange(12))]
        assert ours.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_full_cache_changes_nothing(both, monkeypatch):
    ours, library = both
    monkeypatch.setattr(bpe, "CACHE_PIECES", 3)
    ours.clear()
    text = "one two three four one two three four"
    assert ours.encode(text).tolist() == library.encode(text).ids


def test_digests_with_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, "a b", "x"), (1, "a b", "x"), (2, None, None), (None, "", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = bpe.digests(docs, bpe.tokenizer_path()).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert len(got) == 4
    by_id = {r.doc_id: r for r in got}
    assert by_id[1].n_tokens == 2 and by_id[1].decoded_sha256 == hashlib.sha256(b"a b").hexdigest()
    for key in (2, None):
        assert (by_id[key].n_tokens, by_id[key].ids_sha256, by_id[key].decoded_sha256) == (0, empty, empty)
    assert bpe.digests(docs.limit(0), bpe.tokenizer_path()).count() == 0


@pytest.mark.parametrize("most", [1, 7, 300])
def test_every_piece_goes_through_a_tree(both, monkeypatch, sf, most):
    """Ids of whole documents are those of the library, and each piece of two symbols asks a root."""
    import pyarrow.parquet as pq

    texts = [t or "" for t in pq.read_table(f"{sf}/documents.parquet").column("text").to_pylist()][:60] + _texts()[:80]
    split = lambda flat, sizes: [tuple(x.tolist()) for x in np.split(flat, np.cumsum(sizes)[:-1])]
    asked = set()
    many, one = bpe.merge_many, bpe.merge_pairs
    monkeypatch.setattr(bpe, "merge_many", lambda flat, sizes, pairs: asked.update(split(flat, sizes)) or many(flat, sizes, pairs))
    monkeypatch.setattr(bpe, "merge_pairs", lambda ids, *a: asked.add(tuple(ids)) or one(ids, *a))
    monkeypatch.setattr(bpe, "MANY", most)
    monkeypatch.setattr(bpe, "CHUNK_PIECES", 50 * most)
    ours, library = bpe.ByteBpe(bpe.tokenizer_path()), both[1]
    got = ours.encode_all(texts)
    assert [x.tolist() for x in got] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    pieces = {p for t in texts for run in ours._pieces(t) for p in run if isinstance(p, str)}
    wanted = {tuple(ours.byte_ids[b] for b in p.encode()) for p in pieces if len(p.encode()) > 1}
    assert wanted and wanted <= asked


def test_trees_agree_with_a_plain_scan(both):
    ours, rng = both[0], random.Random(11)
    rows = [[rng.choice(ours.byte_ids[97:105]) for _ in range(rng.randrange(2, 40))] for _ in range(300)]
    want = []
    for row in rows:
        row = row[:]
        while ranked := [(ours.pair_rank.get(a * ours.base + b), i) for i, (a, b) in enumerate(zip(row, row[1:])) if a * ours.base + b in ours.pair_rank]:
            rank, i = min(ranked)
            row[i : i + 2] = [ours.merged[rank]]
        want.append(row)
    flat, counts = bpe.merge_many(np.concatenate(rows), np.array([len(r) for r in rows]), ours.pairs)
    assert [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])] == want
    assert [bpe.merge_pairs(r[:], ours.pair_rank, ours.merged, ours.base) for r in rows] == want


def test_query_against_the_library(both, spark, sf):
    library = both[1]
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = bpe.op2_bpe(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        told = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        decoded = hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), told, decoded)
