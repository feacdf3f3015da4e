"""Suffix-array dedup against a plain table of all strings."""

import hashlib
import random

import numpy as np
import pytest

from driftloom.llm import suffix_dedup as S
from driftloom.llm.shared import Scratch


def brute(docs, length):
    seen, out = set(), []
    for key, text in sorted(docs):
        raw, hit = text.encode(), set()
        for i in range(len(raw) - length + 1):
            s = raw[i : i + length]
            if s in seen:
                hit |= {*range(i, i + length)}
            seen.add(s)
        kept = bytes(raw[i] for i in range(len(raw)) if i not in hit)
        spans = sum(i not in hit and i + 1 in hit for i in range(-1, len(raw)))
        out.append((key, len(raw), len(hit), spans, hashlib.sha256(kept).hexdigest()))
    return out


def result(df):
    return sorted((r.doc_id, len((r.text or "").encode()), r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in df.collect())


@pytest.mark.parametrize("n", [0, 1, 5, 8, 9, 10, 11, 50, 500])
@pytest.mark.parametrize("letters", [1, 2, 5, 200])
def test_suffix_sorting(n, letters):
    t = np.random.default_rng(n + letters).integers(1, letters + 1, n)
    assert S.sort_suffixes(t).tolist() == sorted(range(n), key=lambda i: t[i:].tolist())


def planted(seed, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randrange(3, 9)))
    passages = [" ".join(word() for _ in range(rng.randrange(15, 60))) for _ in range(6)]
    docs = []
    for k in range(n):
        parts = [" ".join(word() for _ in range(rng.randrange(40))) for _ in range(3)]
        for _ in range(rng.randrange(3)):
            parts.insert(rng.randrange(len(parts)), rng.choice(passages))
        docs.append((k, " ".join(parts)))
    docs += [(100 + k, docs[k][1]) for k in range(8)] + [(200, "ab" * 300), (201, "ab" * 90), (202, ""), (203, "x" * 99), (204, "x" * 100), (205, "x" * 350)]
    return docs


@pytest.mark.parametrize("most", [2_000, 12, 3, 1])
def test_planted_passages(spark, monkeypatch, most):
    monkeypatch.setattr(S, "MOST_REGIONS", most)
    docs = planted(most)
    got = S.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"), Scratch(spark, "t"))
    assert result(got) == brute(docs, S.LENGTH)


def test_slabs_hold_every_string_once(monkeypatch):
    monkeypatch.setattr(S, "SLAB_BYTES", 64)
    for n in (0, 50, 99, 100, 163, 164, 1000):
        starts = [i for a, b in S.slabs(n) for i in range(a, b - S.LENGTH + 1)]
        assert starts == list(range(max(0, n - S.LENGTH + 1)))


def test_documents(spark, sf):
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = brute(docs, S.LENGTH)
    got = sorted(tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in S.op8_suffix_dedup(spark, sf).collect())
    assert got == want


def test_nulls_repeats_and_empty_table(spark):
    long = "".join(random.Random(1).choices("abcdefgh", k=150))
    rows = [(1, None), (2, long), (2, long), (None, "q" * 90), (5, long)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_removed) for r in S.remove_repeats(docs, Scratch(spark, "t")).collect())
    assert got == [(0, 0), (1, 0), (2, 0), (2, 0), (5, 150)]
    assert S.remove_repeats(docs.limit(0), Scratch(spark, "t")).count() == 0
