"""Decontamination against a plain search of every window."""

import hashlib
import random
import re

import numpy as np
import pytest

from driftloom.llm import decontaminate as D
from driftloom.llm.shared import Scratch

PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return PATTERN.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items, window=10):
    w, hit, found = words(text), set(), set()
    for name, item in items:
        iw = words(item)
        n = min(window, len(iw))
        for i in range(len(iw) - n + 1 if n else 0):
            for j in range(len(w) - n + 1):
                if w[j : j + n] == iw[i : i + n]:
                    hit |= {*range(j, j + n)}
                    found.add(name)
    return len(w), len(hit), len(found - {None}), ",".join(sorted(x for x in found if x is not None))


def check(docs, benchmark, got):
    items = [(None if r.item_id is None else str(r.item_id), r.text) for r in benchmark.collect()]
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    assert len(got) == len(texts)
    want = sorted((i, *brute(t, items)) for i, t in texts)
    assert sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.names) for r in got) == want


def result(docs, benchmark, spark):
    from pyspark.sql import functions as F

    found = D.with_hits(docs, benchmark, Scratch(spark, "t")).withColumn("n_hit", D.n_hit())
    return found.select("doc_id", "n_words", "n_hit", F.size("hit_items").alias("n_items"), F.array_join("hit_items", ",").alias("names")).collect()


def planted(spark):
    rng = random.Random(4)
    vocab = ["a", "B", "c1", "é", "word", "x"]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(rng.choice([0, 1, 4, 12, 15])))) for k in range(12)] + [(3, None), (None, "lone item")]
    docs = []
    for k in range(40):
        parts = [" ".join(rng.choice(vocab + ["q", "r", "s"]) for _ in range(rng.randrange(30)))]
        if k % 3 == 0:
            parts.append(rng.choice(items)[1] or "")
        docs.append((k, "; ".join(parts).upper() if k % 2 else "\n".join(parts), k))
    docs += [(50, None, 0), (51, "", 0), (52, "lone, item.", 0), (52, "lone, item.", 0)]
    return spark.createDataFrame(docs, "doc_id long, text string, n_words int"), spark.createDataFrame(items, "item_id long, text string")


def test_planted_windows(spark):
    docs, bench = planted(spark)
    check(docs, bench, result(docs, bench, spark))


def test_small_blocks_shards_and_slabs_change_nothing(spark, monkeypatch):
    docs, bench = planted(spark)
    want = sorted(result(docs, bench, spark))
    monkeypatch.setattr(D, "BLOCK_WORDS", 20)
    assert sorted(result(docs, bench, spark)) == want


def test_documents_of_the_smallest_table(spark, sf):
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet").limit(60), spark.read.parquet(f"{sf}/benchmark.parquet").limit(8)
    docs = spark.createDataFrame(docs.select("doc_id", "text").collect(), "doc_id long, text string")
    check(docs, bench, result(docs, bench, spark))
    got = {r.doc_id: r for r in D.op6_decontaminate(spark, sf).collect()}
    assert any(r.contaminated for r in got.values()) and not all(r.contaminated for r in got.values())
    empty = hashlib.sha256(b"").hexdigest()
    assert all((r.items_sha256 == empty) == (r.n_items == 0) for r in got.values())


def test_empty_tables_and_removal(spark):
    docs, bench = planted(spark)
    assert all(r.n_hit == 0 for r in result(docs, bench.limit(0), spark))
    assert result(docs.limit(0), bench, spark) == []
    kept = D.remove_contaminated(docs, bench, Scratch(spark, "t"))
    assert kept.columns == docs.columns
    items = [(str(r.item_id), r.text) for r in bench.collect()]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in docs.collect() if not brute(r.text, items)[1])


@pytest.mark.parametrize("n", [0, 1, 2, 50, 400])
def test_suffix_array_and_longest_matches(n):
    rng = np.random.default_rng(n)
    w = rng.integers(1, 4, n).astype(np.uint64)
    order = D.suffix_array(w, 16)
    assert [w[i : i + 16].tolist() for i in order] == sorted(w[i : i + 16].tolist() for i in range(n))
    tests = rng.integers(1, 4, (30, 8)).astype(np.uint64)
    lengths = rng.integers(1, 9, 30)
    best, place = D.match_lengths(w, order, tests, lengths)
    for row, length, b, p in zip(tests.tolist(), lengths, best, place):
        want = max([next((k for k in range(length) if i + k >= n or w[i + k] != row[k]), length) for i in range(n)], default=0)
        assert b == want
        assert b == 0 or w[p : p + b].tolist() == row[:b]


def test_cutting_in_slabs(monkeypatch):
    text = ("Some wörds, and a very" + "long" * 30 + " one. ") * 20
    whole = D.words_of(text.encode())
    monkeypatch.setattr(D, "SLAB_BYTES", 50)
    for a, b in zip(D.words_of(text.encode()), whole):
        assert np.array_equal(a, b)
    assert [whole[0][a:b].tobytes().decode() for a, b in zip(whole[1], whole[2])] == words(text)


def longest_brute(docs, items, window=10):
    """{(item, start): length} of test suffixes that hold a window, without those that go on from one before."""
    texts = [words(t) for _, t in docs]
    out = {}
    for name, item in items:
        iw = words(item)
        need = min(window, len(iw))
        for i in range(len(iw)):
            best = 0
            for w in texts:
                for j in range(len(w)):
                    n = 0
                    while i + n < len(iw) and j + n < len(w) and w[j + n] == iw[i + n]:
                        n += 1
                    best = max(best, n)
            if need and best >= need:
                out[name, i] = max(best, out.get((name, i), 0))
    return out


@pytest.mark.parametrize("block", [150_000, 25])
def test_longest_match_and_place_of_each_test_suffix(spark, monkeypatch, block):
    monkeypatch.setattr(D, "BLOCK_WORDS", block)
    rng = random.Random(6)
    vocab = [f"w{k}" for k in range(40)]
    items = [(k, " ".join(rng.choices(vocab, k=rng.choice([3, 14, 22])))) for k in range(8)]
    docs = []
    for k in range(30):
        own = " ".join(rng.choices(vocab, k=25))
        if k % 3 == 0:
            w = rng.choice(items)[1].split()
            at = rng.randrange(len(w))
            own += " " + " ".join(w[at : at + rng.randrange(1, 22)]) + " " + " ".join(rng.choices(vocab, k=5))
        docs.append((k, own))
    found = D.with_hits(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), Scratch(spark, "t"))
    got = {(int(r.item), r.start): r for r in D.longest_matches(found).collect()}
    want = longest_brute(docs, items)
    texts, tests = {k: words(t) for k, t in docs}, {k: words(t) for k, t in items}
    for (item, start), r in got.items():
        assert texts[r.doc_id][r.first : r.first + r.length] == tests[item][start : start + r.length]
        if block > 25:
            assert r.length == want[item, start]
    if block > 25:
        heads = {k for k in want if want.get((k[0], k[1] - 1)) != want[k] + 1}
        assert heads and heads <= got.keys() <= want.keys()
    else:
        assert got


def test_whole_query_against_brute_force(spark):
    """Each document of a table against every window of every item, by a plain set of windows."""
    sf = "/root/testdata/sf0.01"
    items = [(str(r.item_id), words(r.text)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    table = {}
    for name, w in items:
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            table.setdefault(n, {}).setdefault(tuple(w[i : i + n]), set()).add(name)
    rows = {r.doc_id: r for r in D.op6_decontaminate(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(docs)
    for d in docs:
        w, hit, names = words(d.text), set(), set()
        for n, wanted in table.items():
            for j in range(len(w) - n + 1):
                if tuple(w[j : j + n]) in wanted:
                    hit |= {*range(j, j + n)}
                    names |= wanted[tuple(w[j : j + n])]
        r = rows[d.doc_id]
        told = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (len(w), len(hit), len(names), told, bool(hit))


def test_clashing_columns_stay(spark):
    docs, bench = planted(spark)
    docs = docs.selectExpr("doc_id", "text", "1 as _row", "2 as hits", "3 as now", "4 as matches", "5 as row")
    kept = D.remove_contaminated(docs, bench, Scratch(spark, "t"))
    assert kept.columns == docs.columns and {tuple(r)[2:] for r in kept.collect()} == {(1, 2, 3, 4, 5)}


def test_a_match_across_a_cut_is_one(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_WORDS", 30)
    item = [f"u{k}" for k in range(100)]
    docs = [(1, " ".join(["x", *item[5:95], "y"])), (2, " ".join(item[40:60])), (3, "nothing here"), (3, None)]
    found = D.with_hits(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, " ".join(item))], "item_id long, text string"), Scratch(spark, "t"))
    rows = {(r.item, r.start): (r.length, r.doc_id, r.first) for r in D.longest_matches(found).collect()}
    assert rows[("7", 5)] == (90, 1, 1)
    assert sorted((r.doc_id, r.n_words, r.n_hit) for r in found.withColumn("n_hit", D.n_hit()).collect()) == [(1, 92, 90), (2, 20, 20), (3, 0, 0), (3, 2, 0)]
