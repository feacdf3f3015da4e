"""Near-duplicates against brute force over all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash

from driftloom.llm import simhash as S
from driftloom.llm.shared import Scratch


def brute_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(ids, prints):
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    least = {}
    for i, x in enumerate(ids):
        r = find(i)
        least[r] = min(least.get(r, x), x)
    return {x: least[find(i)] for i, x in enumerate(ids)}


def test_documents_against_all_pairs(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    prints = [brute_print(r.text) for r in rows]
    want = brute_components([r.doc_id for r in rows], prints)
    got = S.op4_simhash(spark, sf).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.fingerprint for r in got} == {r.doc_id: f"{p:016x}" for r, p in zip(rows, prints)}
    assert {r.doc_id: r.component_id for r in got} == want


def test_long_and_odd_texts():
    rng = random.Random(2)
    long = " ".join(rng.choice("abcdefgh") * rng.randrange(1, 5) for _ in range(70_000))
    for t in ["", " \t", "One", "one TWO", "É é É", "a b c", "x" * 10000, long]:
        assert S.fingerprint(t.encode()) == brute_print(t)


def _clustered(n, rng):
    centres = [rng.getrandbits(64) for _ in range(max(2, n // 60))]
    out = set()
    for _ in range(n):
        x = rng.choice(centres)
        for _ in range(rng.randrange(6)):
            x ^= 1 << rng.randrange(64)
        out.add(x)
    return np.array(sorted(out), np.uint64)


def _gray(codes):
    r = codes.copy()
    for k in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(k)
    return codes[np.argsort(r)]


@pytest.mark.parametrize("n", [1, 2, 17, 300, 1500])
def test_tree_finds_every_component(n):
    codes = _gray(_clustered(n, random.Random(n)))
    label = S.tree_labels(codes)
    want = brute_components(list(range(len(codes))), [int(c) for c in codes])
    assert {i: int(x) for i, x in enumerate(label)} == want


def test_links_connect_what_all_pairs_connect(spark):
    codes = _clustered(1200, random.Random(5))
    df = spark.createDataFrame([(int(c),) for c in codes.view(np.int64)], "fp long")
    docs = df.selectExpr("fp as doc_id", "fp")
    got = {r.fp: r.component_id for r in S.near_duplicate_classes(docs, Scratch(spark, "t")).collect()}
    signed = [int(c) for c in codes.view(np.int64)]
    want = brute_components(signed, [int(c) for c in codes])
    assert got == want


def test_nulls_repeats_clashes_and_keep_one(spark):
    a = "the quick brown fox jumps over the lazy dog and runs away from here"
    rows = [(5, a, 1), (3, a, 2), (3, a, 3), (9, None, 4), (8, "", 5), (None, " ", 6), (None, "only here as a null id", 7), (None, "only here as a null id", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, root int")
    got = S.near_duplicates(docs, Scratch(spark, "t")).collect()
    assert len(got) == len(rows)
    assert {r.component_id for r in got if r.doc_id in (3, 5)} == {3}
    assert {r.component_id for r in got if r.doc_id in (8, 9)} == {8}
    kept = S.keep_one(docs, Scratch(spark, "t"))
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 3, 8]
    assert S.near_duplicates(docs.limit(0), Scratch(spark, "t")).count() == 0


def test_hot_upper_nodes_are_divided(spark, monkeypatch):
    monkeypatch.setattr(S, "HOT_NODE", 2)
    codes = _clustered(900, random.Random(9))
    df = spark.createDataFrame([(int(c),) for c in codes.view(np.int64)], "fp long")
    assert S._upper_nodes(df, Scratch(spark, "t")).count() > 6 * len(codes)
    docs = df.selectExpr("fp as doc_id", "fp")
    got = {r.fp: r.component_id for r in S.near_duplicate_classes(docs, Scratch(spark, "t")).collect()}
    signed = [int(c) for c in codes.view(np.int64)]
    assert got == brute_components(signed, [int(c) for c in codes])


def test_every_fingerprint_is_searched_in_the_hierarchy(spark, sf, monkeypatch):
    """All upper nodes of a table are in one hierarchy, and links of the table come out of its search."""
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()
    prints = [brute_print(r.text) for r in rows]
    # Near fingerprints beside the table's own, as the smallest table has equal ones only.
    codes = np.unique(np.array(prints + [p ^ 1 << k for k, p in enumerate(prints[:60])] + [p ^ 5 << k for k, p in enumerate(prints[20:50])], np.uint64))
    searched, found, near = [], [], S.GrayForest.near

    def watched(self, queries, roots, label, limit):
        if (pair := near(self, queries, roots, label, limit)) is None:
            return None
        q, entry = pair
        searched.append(len(queries))
        found.extend(zip(self.codes[q].tolist(), self.codes[entry].tolist()))
        return q, entry

    monkeypatch.setattr(S.GrayForest, "near", watched)
    df = spark.createDataFrame([(int(c),) for c in codes.view(np.int64)], "fp long")
    shard = S._upper_nodes(df, Scratch(spark, "t")).repartition(1).sortWithinPartitions("node", S.gray_rank(df.fp)).toArrow()
    list(S._links_of(2, iter(shard.to_batches())))
    assert sum(searched) == 6 * len(codes)
    linked = {(a, b) for k, a in enumerate(codes.tolist()) for b in codes.tolist()[:k] if (a ^ b).bit_count() <= 2}
    assert linked and {(max(p), min(p)) for p in found} <= linked
    assert brute_components(codes.tolist(), codes.tolist()) == {int(c): min(n for n in _reach(int(c), found)) for c in codes}


def _reach(start, pairs):
    seen, todo = {start}, [start]
    while todo:
        x = todo.pop()
        for a, b in pairs:
            for u, v in ((a, b), (b, a)):
                if u == x and v not in seen:
                    seen.add(v)
                    todo.append(v)
    return seen


def test_clashing_column_names_stay(spark):
    rows = [(1, "one two three four five", 7, "p", 3, 1), (2, "one two three four five", 8, "q", 4, 2), (2, "six seven eight nine", 9, "r", 5, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id int, _fp string, fp int, _kept int")
    kept = S.keep_one(docs, Scratch(spark, "t"))
    assert kept.columns == docs.columns
    assert sorted(tuple(r) for r in kept.collect()) == [rows[0], rows[2]]


@pytest.mark.parametrize("most", [1, 50])
def test_small_blocks_change_nothing(monkeypatch, most):
    codes = _gray(_clustered(600, random.Random(3)))
    want = S.tree_labels(codes)
    monkeypatch.setattr(S, "MOST_VISITS", most)
    assert np.array_equal(S.tree_labels(codes), want)
