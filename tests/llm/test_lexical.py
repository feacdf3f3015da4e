import math
import random
import re
from collections import Counter

import numpy as np

from driftloom.llm import lexical
from driftloom.llm.shared import Scratch, table

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, top=lexical.TOP):
    bags = [(i, terms(t)) for i, t in docs]
    bags = [(i, Counter(t), len(t)) for i, t in bags if t]
    n, total, df = len(bags), sum(b[2] for b in bags), Counter()
    for _, bag, _ in bags:
        df.update(bag.keys())
    asked = {}
    for i, text in items:
        asked.setdefault(i, set()).update(terms(text))
    out = []
    for i, own in asked.items():
        found = []
        for d, bag, size in bags:
            m = 100 - 50 + (50 * size * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * bag[t]) // (1000 * bag[t] + 20 * m)) for t in own if bag[t])
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        out += [(i, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(found)[:top], 1)]
    return out


def run(spark, docs, items, **more):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id string, text string")
    return [tuple(r) for r in lexical.ranked(d.repartition(3), i, Scratch(spark, "t"), **more).collect()]


def key(rows):
    return sorted(rows, key=lambda r: (str(r[0]), r[1]))


def test_query_against_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    items = [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()]
    got = [tuple(r) for r in lexical.op12_lexical(spark, sf).collect()]
    assert key(got) == key(brute(docs, items))


def test_many_terms_need_several_words_of_bits(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(150)]
    docs = [(k, " ".join(rng.choices(words, k=rng.randint(0, 60)))) for k in range(300)]
    items = [("a", " ".join(words)), ("b", " ".join(words[:70])), ("c", " ".join(words[:3]))]
    assert key(run(spark, docs, items)) == key(brute(docs, items))


def test_blocks_give_what_one_block_gives(spark, monkeypatch):
    docs = [(k, f"one two{k % 3} three{k % 5} four") for k in range(90)]
    items = [(f"i{k}", f"one two{k % 3} three{k}") for k in range(9)]
    monkeypatch.setattr(lexical, "BLOCK_TERMS", 6)
    assert key(run(spark, docs, items)) == key(brute(docs, items))


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, "--- !"), (None, "Éa b"), (4, "ÉA b"), (4, "éa b B"), (5, "b_b b9 ß"), (6, "b"), (6, "b")]
    items = [("x", "É b"), ("x", "b9"), (None, "éa"), ("y", None), ("z", "..."), ("w", "absent")]
    assert key(run(spark, docs, items)) == key(brute(docs, items))
    assert run(spark, [], items) == [] and run(spark, docs, []) == []


def test_masks_and_groups_are_skipped_safely():
    rng = np.random.default_rng(1)
    items = lexical.Items.of([("q", [b"rare", b"common", b"other"])])
    n = 4000
    items.weigh(n, n * 100, {items.vocabulary[b"rare"]: 60, items.vocabulary[b"common"]: n - 5, items.vocabulary[b"other"]: n // 2})
    has = {b"rare": rng.choice(n, 60, replace=False), b"common": np.arange(5, n), b"other": rng.choice(n, n // 2, replace=False)}
    posts = np.concatenate([np.array([np.sort(d), np.full(len(d), items.vocabulary[t]), rng.integers(1, 4, len(d))]) for t, d in has.items()], axis=1)
    owner, term, tf = posts[:, np.lexsort((posts[0], posts[1]))]
    lengths, best = rng.integers(20, 200, n), [lexical.Best(50)]
    scored = lexical.search_batch(items, list(range(n)), lengths, owner, term, tf, best)
    m = 50 + (50 * lengths * n) // (n * 100)
    score = np.zeros(n, np.int64)
    w = {t: int(x) for t, x in zip(items.terms[0], items.weights[0])}
    np.add.at(score, owner, [w[t] * ((1000000000 * f) // (1000 * f + 20 * int(m[o]))) for o, t, f in zip(owner.tolist(), term.tolist(), tf.tolist())])
    want = sorted(((-s, i) for i, s in enumerate(score.tolist()) if s > 0))[:50]
    assert [(-s, i) for s, i in best[0].rows] == want and scored < n // 10


def test_long_texts_are_cut_between_terms(monkeypatch):
    monkeypatch.setattr(lexical, "PIECE", 7)
    raw = ("ab cde " * 20 + "x" * 40 + " end").encode()
    assert [t for part in lexical.terms_of(raw) for t in part] == [t.encode() for t in terms(raw.decode())]
