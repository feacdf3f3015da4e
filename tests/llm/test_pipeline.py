"""The pipeline against what each stage alone must do to its own input."""

import corpus_pipeline
from pyspark.sql import functions as F
from test_decontaminate import words
from test_pii import plain
from test_simhash import brute_components, brute_print

from driftloom.llm import bpe


def windows(text, n):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()


def contaminated(text, items):
    wanted = {}
    for t in items:
        n = min(10, len(words(t)))
        if n:
            wanted.setdefault(n, set()).update(windows(t, n))
    return any(windows(text, n) & found for n, found in wanted.items())


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    start = {r.doc_id: r.text for r in docs.collect()}
    seen = []
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if len(seen) < 4:
            assert out.columns == docs.columns
        rows = out.collect()
        docs = spark.createDataFrame(rows, out.schema)
        seen.append({r.doc_id: r for r in rows})
    rules, near, clean, private, tokens = seen
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    dropped = start.keys() - rules.keys()
    assert all(labels.get(i, 0) == 0 or len((start[i] or "").split()) < 10 for i in dropped)
    comp = brute_components(list(rules), [brute_print(rules[i].text) for i in rules])
    assert set(near) == set(comp.values())
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert set(clean) == {i for i in near if not contaminated(near[i].text, items)}
    assert set(private) == set(clean) == set(tokens)
    for i, r in private.items():
        found = plain(clean[i].text or "")
        assert (r.text != clean[i].text) >= any(found.values())
        assert not any(plain(r.text or "").values())
    path = bpe.tokenizer_path()
    codec = bpe.ByteBpe(path)
    assert all(r.round_trip and codec.decode(r.ids) == (r.text or "") and r.n_tokens == len(r.ids) for r in tokens.values())


def test_nulls_empties_repeats_and_clashing_columns(spark, sf):
    rows = [(1, None, "x"), (2, "", "x"), (3, "just a few words", "x"), (4, "w " * 30, "x")]
    rows += [(k, f"alpha beta gamma delta epsilon zeta eta theta iota kappa number {k // 2}", "x") for k in range(10, 16)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").withColumns({"kept": F.lit(1), "root": F.lit("r"), "pii": F.lit(2)})
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert sorted(r.doc_id for r in docs.collect()) == [10, 12, 14]
    empty = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, sf)
    assert empty.count() == 0


def test_run_is_the_stages(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0
