"""Language identification by held-out accuracy, and the cases without letters."""

import zlib

import numpy as np
import regex
from pyspark.sql import functions as F

from driftloom.llm import langid as L


def test_held_out_accuracy_and_calibration(spark):
    got = L.op1_langid(spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = got.join(docs, "doc_id").filter("held_out").collect()
    assert len(rows) > 200
    assert sum(r.lang_pred == r.lang for r in rows) / len(rows) > 0.97
    kept = [r for r in rows if not r.rejected]
    assert sum(r.lang_pred == r.lang for r in kept) / len(kept) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_nulls_empties_and_clashing_columns(spark):
    model = L.train([("the cat and the dog", "en")] * 30 + [("der hund und die katze", "de")] * 30)
    rows = [(1, None, "x"), (2, "", "x"), (3, "12 34 !", "x"), (4, "the dog", "x"), (4, "the dog", "x"), (5, "und " * 400_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = L.with_language(docs, model).collect()
    assert [r.lang_pred for r in got] == ["und", "und", "und", "en", "en", "de"]
    assert [r.score for r in got[:3]] == [0.0, 0.0, 0.0]
    assert L.with_language(docs.limit(0), model).count() == 0


def test_nothing_learned_and_order_of_rows(spark):
    docs = spark.createDataFrame([(1, "word", None)], "doc_id long, text string, lang string")
    assert L.training_rows(docs) == []
    assert L.with_language(docs, L.train([])).first().lang_pred == "und"
    rows = [("the cat and the dog", "en"), ("der hund und die katze", "de"), ("le chat et le chien", "fr")] * 20
    a, b = L.train(rows), L.train(rows[::-1])
    assert (a.scores == b.scores).all() and a.temperature == b.temperature


def test_only_the_text_decides(spark):
    model = L.train([("the cat and the dog", "en")] * 30 + [("der hund und die katze", "de")] * 30)
    docs = spark.createDataFrame([(1, "the dog", "de")], "doc_id long, text string, lang string")
    assert L.with_language(docs, model).select(F.col("lang_pred")).first()[0] == "en"


def test_numerals_are_no_letters(spark):
    model = L.train([("the cat and the dog", "en")] * 30 + [("der hund und die katze", "de")] * 30)
    texts = ["½ 12", "²", "①②", "Ⅷ", "_ 7", "½a", "一"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("_lang", F.lit("kept")).withColumn("lang", F.lit("own"))
    got = L.with_language(docs, model)
    assert [(r.lang_pred, r.score) for r in got.collect()[:5]] == [("und", 0.0)] * 5
    assert all(r.lang_pred != "und" for r in got.collect()[5:])
    assert got.columns == ["doc_id", "text", "_lang", "lang", "lang_pred", "score", "rejected"]


def test_query_against_a_plain_forward_pass(spark, sf):
    """The query's labels and scores from the model's arrays, subword by subword."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    model = L.train(L.training_rows(docs.filter("crc32(cast(doc_id as string)) % 3 <> 1")))
    for r in L.op1_langid(spark, sf).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        words = regex.findall(r"\p{L}+", texts[r.doc_id].lower())
        slots = [s for w in words for s in L.slots_of(w)]
        if not slots:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        z = (np.mean([model.scores[s] for s in slots], axis=0) + model.bias) / model.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert r.lang_pred == model.labels[int(p.argmax())] and abs(r.score - p.max()) < 1e-9
