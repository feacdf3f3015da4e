"""Tokens against Python's re, in all languages."""

import re

from pyspark.sql import functions as F

from driftloom.functions import text
from driftloom.plans import catalog

TOKEN = re.compile(r"\w+|[^\w\s]")


def test_tokens_are_pythons(spark):
    texts = ["Élan, l’été à Genève!", "Straße — 3½ €", "n\u0303o e\u0301", "a\u200db\u203fc", "x\u00a0y\u3000z\u2028w", "a\x1cb\x85c", "Ⅷ ²³ ٣", "日本語。", "नमस्ते", "🙂🙂 _a_", ""]
    df = spark.createDataFrame([(k, t) for k, t in enumerate([*texts, None])], "k int, t string")
    got = {r.k: r.x for r in df.select("k", text.tokens(F.col("t")).alias("x")).collect()}
    assert [got[k] for k in range(len(got))] == [TOKEN.findall(t or "") for t in [*texts, None]]


def test_every_document_has_a_count(spark, sf):
    want = {r.doc_id: len(TOKEN.findall(r.text or "")) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r.doc_id: r.n_tokens for r in catalog.queries()["q56_all_token_counts"](spark, sf).collect()} == want
