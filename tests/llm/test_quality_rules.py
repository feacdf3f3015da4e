"""Quality statistics against plain Python; the learner on planted classes."""

import re
from collections import Counter

from pyspark.sql import functions as F

from driftloom.llm import quality_rules as Q
from driftloom.llm.shared import Scratch


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if count[w] > 1:
            covered |= {*range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


TEXTS = [None, "", " \n\t ", "a", "a b c d e", "a b c d e a b c d e", "x " * 40, "a\na\n\n a\na ", "é ö #$ <b>|", "w1 w2 w3 w4 w5 w6 w1 w2 w3 w4 w5 w7", "z" * 50000]


def test_statistics_of_odd_texts(spark):
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)] + [(3, "a", "clash")], "doc_id long, text string, words string")
    for r in Q.with_statistics(docs).collect():
        assert tuple(r[c] for c in Q.BASE) == brute(r.text), r.text
    assert Q.with_statistics(docs.limit(0)).count() == 0


def test_statistics_of_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for r in Q.with_statistics(docs).collect():
        assert tuple(r[c] for c in Q.BASE) == brute(r.text)


def test_learned_rules_separate_and_keep_good_rows(spark):
    rows = [(i, ("word%d " % i) + "plain text with many other words in it " + str(i), 1) for i in range(300)]
    rows += [(1000 + i, "### $$$ %%% spam & more | here " * 3 + str(i), 0) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    stats = Q.with_statistics(docs)
    table = Scratch(spark, "test").cut(Q.labelled_rows(stats.drop("quality"), docs.select("doc_id", "quality")), "t")
    rules = Q.learn(table)
    assert rules.rules
    wrong = stats.withColumn("ok", rules.verdict()).filter(F.col("ok") != (F.col("quality") == 1)).count()
    assert wrong == 0


def test_no_labels_keep_everything(spark):
    empty = spark.createDataFrame([], "doc_id long, bad boolean, " + ", ".join(f"{f} double" for f in Q.FEATURES))
    assert Q.learn(empty).rules == ()


def test_query_plan_has_no_python(spark, sf):
    plan = Q.op7_quality_rules(spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
