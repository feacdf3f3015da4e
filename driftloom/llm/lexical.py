"""Ranked lexical search (operator 12).

Method: presence-mask grouping. Each term of an item has a bit; the bitmaps of an item's terms over
the documents of a batch give each document its mask, and documents with equal masks form a group. A
mask's maximum score is the sum of its terms' best parts in the batch. Distinct masks are scored
exactly by descending maximum until the item's lowest kept score is above every mask left, so no
document that ranks is missed.

One pass over the documents counts them and their terms, a second one ranks; neither shuffles texts.
A task hands over at most ``TOP`` documents an item, and these are ranked in two levels.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftloom.llm.shared import Scratch, table

#: Documents given for an item; pairs of item and term held at once (an item is never divided).
TOP, BLOCK_TERMS = 50, 100_000
#: Bytes of a text cut into terms at once.
PIECE = 1 << 20
#: First level of ranking: groups of an item's candidates.
GROUPS = 64
# ASCII letters, lower-cased, and digits are kept, as are all bytes of other characters; the rest separates.
_KEPT = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in bytes(range(256)).lower())


def terms_of(raw: bytes) -> Iterator[list[bytes]]:
    """Terms of a text in UTF-8, in lists of bounded length."""
    at = 0
    while at < len(raw):
        end = min(len(raw), at + PIECE)
        part = raw[at:end].translate(_KEPT)
        if end < len(raw) and part[-1] != 32 and (more := raw[end : end + PIECE].translate(_KEPT)):
            while 32 not in more and end + len(more) < len(raw):
                more += raw[end + len(more) : end + len(more) + PIECE].translate(_KEPT)
            cut = more.find(32)
            cut = len(more) if cut < 0 else cut
            part, end = part + more[:cut], end + cut
        yield part.split()
        at = end


def counted(raw: bytes | None, vocabulary: dict[bytes, int]) -> tuple[int, Counter]:
    """How many terms a text has, and how often each of the vocabulary's."""
    n, found = 0, Counter()
    for part in terms_of(raw or b""):
        n += len(part)
        found.update(map(vocabulary.get, part))
    found.pop(None, None)
    return n, found


@dataclass
class Items:
    """A block of items: ids, the vocabulary, and each item's terms as places in it with their weights."""

    ids: list
    vocabulary: dict[bytes, int]
    terms: list[np.ndarray]
    weights: list[np.ndarray]
    documents: int = 0
    length: int = 0

    @classmethod
    def of(cls, rows: list[tuple]) -> Items:
        vocabulary: dict[bytes, int] = {}
        terms = [np.array(sorted(vocabulary.setdefault(bytes(t), len(vocabulary)) for t in ts), np.int64) for _, ts in rows]
        return cls([r[0] for r in rows], vocabulary, terms, [])

    def weigh(self, documents: int, length: int, df: dict[int, int]) -> None:
        self.documents, self.length = documents, length
        w = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * df.get(t, 0) + 1))) for t in range(len(self.vocabulary))], np.int64)
        self.weights = [w[t] for t in self.terms]


def _tally(items, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, count): documents of a task that hold each term; at -1 and -2 its documents and all their terms."""
    vocabulary, df = items.value.vocabulary, Counter()
    for batch in batches:
        for text in batch.column(0).cast(pa.large_binary()):
            n, found = counted(text.as_py(), vocabulary)
            df.update(found.keys())
            df[-1] += n > 0
            df[-2] += n
    yield pa.RecordBatch.from_arrays([pa.array(list(df), pa.int64()), pa.array(list(df.values()), pa.int64())], ["term", "count"])


def masks_of(present: list[np.ndarray], size: int) -> np.ndarray:
    """One value for each of ``size`` documents: the set of terms it has, from each term's documents."""
    words = max(1, -(-len(present) // 64))
    mask = np.zeros((size, words), np.uint64)
    for j, docs in enumerate(present):
        mask[docs, j // 64] |= np.uint64(1 << (j % 64))
    return mask[:, 0] if words == 1 else mask.view(np.dtype((np.void, 8 * words))).ravel()


class Best:
    """The best (score, id) of an item so far, at most ``top``."""

    def __init__(self, top: int):
        self.top, self.rows = top, []

    def least(self) -> int:
        """What a document must reach to matter; 0 while there is room."""
        return self.rows[-1][0] if len(self.rows) >= self.top else 0

    def add(self, scores: np.ndarray, ids: list) -> None:
        new = [(s, i) for s, i in zip(scores.tolist(), ids) if s > 0]
        self.rows = sorted(self.rows + new, key=lambda r: (-r[0], r[1] is None, r[1]))[: self.top]


def search_batch(items: Items, ids: list, lengths: np.ndarray, owner: np.ndarray, term: np.ndarray, tf: np.ndarray, best: list[Best]) -> int:
    """Bring one batch into ``best``; how many documents were scored. Postings (owner, term, tf) are sorted by term and owner."""
    m = np.array([50 + (50 * int(n) * items.documents) // items.length for n in lengths], np.int64)
    part = (1_000_000_000 * tf) // (1000 * tf + 20 * m[owner])
    ends = np.searchsorted(term, np.arange(len(items.vocabulary) + 1))
    most = np.zeros(len(items.vocabulary), np.int64)
    np.maximum.at(most, term, part)
    scored = 0
    for k, (terms, weights) in enumerate(zip(items.terms, items.weights)):
        here = np.flatnonzero(ends[terms + 1] > ends[terms])
        if not len(here):
            continue
        spans = [slice(ends[t], ends[t + 1]) for t in terms[here].tolist()]
        masks = masks_of([owner[s] for s in spans], len(ids))
        _, first, group, size = np.unique(masks, return_index=True, return_inverse=True, return_counts=True)
        bits = np.zeros((len(first), len(here)), bool)
        for j, s in enumerate(spans):
            at = np.searchsorted(owner[s], first)
            bits[:, j] = owner[s][np.minimum(at, s.stop - s.start - 1)] == first
        bound = bits @ (weights[here] * most[terms[here]])
        order = np.argsort(-bound, kind="stable")
        docs = np.argsort(np.argsort(order)[group], kind="stable")  # documents by their masks' order
        ends_of = np.cumsum(size[order])
        at = 0
        while at < len(order) and bound[order[at]] >= max(1, best[k].least()):
            # As many masks as make up TOP documents, of those that can still matter.
            to = int(np.searchsorted(ends_of, (ends_of[at - 1] if at else 0) + best[k].top)) + 1
            to = min(to, int(np.searchsorted(-bound[order], -max(1, best[k].least()), side="right")))
            chosen = np.sort(docs[ends_of[at - 1] if at else 0 : ends_of[to - 1]])
            score = np.zeros(len(chosen), np.int64)
            for w, s in zip(weights[here].tolist(), spans):
                place = np.minimum(np.searchsorted(owner[s], chosen), s.stop - s.start - 1)
                score += np.where(owner[s][place] == chosen, w * part[s][place], 0)
            best[k].add(score, [ids[i] for i in chosen.tolist()])
            scored += len(chosen)
            at = to
    return scored


def _search(items, top: int, kind: pa.DataType, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item, id, score): a task's best documents of each item."""
    block = items.value
    best = [Best(top) for _ in block.ids]
    for batch in batches:
        lengths, postings = [], []
        for d, text in enumerate(batch.column(1).cast(pa.large_binary())):
            n, found = counted(text.as_py(), block.vocabulary)
            lengths.append(n)
            postings.append(np.array([[d] * len(found), list(found), list(found.values())], np.int64).reshape(3, -1))
        owner, term, tf = np.concatenate([np.zeros((3, 0), np.int64), *postings], axis=1)
        order = np.lexsort((owner, term))
        search_batch(block, batch.column(0).to_pylist(), np.array(lengths, np.int64), owner[order], term[order], tf[order], best)
    rows = [(k, i, s) for k, b in enumerate(best) for s, i in b.rows]
    item, ident, score = zip(*rows) if rows else ((), (), ())
    yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(ident, kind), pa.array(score, pa.int64())], ["item", "id", "score"])


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        terms = [sorted({t for part in terms_of(x or b"") for t in part}) for x in batch.column(1).cast(pa.large_binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(terms, pa.list_(pa.binary()))], ["item", "terms"])


def ranked(docs: DataFrame, items: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", top: int = TOP) -> DataFrame:
    """(item_col, rank, id_col, score): each item's ``top`` documents with a score above 0.

    Null and blank texts have no terms: such documents never rank, such items have no rows. Rows of
    items with one id, null included, are one item. Repeated documents rank one after the other; equal
    scores by ascending id, null ids last. Empty tables give no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    asked = items.select(F.col(f"`{item_col}`").alias("item"), F.col(f"`{item_text_col}`").cast("string").alias("text"))
    kind, ident = asked.schema["item"].dataType.simpleString(), docs.schema["id"].dataType
    asked = asked.mapInArrow(_item_terms, f"item {kind}, terms array<binary>")
    asked = scratch.cut(asked.groupBy("item").agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias("terms")).filter(F.size("terms") > 0), "items")
    parts = max(1, -(-(asked.agg(F.sum(F.size("terms"))).first()[0] or 0) // BLOCK_TERMS))
    arrow = pa.int64() if ident.simpleString() == "bigint" else docs.select("id").limit(0).toArrow().schema.field("id").type
    found = None
    for k in range(parts):
        rows = asked.filter(F.pmod(F.xxhash64("item"), F.lit(parts)) == k).collect()  # about BLOCK_TERMS terms
        block = Items.of([(r.item, r.terms) for r in rows])
        sent = spark.sparkContext.broadcast(block)
        counts = docs.select("text").mapInArrow(partial(_tally, sent), "term long, count long").groupBy("term").agg(F.sum("count").alias("count")).collect()
        df = {r.term: r["count"] for r in counts}
        sent.destroy()
        if df.get(-2):
            block.weigh(df[-1], df[-2], df)
        else:
            block = Items([], {}, [], [])
        sent = spark.sparkContext.broadcast(block)
        hits = docs.mapInArrow(partial(_search, sent, top, arrow), f"item int, id {ident.simpleString()}, score long")
        order = [F.desc("score"), F.asc_nulls_last("id")]
        hits = hits.withColumn("group", F.pmod(F.spark_partition_id(), F.lit(GROUPS)))
        hits = hits.withColumn("rank", F.row_number().over(Window.partitionBy("item", "group").orderBy(*order))).filter(F.col("rank") <= top)
        hits = hits.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= top)
        names = spark.createDataFrame([(i, r) for i, r in enumerate(block.ids)], f"item int, name {kind}")
        hits = scratch.cut(hits.join(F.broadcast(names), "item").select(F.col("name").alias(item_col), "rank", F.col("id").alias(id_col), "score"), f"ranked-{k}")
        sent.destroy()
        found = hits if found is None else found.unionByName(hits)
    return found


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 12: all of ``documents`` for each item of ``benchmark``."""
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), Scratch(spark, "lexical"))


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
QUERIES = {"op12_lexical": op12_lexical}
ORACLES = {
    "op12_lexical": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS t FROM documents WHERE text IS NOT NULL),
q AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark)),
totals AS (SELECT count(*) AS docs, sum(len(t))::BIGINT AS terms FROM d WHERE len(t) > 0),
post AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY r, term),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM post, totals GROUP BY term, docs),
m AS (SELECT r, doc_id, 100 - 50 + ((50 * len(t) * docs) // terms) AS m FROM d, totals WHERE len(t) > 0),
scored AS (
  SELECT item_id, doc_id, r, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM q JOIN post USING (term) JOIN w USING (term) JOIN m USING (r) GROUP BY item_id, doc_id, r)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
WHERE rank <= 50""",
}
