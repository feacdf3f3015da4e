"""SimHash near-duplicates (operator 4).

Method: a Gray-order hierarchical index. A fingerprint pair that differs in at most ``MAX_BITS``
bits agrees on two of four 16-bit blocks, so the upper nodes of the hierarchy are the masked bit
patterns of the six block pairs; Spark shuffles distinct fingerprints to these nodes and sorts
each node by Gray rank. A shard builds one hierarchy over all its fingerprints: the upper nodes,
and below them a tree over the Gray order that factors out the bits that whole groups share. A
node keeps only the bits that its parent has not fixed; every fingerprint is searched from its
upper node down, differences accumulate on the way, and a group is pruned once they exceed the
limit. Groups of any size go this way.

Copies share a fingerprint and are one entry of the index. A group emits a spanning forest, not
its pairs: subtrees that are already connected with the query are skipped.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.llm.components import components
from driftloom.llm.shared import Scratch, table

SHINGLE, SEED, MAX_BITS = 3, 42, 2
#: Two of four blocks: the masks of the upper nodes.
PAIRS = list(combinations(range(4), 2))
#: Children of a tree node; fingerprints of an upper node from which it has nodes of its own below.
FAN_OUT, HOT_NODE = 16, 50_000
#: Nodes of a level that a block of queries visits at once; a block with more is halved.
MOST_VISITS = 1_000_000
#: Rows of whole groups that a task gathers before it compares them; shingles hashed at once.
CHUNK_ROWS, CHUNK_SHINGLES = 200_000, 65_536


def fingerprint(text: bytes) -> int:
    """Fingerprint of one text in UTF-8, as an unsigned integer."""
    words = text.lower().split()  # bytes: only A-Z are lowered, only ASCII white space separates
    if not words:
        return 0
    n = max(1, len(words) - SHINGLE + 1)
    shingles = map(b" ".join, zip(*[islice(words, k, None) for k in range(SHINGLE)])) if len(words) >= SHINGLE else iter([b" ".join(words)])
    hashes = map(partial(xxhash.xxh64_intdigest, seed=SEED), shingles)
    ones = np.zeros(64, np.int64)
    for _ in range(0, n, CHUNK_SHINGLES):
        part = np.fromiter(islice(hashes, CHUNK_SHINGLES), np.uint64)
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    bits = np.packbits(2 * ones > n, bitorder="little")
    return int(bits.view(np.uint64)[0])


def fingerprint_column(text: Column) -> Column:
    """64-bit fingerprint as a signed long; null, empty and blank texts give 0."""

    def prints(texts: pa.Array) -> pa.Array:
        raw = texts.cast(pa.large_binary())
        return pa.array(np.array([fingerprint(t.as_py() or b"") for t in raw], np.uint64).view(np.int64), pa.int64())

    return F.arrow_udf(prints, "long")(text)


def gray_rank(x: Column) -> Column:
    """Position of a 64-bit code in Gray order."""
    for k in (1, 2, 4, 8, 16, 32):
        x = x.bitwiseXOR(F.shiftrightunsigned(x, k))
    return x


def _join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after linking a[i] with b[i]: every set of linked entries has its least label."""
    parent = np.arange(len(label))
    x, y = label[a], label[b]
    while True:
        x, y = parent[x], parent[y]
        apart = x != y
        if not apart.any():
            return parent[label]
        np.minimum.at(parent, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while not np.array_equal(higher := parent[parent], parent):
            parent = higher


class GrayForest:
    """The hierarchy of one shard: upper nodes, and below each a tree over its Gray order.

    ``group`` (sorted) tells the upper node of each fingerprint; within it codes are in Gray order.
    ``levels[0]`` has a node for up to ``FAN_OUT`` neighbours of one upper node, each level above
    one for up to ``FAN_OUT`` nodes below, and the last has the upper nodes. A node keeps the bits
    that all below it share and its parent does not fix, as (mask, pattern).
    """

    def __init__(self, group: np.ndarray, codes: np.ndarray):
        self.codes = codes
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        self.first: list[np.ndarray] = []  # of each level, a node's first child and one end mark
        mask, pattern = np.full(len(codes), ~np.uint64(0)), codes
        shared = []
        while True:
            runs = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            sizes = np.diff(np.r_[runs, len(group)])
            within = np.arange(len(group)) - np.repeat(runs, sizes)
            first = np.flatnonzero(within % FAN_OUT == 0)
            lead = np.repeat(pattern[first], np.diff(np.r_[first, len(group)]))
            mask = np.bitwise_and.reduceat(mask & ~(pattern ^ lead), first)
            pattern, group = pattern[first] & mask, group[first]
            self.first.append(np.r_[first, len(within)])
            shared.append((mask, pattern))
            if len(first) == len(runs):
                break
        self.group, self.roots = group, pattern  # one node a group now
        for k, (mask, pattern) in enumerate(shared):
            if k + 1 < len(shared):
                mask = mask & ~np.repeat(shared[k + 1][0], np.diff(self.first[k + 1]))
            self.levels.append((mask, pattern & mask))
        self.inner = ~np.repeat(shared[0][0], np.diff(self.first[0]))

    def _one_label(self, label: np.ndarray) -> list[np.ndarray]:
        """For each level, the label that all entries below a node have, or -1."""
        low = high = label
        out = []
        for first in self.first:
            low, high = np.minimum.reduceat(low, first[:-1]), np.maximum.reduceat(high, first[:-1])
            out.append(np.where(low == high, low, -1))
        return out

    def near(self, queries: np.ndarray, roots: np.ndarray, label: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray] | None:
        """(query, entry) index pairs below the queries' upper nodes, within ``limit`` bits and of different labels.

        None where several queries would visit over ``MOST_VISITS`` nodes of a level at once.
        """
        alike = self._one_label(label)
        q, node = queries, roots
        apart = np.zeros(len(q), np.uint8)
        for k in range(len(self.levels) - 1, -1, -1):
            mask, pattern = self.levels[k]
            apart = apart + np.bitwise_count((self.codes[q] ^ pattern[node]) & mask[node])
            keep = (apart <= limit) & (alike[k][node] != label[q])
            q, node, apart = q[keep], node[keep], apart[keep]
            below = self.first[k]
            count = below[node + 1] - below[node]
            if len(queries) > 1 and count.sum() > MOST_VISITS:
                return None
            node = np.repeat(below[node] - np.cumsum(count) + count, count) + np.arange(count.sum())
            q, apart = np.repeat(q, count), np.repeat(apart, count)
        apart = apart + np.bitwise_count((self.codes[q] ^ self.codes[node]) & self.inner[node])
        keep = (apart <= limit) & (label[q] != label[node])
        return q[keep], node[keep]


def shard_links(group: np.ndarray, codes: np.ndarray, limit: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Links (code, code) that connect what is within ``limit`` bits below each upper node of a shard.

    ``group`` is sorted, and codes are in Gray order within a group.
    """
    forest, label = GrayForest(group, codes), np.arange(len(codes))
    roots = np.searchsorted(forest.group, group)
    step = max(1024, len(codes) // 64)
    todo = [np.arange(at, min(at + step, len(codes))) for at in range(0, len(codes), step)][::-1]
    while todo:
        some = todo.pop()
        found = forest.near(some, roots[some], label, limit)
        if found is None:  # the first half links first, which prunes for the second
            todo += [some[len(some) // 2 :], some[: len(some) // 2]]
        elif len(found[0]):
            label = _join(label, *found)
    linked = np.flatnonzero(label != np.arange(len(label)))
    return codes[linked], codes[label[linked]]


def tree_labels(codes: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Labels of the components below one upper node, whose codes are in Gray order."""
    a, b = shard_links(np.zeros(len(codes), np.int64), codes, limit)
    at = {c: i for i, c in enumerate(codes.tolist())}
    label = np.arange(len(codes))
    return _join(label, np.array([at[c] for c in a.tolist()], np.int64), np.array([at[c] for c in b.tolist()], np.int64))


def _links_of(limit: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a partition that is sorted by upper node and Gray rank; upper nodes stay whole."""

    def linked(node: np.ndarray, codes: np.ndarray) -> pa.RecordBatch:
        a, b = shard_links(node, codes, limit)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    held: list[tuple[np.ndarray, np.ndarray]] = []
    rows = 0
    for batch in batches:
        node, codes = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
        # Rows are joined only where an upper node ends, so a node over many batches is copied once.
        last = np.searchsorted(node, node[-1])
        ends = bool(held) and (last > 0 or node[0] != held[-1][0][-1])
        if rows + last >= CHUNK_ROWS and ends:
            yield linked(*map(np.concatenate, zip(*held, (node[:last], codes[:last]))))
            held, rows, node, codes = [], 0, node[last:], codes[last:]
        held.append((node, codes))
        rows += len(node)
    if rows:
        yield linked(*map(np.concatenate, zip(*held)))


def _block(x: Column, at: int, bits: int) -> Column:
    return F.shiftrightunsigned(x, at * bits).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))


def _pair_nodes(x: Column, bits: int, above: Column) -> Column:
    """Six nodes of the lower ``4 * bits`` bits of ``x``: above, the mask's number, and the two blocks it keeps."""
    nodes = [
        F.shiftleft(above * 8 + k, 2 * bits).bitwiseOR(F.shiftleft(_block(x, b, bits), bits)).bitwiseOR(_block(x, a, bits))
        for k, (a, b) in enumerate(PAIRS)
    ]
    return F.array(*nodes)


def _upper_nodes(codes: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, fp): the upper nodes of each fingerprint.

    A node fixes two of four 16-bit blocks. Below one with over ``HOT_NODE`` fingerprints are nodes
    that also fix two of the four bytes that are left: two codes within two bits agree on some two
    of them. Such a node has at most 2**16 codes, so no task has more, whatever the texts are.
    """
    dealt = codes.select(F.explode(_pair_nodes(F.col("fp"), 16, F.lit(0).cast("long"))).alias("node"), "fp")
    hot = scratch.cut(dealt.groupBy("node").count().filter(F.col("count") > HOT_NODE).select("node", F.lit(True).alias("hot")), "hot-nodes")
    if hot.isEmpty():
        return dealt
    mask = F.shiftright("node", 32)
    rest = [sorted({0, 1, 2, 3} - {*pair}) for pair in PAIRS]
    left = [F.shiftleft(_block(F.col("fp"), d, 16), 16).bitwiseOR(_block(F.col("fp"), c, 16)) for c, d in rest]
    free = F.coalesce(*[F.when(mask == k, x) for k, x in enumerate(left)])
    deeper = F.transform(_pair_nodes(free, 8, F.col("node")), lambda n: n.bitwiseOR(F.lit(1 << 62)))
    marked = dealt.join(hot, "node", "left")
    return marked.select(F.explode(F.when(F.col("hot"), deeper).otherwise(F.array("node"))).alias("node"), "fp")


def links_between(codes: DataFrame, scratch: Scratch, limit: int = MAX_BITS) -> DataFrame:
    """Links (a, b) among distinct fingerprints (column ``fp``) that connect all within ``limit`` bits.

    Every pair within the limit is connected through the links, directly or over others.
    """
    if not 0 <= limit <= MAX_BITS:
        raise ValueError(f"two of four blocks are free of differences only up to {MAX_BITS} bits")
    shards = _upper_nodes(codes, scratch).repartition("node").sortWithinPartitions("node", gray_rank(F.col("fp")))
    return shards.mapInArrow(partial(_links_of, limit), "a long, b long")


def near_duplicate_classes(docs: DataFrame, scratch: Scratch, limit: int = MAX_BITS) -> DataFrame:
    """(fp, root, component_id) for every distinct fingerprint of ``docs`` (doc_id, fp).

    ``component_id`` is the least doc_id of the component; null ids count only if there is no
    other. Repeated rows and ids change nothing.
    """
    classes = scratch.cut(docs.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    labels = components(scratch.cut(links_between(classes, scratch, limit).distinct(), "links"), scratch)
    linked = scratch.cut(labels.select(F.col("node").alias("fp"), "root").join(classes, "fp"), "linked")
    least = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    with_id = linked.join(least, "root").select("fp", "root", "component_id")
    alone = classes.join(labels.select(F.col("node").alias("fp")), "fp", "left_anti")
    return scratch.cut(with_id.unionByName(alone.select("fp", F.col("fp").alias("root"), F.col("first").alias("component_id"))), "result")


def near_duplicates(docs: DataFrame, scratch: Scratch, text_col: str = "text", limit: int = MAX_BITS) -> DataFrame:
    """(doc_id, fp, root, component_id) for every row of ``docs``.

    Rows with null, empty and blank texts have fingerprint 0 and are linked like any other.
    """
    prints = scratch.cut(docs.select("doc_id", fingerprint_column(F.col(text_col)).alias("fp")), "fingerprints")
    return prints.join(near_duplicate_classes(prints, scratch, limit), "fp").select("doc_id", "fp", "root", "component_id")


def keep_one(docs: DataFrame, scratch: Scratch, text_col: str = "text", limit: int = MAX_BITS) -> DataFrame:
    """Rows of ``docs`` with one document of each component: the one with its least doc_id.

    Of several rows with that id the one with the least text stays, then with the least JSON. A component whose ids are all null keeps one row. All
    columns come back as they were, whatever their names. Texts are read for their fingerprints
    once; the ids that stay decide, and only rows whose id occurs again are looked at once more.
    """
    prints = scratch.cut(docs.select("doc_id", fingerprint_column(F.col(text_col)).alias("fp")), "fingerprints")
    classes = near_duplicate_classes(prints, scratch, limit).select("fp", "root", "component_id")
    staying = prints.join(classes, "fp").filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    staying = scratch.cut(staying.groupBy("doc_id", "root").agg(F.min("fp").alias("fp")), "staying")
    again = scratch.cut(prints.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"), "repeated-ids")

    def of(rows: DataFrame, ids: DataFrame, how: str) -> DataFrame:
        return rows.alias("d").join(ids.select(F.col("doc_id").alias("_kept")).alias("k"), F.col("d.doc_id").eqNullSafe(F.col("k._kept")), how)

    if again.isEmpty():
        return of(docs, staying, "left_semi")
    once = of(of(docs, staying, "left_semi"), again, "left_anti")
    # Rows that share an id: one row of the fingerprint that stays, for each component.
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    some = of(of(docs, staying, "left_semi"), again, "left_semi")
    some = some.select(row.alias("row"), F.col("doc_id").alias("id"), fingerprint_column(F.col(text_col)).alias("fp"))
    chosen = staying.select(F.col("doc_id").alias("own"), F.col("fp").alias("print"), "root")
    found = some.join(chosen, F.col("id").eqNullSafe(F.col("own")) & (F.col("fp") == F.col("print")))
    tie = F.struct(F.col(f"row.{text_col}").cast("string"), F.to_json("row"))
    return once.unionByName(found.groupBy("root").agg(F.min_by("row", tie).alias("row")).select("row.*"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 4 over all of ``documents``."""
    found = near_duplicates(table(spark, sf_dir, "documents"), Scratch(spark, "simhash"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op4_simhash": op4_simhash}
ORACLES: dict[str, str] = {}
