"""Suffix-array dedup (operator 8).

Method: a difference-cover algorithm, distributed by content. Sorting every suffix of the corpus
would shuffle each byte's suffix several times over, so Spark first brings together the places
that can hold equal strings at all:

1. Each string of LENGTH bytes has one anchor, the least hashed GRAM-byte string inside it. Equal
   strings have equal anchors at equal places, so only places with equal anchors can match. One
   shuffle groups the anchors; an anchor that occurs once proves its strings unique. Tasks combine
   equal regions before it, so what is in very many texts costs its anchor's task few rows.
2. An anchor's region is all strings that share it. Equal regions are one entry, with their
   first place; a region that occurs again is a repeat as a whole.
3. Where an anchor has different regions, suffix arrays decide: a task concatenates its regions
   and sorts their suffixes by difference cover (sort the triples at two of three places, recurse
   on their names, merge the other suffixes), then compares adjacent LENGTH-byte prefixes.
4. An anchor with very many different regions, such as a common phrase, is divided once more:
   its strings are put into cells of up to CELL neighbouring places, by the LENGTH - CELL + 1 bytes
   that all strings of a cell share. Cells go through steps 2 and 3 in their turn. Only a cell that
   still has very many different regions, a fixed passage at the rim of which texts differ, is taken
   apart into its strings, which are grouped by a 128-bit digest, so that no task holds them all.

Whole copies of a text are found first, by their SHA-256, and give no anchors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftloom.llm.shared import Scratch, table

LENGTH, GRAM = 100, 24
#: Regions of one anchor or cell that a task sorts; one with more is divided (step 4).
MOST_REGIONS = 2_000
#: Neighbouring strings of an anchor that make up a cell.
CELL = 8
#: Bytes of concatenated regions in one suffix array, and of text that is anchored at once.
ARRAY_BYTES, SLAB_BYTES = 1 << 20, 4 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS: list[np.ndarray] = []


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _sums(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of a polynomial hash, and the powers that shift a range to place 0."""
    if not _POWERS or len(_POWERS[0]) <= len(raw):
        n = max(len(raw), 1 << 17) + 1
        _POWERS[:] = [np.multiply.accumulate(np.r_[np.uint64(1), np.full(n, b, np.uint64)]) for b in (_BASE, _BACK)]
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _POWERS[0][: len(raw)], out=sums[1:])
    return sums, _POWERS[1]


def _least_before(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, by doubling."""
    done = 1
    while done * 2 <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return x if done == width else np.minimum(x[: len(x) - (width - done)], x[width - done :])


def anchors(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of a text: hash, region hash, first string's start, number of strings, offset.

    The region of ``n`` strings from ``start`` covers bytes start to start + n - 1 + LENGTH; the
    anchor lies ``offset`` bytes into it.
    """
    if len(raw) < LENGTH:
        return (np.empty(0, np.uint64),) * 2 + (np.empty(0, np.int64),) * 3
    sums, back = _sums(raw)
    m = len(raw) - GRAM + 1
    grams = _mixed((sums[GRAM:] - sums[:-GRAM]) * back[:m])
    place = np.arange(m, dtype=np.uint64)
    least = _least_before((grams & ~np.uint64(0xFFFFFFFF)) | place, LENGTH - GRAM + 1) & np.uint64(0xFFFFFFFF)
    at = least.astype(np.int64)
    starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    counts = np.diff(np.r_[starts, len(at)])
    own = at[starts]
    ends = starts + counts - 1 + LENGTH
    region = _mixed((sums[ends] - sums[starts]) * back[starts])
    region = _mixed(region ^ (counts << 8 | own - starts).astype(np.uint64))
    return grams[own], region, starts, counts, own - starts


def slabs(n: int) -> Iterator[tuple[int, int]]:
    """Ranges of a text that hold every string of LENGTH bytes once."""
    at = 0
    while at == 0 or at + LENGTH <= n:
        yield at, min(n, at + SLAB_BYTES + LENGTH - 1)
        at += SLAB_BYTES


ANCHOR = "doc long, th long, anchor long, region long, place long, again boolean, deal long"
#: A place packs start, number of strings and offset of the anchor into one long.
_N_BITS, _OFFSET_BITS = 7, 7
#: Anchors that a task combines before they are shuffled.
CHUNK_ANCHORS = 400_000


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors of whole texts (doc, th, text), combined in chunks before the shuffle.

    Of equal regions in a chunk only the first by (doc, th, start) is dealt out by its anchor. The
    others are repeats whatever comes from elsewhere: they are marked ``again`` and dealt evenly,
    so a passage that is in every document sends a few rows of a chunk to its anchor's task.
    """

    def combined(held: list[tuple]) -> pa.RecordBatch:
        doc, th, anchor, region, place = map(np.concatenate, zip(*held))
        order = np.lexsort((place, th, doc, region, anchor))
        a, r = anchor[order], region[order]
        again = np.zeros(len(order), bool)
        again[order[1:]] = (a[1:] == a[:-1]) & (r[1:] == r[:-1])
        own = [x[order] for x in (doc, th, place)]
        # Rows that are given twice are one place, not a repeat of each other: they share a mark.
        own = [x[order] for x in (doc, th, place)]
        twice = (a[1:] == a[:-1]) & (r[1:] == r[:-1]) & np.logical_and.reduce([x[1:] == x[:-1] for x in own])
        lead = np.arange(len(order))
        lead[1:][twice] = 0
        again[order] = again[order][np.maximum.accumulate(lead)]
        even = _mixed((doc ^ place * 31 ^ th).view(np.uint64)).view(np.int64)
        columns = [doc, th, anchor.view(np.int64), region.view(np.int64), place, again, np.where(again, even, anchor.view(np.int64))]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["doc", "th", "anchor", "region", "place", "again", "deal"])

    held: list[tuple] = []
    size = 0
    for batch in batches:
        texts = batch.column(2).cast(pa.large_binary())
        for doc, th, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts):
            raw = np.frombuffer(t.as_py() or b"", np.uint8)
            for a, b in slabs(len(raw)):
                h, region, start, count, offset = anchors(raw[a:b])
                packed = (start + a) << (_N_BITS + _OFFSET_BITS) | count << _OFFSET_BITS | offset
                held.append((np.full(len(h), doc, np.int64), np.full(len(h), th, np.int64), h, region, packed))
                size += len(h)
            if size >= CHUNK_ANCHORS:
                yield combined(held)
                held, size = [], 0
    if held:
        yield combined(held)


def _start(place: Column) -> Column:
    return F.shiftright(place, _N_BITS + _OFFSET_BITS)


def _count(place: Column) -> Column:
    return F.shiftright(place, _OFFSET_BITS).bitwiseAND(F.lit((1 << _N_BITS) - 1))


def _offset(place: Column) -> Column:
    return place.bitwiseAND(F.lit((1 << _OFFSET_BITS) - 1))


def cells_of(regions: DataFrame) -> DataFrame:
    """Each region divided into cells, as (cell, doc, th, start, n, bytes).

    Equal strings of one anchor have the anchor equally far from their start. That distance,
    divided by CELL, names the cell; the bytes that all strings of the cell share are hashed into
    it, so equal strings always meet.
    """
    n, offset, raw = F.octet_length("bytes") - (LENGTH - 1), F.col("offset").cast("int"), F.col("bytes")

    def cell(b: Column) -> Column:
        far, near = F.least(offset, b * CELL + (CELL - 1)), F.greatest(offset - n + 1, b * CELL)
        shared = F.substring(raw, offset - b * CELL + 1, F.lit(LENGTH - CELL + 1))
        return F.struct(
            F.xxhash64("anchor", b, shared).alias("cell"), (F.col("start") + offset - far).alias("start"),
            (far - near + 1).cast("long").alias("n"), F.substring(raw, offset - far + 1, far - near + LENGTH).alias("bytes"),
        )

    blocks = F.sequence(F.floor((offset - n + 1) / CELL).cast("int"), F.floor(offset / CELL).cast("int"))
    return regions.select("doc", "th", F.inline(F.transform(blocks, cell)))


def sort_suffixes(text: np.ndarray) -> np.ndarray:
    """Suffix array by difference cover modulo 3; ``text`` has integers from 1 to about its length."""
    n = len(text)
    if n < 8:
        rest = text.tolist()
        return np.array(sorted(range(n), key=lambda i: rest[i:]), np.int64)
    t = np.r_[text.astype(np.int64), 0, 0, 0]
    top = np.int64(t.max() + 1)
    # Places of the cover: 1 and 2 modulo 3 (n counts as one, so that the two halves stay apart).
    ones, twos = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    cover = np.r_[ones, twos]
    triple = (t[cover] * top + t[cover + 1]) * top + t[cover + 2]
    names_of, name = np.unique(triple, return_inverse=True)
    rank = np.zeros(n + 4, np.int64)
    if len(names_of) == len(cover):
        rank[cover] = name + 1
    else:
        order = sort_suffixes(name + 1)
        rank[cover[order]] = np.arange(1, len(cover) + 1)
    by_rank = cover[np.argsort(rank[cover])]
    by_rank = by_rank[by_rank < n]
    zeros = np.arange(0, n, 3)
    m = np.int64(len(cover) + 2)
    zeros = zeros[np.argsort(t[zeros] * m + rank[zeros + 1], kind="stable")]
    # Merge: against a place 1 modulo 3 one byte and a rank decide, against 2 two bytes and a rank.
    a, b = by_rank[by_rank % 3 == 1], by_rank[by_rank % 3 == 2]
    below = np.searchsorted(t[a] * m + rank[a + 1], t[zeros] * m + rank[zeros + 1])
    pair = lambda x: (t[x] * top + t[x + 1]) * m + rank[x + 2]
    below += np.searchsorted(pair(b), pair(zeros))
    out = np.empty(n, np.int64)
    at = below + np.arange(len(zeros))
    free = np.ones(n, bool)
    free[at] = False
    out[at], out[free] = zeros, by_rank
    return out


def repeated_in(regions: list[bytes], first: list[tuple]) -> list[list[int]]:
    """For each region, the starts of strings that occur in a region with a smaller ``first``.

    ``first`` orders the regions' strings: (document, start of the region).
    """
    # Bytes are 1 to 256; every region ends in 257, which no string of a region includes.
    text = np.concatenate([np.r_[np.frombuffer(r, np.uint8).astype(np.int64) + 1, 257] for r in regions])
    sizes = np.array([len(r) + 1 for r in regions])
    begin = np.cumsum(np.r_[0, sizes[:-1]])
    owner = np.repeat(np.arange(len(regions)), sizes)
    order = sort_suffixes(text)
    local = order - begin[owner[order]]
    order = order[local + LENGTH < sizes[owner[order]]]  # whole strings only
    if not len(order):
        return [[] for _ in regions]
    columns = np.arange(LENGTH)
    new = np.ones(len(order), bool)
    for at in range(1, len(order), 4096):
        here, prev = order[at : at + 4096], order[at - 1 : at - 1 + len(order[at : at + 4096])]
        new[at : at + 4096] = (text[here[:, None] + columns] != text[prev[:, None] + columns]).any(axis=1)
    group = np.cumsum(new) - 1
    # Places compare by document, then start; the least of each group stays.
    rank = np.empty(len(regions), np.int64)
    documents = {d: k for k, d in enumerate(sorted({f[0] for f in first}))}
    rank[:] = [documents[f[0]] for f in first]
    absolute = np.array([f[1] for f in first])[owner[order]] + order - begin[owner[order]]
    by = np.lexsort((absolute, rank[owner[order]], group))
    lead = np.flatnonzero(np.r_[True, group[by][1:] != group[by][:-1]])[group[by]]
    # A region that is given twice, from repeated rows, is no repeat of itself.
    document, start = rank[owner[order]][by], absolute[by]
    again = (document != document[lead]) | (start != start[lead])
    out: list[list[int]] = [[] for _ in regions]
    for p in order[by[again]].tolist():
        out[owner[p]].append(int(p - begin[owner[p]]))
    return out


REPEATS = "doc long, th long, start long, n long"


def _sorted_repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated strings (runs of starts) of a partition sorted by anchor; anchors stay whole."""

    def flush(rows: list[dict]) -> pa.RecordBatch:
        found = repeated_in([r["bytes"] for r in rows], [((r["doc"], r["th"]), r["start"]) for r in rows]) if rows else []
        out = []
        for r, starts in zip(rows, found):
            for s in sorted(starts):
                if out and out[-1][:2] == (r["doc"], r["th"]) and out[-1][2] + out[-1][3] == r["start"] + s:
                    out[-1] = (*out[-1][:3], out[-1][3] + 1)
                else:
                    out.append((r["doc"], r["th"], r["start"] + s, 1))
        columns = list(zip(*out)) or [[], [], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc", "th", "start", "n"])

    rows: list[dict] = []
    size = 0
    for batch in batches:
        for r in batch.to_pylist():
            if size >= ARRAY_BYTES and r["anchor"] != rows[-1]["anchor"]:
                yield flush(rows)
                rows, size = [], 0
            rows.append(r)
            size += len(r["bytes"]) + 1
    yield flush(rows)


def _strings_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Single strings of regions as (doc, th, start, digest)."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            raw = r["bytes"]
            out += [(r["doc"], r["th"], r["start"] + k, hashlib.blake2b(raw[k : k + LENGTH], digest_size=16).digest()) for k in range(len(raw) - LENGTH + 1)]
        columns = list(zip(*out)) or [[], [], [], []]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc", "th", "start", "digest"])


def repeats(firsts: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """Repeated strings of distinct texts, as runs (doc, th, start, n) of string starts.

    ``firsts`` has (doc, th, text), a row for each distinct text: its least document and hash.
    ``texts`` has at least these rows; regions are cut from it without finding the firsts again.
    """
    found = firsts.select("doc", "th", "text").mapInArrow(_anchor_rows, ANCHOR)
    # One shuffle, of what tasks have combined, serves the count of places, the regions and their first places.
    same = Window.partitionBy("deal")
    me = F.struct("doc", "th", _start(F.col("place")).alias("start"))
    first = F.min(me).over(Window.partitionBy("deal", "region"))
    seen = found.withColumn("places", F.count("*").over(same)).filter("places > 1 or again").withColumn("first", first)
    seen = seen.withColumn("again", F.col("again") | (F.col("first") != me)).select("doc", "th", "anchor", "region", "place", "again")
    seen = scratch.cut(seen, "seen", release=True)
    whole = seen.filter("again").select("doc", "th", _start(F.col("place")).alias("start"), _count(F.col("place")).alias("n"))
    # Regions that occur first, of anchors with several regions.
    alone = seen.filter(~F.col("again")).drop("again").repartition("anchor").distinct()
    alone = alone.withColumn("regions", F.count("*").over(Window.partitionBy("anchor"))).filter("regions > 1")
    alone = scratch.cut(alone.select("doc", "th", "anchor", "regions", "place"), "regions")
    wanted = alone.groupBy("doc", "th").agg(F.collect_list(F.struct("anchor", "regions", "place")).alias("r"))
    raw = F.encode("text", "utf-8")

    def cut(r: Column) -> Column:
        start, n = _start(r["place"]), _count(r["place"])
        part = F.substring(F.col("raw"), (start + 1).cast("int"), (n + (LENGTH - 1)).cast("int"))
        return F.struct(r["anchor"].alias("anchor"), r["regions"].alias("regions"), start.alias("start"), _offset(r["place"]).alias("offset"), part.alias("bytes"))

    regions = texts.join(wanted, ["doc", "th"]).withColumn("raw", raw).select("doc", "th", F.inline(F.transform("r", cut)))
    regions = scratch.cut(regions, "bytes", release=True)
    few = regions.filter(F.col("regions") <= MOST_REGIONS)
    by_array = _by_array(few.select("anchor", "doc", "th", "start", "bytes"))
    many = regions.filter(F.col("regions") > MOST_REGIONS)
    if many.isEmpty():
        return whole.unionByName(by_array)
    return whole.unionByName(by_array).unionByName(_by_cells(many, scratch))


def _by_array(regions: DataFrame) -> DataFrame:
    """Runs of repeated strings among regions (anchor, doc, th, start, bytes), by suffix arrays."""
    return regions.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_sorted_repeats, REPEATS)


def _by_cells(regions: DataFrame, scratch: Scratch) -> DataFrame:
    """Runs of repeated strings among regions of anchors that have very many (step 4)."""
    at = F.struct("doc", "th", "start")
    cells = scratch.cut(cells_of(regions).withColumn("region", F.xxhash64("n", "bytes")), "cells")
    # Equal regions are counted where they are read, so a hot cell sends few rows.
    firsts = cells.groupBy("cell", "region").agg(F.min(at).alias("first"), F.count("*").alias("places"))
    firsts = scratch.cut(firsts, "cell-firsts")
    again = cells.join(firsts.filter("places > 1").select("cell", "region", "first"), ["cell", "region"]).filter(at != F.col("first"))
    shared = firsts.groupBy("cell").agg(F.count("*").alias("regions")).filter("regions > 1")
    alone = firsts.join(shared, "cell").select("cell", "regions", "first.*")
    alone = scratch.cut(cells.select("cell", "doc", "th", "start", "bytes").join(alone, ["cell", "doc", "th", "start"]), "cell-regions", release=True)
    few = alone.filter(F.col("regions") <= MOST_REGIONS).select(F.col("cell").alias("anchor"), "doc", "th", "start", "bytes")
    many = alone.filter(F.col("regions") > MOST_REGIONS).select("doc", "th", "start", "bytes")
    found = again.select("doc", "th", "start", "n").unionByName(_by_array(few))
    if many.isEmpty():
        return found
    strings = many.mapInArrow(_strings_of, "doc long, th long, start long, digest binary")
    least = strings.groupBy("digest").agg(F.min(at).alias("first"), F.count("*").alias("k")).filter("k > 1")
    taken = strings.join(least, "digest").filter(at != F.col("first")).select("doc", "th", "start", F.lit(1).cast("long").alias("n"))
    return found.unionByName(taken)


def _kept_column(text: Column, runs: Column) -> Column:
    """struct(kept binary, n_removed, n_spans) of a text without the bytes its runs cover."""
    kind = pa.struct([("kept", pa.binary()), ("n_removed", pa.int64()), ("n_spans", pa.int64())])

    def keep(texts: pa.Array, run_lists: pa.Array) -> pa.Array:
        out = []
        for t, rs in zip(texts.cast(pa.large_binary()), run_lists):
            raw, spans = t.as_py() or b"", []
            for s, e in sorted((r["start"], r["start"] + r["n"] + LENGTH - 1) for r in rs.as_py() or ()):
                if spans and s <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], e)
                else:
                    spans.append([s, e])
            parts, at = [], 0
            for s, e in spans:
                parts.append(raw[at:s])
                at = e
            out.append({"kept": b"".join([*parts, raw[at:]]), "n_removed": sum(e - s for s, e in spans), "n_spans": len(spans)})
        return pa.array(out, kind)

    return F.arrow_udf(keep, "struct<kept:binary,n_removed:bigint,n_spans:bigint>")(text, runs)


def remove_repeats(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, text, kept, n_removed, n_spans) for every row of ``docs`` (doc_id, text).

    ``kept`` has the bytes of the text that no LENGTH-byte string covers which starts earlier in
    the same document or in one with a smaller doc_id. Null counts as empty. Rows with equal
    doc_id and text are one document and share a result; rows that share only the id are
    documents in the order of their texts' hashes. A null id comes before all others.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select("doc_id", text.alias("text")).withColumns({
        "doc": F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long")),
        "th": F.xxhash64("text"),
        "copy": F.sha2("text", 256),
    })
    ids = scratch.cut(keyed.filter(F.octet_length("text") >= LENGTH).select("doc", "th", "copy"), "ids")
    first = ids.groupBy("copy").agg(F.min(F.struct("doc", "th")).alias("first"))
    copies = ids.join(scratch.cut(first, "firsts"), "copy").filter(F.struct("doc", "th") != F.col("first")).select("doc", "th").distinct()
    copies = scratch.cut(copies, "copies")
    texts = keyed.filter(F.octet_length("text") >= LENGTH).select("doc", "th", "text")
    runs = repeats(texts.join(copies, ["doc", "th"], "left_anti"), texts, scratch).groupBy("doc", "th").agg(F.collect_list(F.struct("start", "n")).alias("runs"))
    marks = scratch.cut(runs.unionByName(copies.withColumn("runs", F.lit(None).cast("array<struct<start:bigint,n:bigint>>"))), "runs", release=True)
    marked = keyed.drop("copy").join(marks.withColumn("marked", F.lit(True)), ["doc", "th"], "left")
    everything = F.array(F.struct(F.lit(0).cast("long").alias("start"), (F.octet_length("text") - (LENGTH - 1)).cast("long").alias("n")))
    whole = F.col("marked") & F.col("runs").isNull()
    cleaned = marked.withColumn("_k", _kept_column(F.col("text"), F.when(whole, everything).otherwise(F.col("runs"))))
    return cleaned.select("doc_id", "text", *[F.col(f"_k.{c}").alias(c) for c in ("kept", "n_removed", "n_spans")])


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 8 over all of ``documents``."""
    found = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), Scratch(spark, "suffix-dedup"))
    return found.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op8_suffix_dedup": op8_suffix_dedup}
ORACLES: dict[str, str] = {}
