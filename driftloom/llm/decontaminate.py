"""Benchmark decontamination (operator 6).

Method: training suffix arrays. Spark's tasks are the shards: a task sorts the word suffixes of
the training texts it has into suffix arrays and binary-searches every test suffix in them. The
search yields the longest verbatim match of each test suffix and where it lies; suffixes that
match a whole window lead to all its occurrences. ``longest_matches`` merges the shards' matches,
and affected documents are marked and removed.

Words are compared by a 64-bit hash while sorting and searching. Every occurrence and every match
that counts is then compared byte by byte, so a collision can't mark a word.

The test side is cut in Spark into pieces that share all but the first words of a window, and sent
to the tasks in blocks of about ``BLOCK_WORDS`` words. Each block has its own pass over the training
texts, written before the next block is read; then its broadcast is destroyed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftloom.llm.shared import Scratch, free_name, table

WINDOW = 10
#: Words of the test side in one broadcast (about 60 MB with its windows); training words in one suffix array.
BLOCK_WORDS, SHARD_WORDS = 150_000, 750_000
#: Bytes that are cut into words at once; longer texts are cut in steps that end between words.
SLAB_BYTES = 4 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
# Word bytes after lowering A-Z: 0-9, a-z and every byte of a non-ASCII character.
_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[128:] = True
_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.r_[np.uint64(1), np.full(n, base, np.uint64)])


_POWERS: list[np.ndarray] = []


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _words_of_slab(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of the words of lowered bytes."""
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = _IS_WORD[raw]
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not _POWERS or len(_POWERS[0]) < len(raw) + 1:
        n = max(len(raw), 1 << 16)
        _POWERS[:] = [_powers(_MULTIPLIER, n), _powers(_INVERSE, n)]
    up, down = _POWERS
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    # 0 is kept for the end of a text.
    return starts, ends, _mixed(h ^ (ends - starts).astype(np.uint64)) | np.uint64(1)


def words_of(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lowered bytes of a text, and start, end and hash of its words."""
    low = _LOWER[np.frombuffer(raw, np.uint8)]
    if len(low) <= SLAB_BYTES:
        return (low, *_words_of_slab(low))
    parts, at = [], 0
    while at < len(low):
        end = min(at + SLAB_BYTES, len(low))
        if end < len(low):
            gaps = np.flatnonzero(~_IS_WORD[low[at:end]])
            while not len(gaps) and end < len(low):  # one word longer than a slab
                end = min(end + SLAB_BYTES, len(low))
                gaps = np.flatnonzero(~_IS_WORD[low[at:end]])
            if end < len(low):
                end = at + int(gaps[-1]) + 1
        s, e, h = _words_of_slab(low[at:end])
        parts.append((s + at, e + at, h))
        at = end
    return (low, *map(np.concatenate, zip(*parts)))


def suffix_array(words: np.ndarray, depth: int) -> np.ndarray:
    """Starts of the suffixes of ``words``, sorted by their first ``depth`` words or more.

    Prefix doubling: ranks by one word, then by two, four and so on. A step sorts only suffixes
    that some other still equals.
    """
    n = len(words)
    _, first = np.unique(words, return_inverse=True)
    order = np.argsort(first, kind="stable")
    # A rank is the place of the first suffix that is equal so far, so that other ranks stay.
    own = first[order]
    head = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if n else np.empty(0, np.int64)
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(head, np.diff(np.r_[head, n]))
    slots = np.flatnonzero(np.repeat(np.diff(np.r_[head, n]) > 1, np.diff(np.r_[head, n])))
    length = 1
    while length < depth and len(slots):
        some = order[slots]
        second = np.zeros(len(some), np.int64)
        inside = some + length < n
        second[inside] = rank[some[inside] + length] + 1
        key = rank[some] * (n + 1) + second
        by = np.argsort(key, kind="stable")
        some, key = some[by], key[by]
        order[slots] = some
        new = np.r_[True, key[1:] != key[:-1]]
        head = np.flatnonzero(new)
        sizes = np.diff(np.r_[head, len(some)])
        rank[some] = np.repeat(slots[head], sizes)
        slots = slots[np.repeat(sizes > 1, sizes)]
        length *= 2
    return order


def _search(words: np.ndarray, order: np.ndarray, others: np.ndarray, starts: np.ndarray, lengths: np.ndarray, after: bool) -> np.ndarray:
    """For each sequence ``others[start : start + length]``, the first suffix not below (``after``: above) it.

    All sequences are searched at once; a step compares word by word, as far as they still agree.
    """
    low, high = np.zeros(len(starts), np.int64), np.full(len(starts), len(order), np.int64)
    while (open_ := np.flatnonzero(low < high)).size:
        mid = (low[open_] + high[open_]) // 2
        at = order[mid]
        sign = np.zeros(len(open_), np.int8)  # of the suffix against the sequence
        same, k = np.arange(len(open_)), 0
        while (same := same[lengths[open_[same]] > k]).size:
            place = at[same] + k
            word = np.where(place < len(words), words[np.minimum(place, len(words) - 1)], 0)
            want = others[starts[open_[same]] + k]
            sign[same] = np.where(word < want, -1, np.where(word > want, 1, 0))
            same = same[word == want]
            k += 1
        below = sign <= 0 if after else sign < 0
        low[open_[below]] = mid[below] + 1
        high[open_[~below]] = mid[~below]
    return low


def longest_common(words: np.ndarray, order: np.ndarray, others: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Longest match in ``words`` of the first words of each sequence, and its place, or -1.

    The longest common prefix with a sorted suffix array is with a neighbour of the place where
    the sequence would be inserted.
    """
    at = _search(words, order, others, starts, lengths, after=False)
    best, place = np.zeros(len(starts), np.int64), np.full(len(starts), -1, np.int64)
    for shift in (0, -1):
        near = at + shift
        some = np.flatnonzero((near >= 0) & (near < len(order)))
        own = order[near[some]]
        n, same, k = np.zeros(len(some), np.int64), np.arange(len(some)), 0
        while (same := same[(lengths[some[same]] > k) & (own[same] + k < len(words))]).size:
            same = same[words[own[same] + k] == others[starts[some[same]] + k]]
            n[same] += 1
            k += 1
        better = n > best[some]
        best[some[better]], place[some[better]] = n[better], own[better]
    return best, place


def match_lengths(words: np.ndarray, order: np.ndarray, tests: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``longest_common`` of the rows of a table of words, each of its own length."""
    return longest_common(words, order, tests.ravel(), np.arange(len(tests)) * tests.shape[1], lengths)


@dataclass
class TestBlock:
    """A block of test items as one array of word hashes, and their windows.

    ``words`` ends each item with a 0; ``left`` has the words from each place to its item's end.
    ``places`` has a place of each distinct window, ``lengths`` its words, ``joined`` its bytes,
    ``items`` the items it is in.
    """

    words: np.ndarray
    left: np.ndarray
    owner: np.ndarray
    begin: np.ndarray
    spelled: list[bytes]
    places: np.ndarray
    lengths: np.ndarray
    joined: list[bytes]
    items: list[list[int]]
    names: list[str]
    shift: list[int]


def test_block(items: list[tuple], window: int = WINDOW) -> TestBlock:
    """Block of (id as text, text[, words before it in its item]); equal windows are one, with all their items."""
    found: dict[bytes, list[int]] = {}
    where: dict[bytes, tuple[int, int]] = {}
    words, left, owner, begin, spelled, at = [], [], [], [], [], 0
    for k, item in enumerate(items):
        low, s, e, h = words_of((item[1] or "").encode())
        told = [low[a:b].tobytes() for a, b in zip(s, e)]
        n = min(window, len(h))
        for i in range(len(h) - n + 1 if n else 0):
            joined = b" ".join(told[i : i + n])
            mine = found.setdefault(joined, [])
            where.setdefault(joined, (at + i, n))
            if not mine or mine[-1] != k:
                mine.append(k)
        words.append(np.r_[h, np.uint64(0)])
        left.append(np.arange(len(h), -1, -1))
        owner.append(np.full(len(h) + 1, k))
        begin.append(at)
        spelled += [*told, b""]
        at += len(h) + 1
    join = lambda parts, kind: np.concatenate(parts) if parts else np.empty(0, kind)
    return TestBlock(
        join(words, np.uint64), join(left, np.int64), join(owner, np.int64), np.array(begin, np.int64), spelled,
        np.array([where[j][0] for j in found], np.int64), np.array([where[j][1] for j in found], np.int64),
        list(found), list(found.values()), [x[0] for x in items], [x[2] if len(x) > 2 else 0 for x in items],
    )


MATCH = "struct<length:bigint,first:bigint,item:string,start:bigint>"
RESULT = f"struct<n_words:bigint,spans:array<struct<first:bigint,last:bigint>>,items:array<string>,matches:array<{MATCH}>>"


def _shard_hits(texts: list, block: TestBlock, window: int = WINDOW) -> Iterator[tuple[int, list[tuple[int, int]], set[int], list[tuple]]]:
    """(n_words, spans, items, matches) of each text of one shard.

    A span is the first and last word of a run of hit words; an item is an index of the block. A
    match (length, first word, item, word of the item) is the shard's longest of a test suffix
    that holds a window, where it lies in this text; those that go on from one before are left out.
    """
    sizes = [len(t[3]) for t in texts]
    starts = np.cumsum([0, *[n + 1 for n in sizes]])
    words = np.zeros(starts[-1], np.uint64)
    for at, t in zip(starts, texts):
        words[at : at + len(t[3])] = t[3]
    hits: dict[int, list[tuple[int, int]]] = {}
    items: dict[int, set[int]] = {}
    matches: dict[int, list[tuple]] = {}

    def spelled(owner: int, first: int, n: int) -> list[bytes]:
        raw, s, e, _ = texts[owner]
        return [raw[a:b].tobytes() for a, b in zip(s[first : first + n], e[first : first + n])]

    if len(block.places):
        # Every test suffix is searched; the order is as deep as the longest of them.
        order = suffix_array(words, int(block.left.max()))
        suffixes = np.flatnonzero(block.left > 0)
        best, place = longest_common(words, order, block.words, suffixes, block.left[suffixes])
        long_ = np.zeros(len(block.words), np.int64)
        long_[suffixes] = best
        there = np.flatnonzero(long_[block.places] >= block.lengths)
        at, length = block.places[there], block.lengths[there]
        low = _search(words, order, block.words, at, length, after=False)
        high = _search(words, order, block.words, at, length, after=True)
        for r, a, b, n in zip(there.tolist(), low.tolist(), high.tolist(), length.tolist()):
            places = order[a:b]
            owners = np.searchsorted(starts, places, side="right") - 1
            for owner, first in zip(owners.tolist(), (places - starts[owners]).tolist()):
                if b" ".join(spelled(owner, first, n)) == block.joined[r]:
                    hits.setdefault(owner, []).append((first, first + n - 1))
                    items.setdefault(owner, set()).update(block.items[r])
        enough = best >= np.minimum(window, block.left[block.begin[block.owner[suffixes]]])
        goes_on = np.r_[False, (suffixes[1:] == suffixes[:-1] + 1) & (place[1:] == place[:-1] + 1) & enough[:-1]]
        for k in np.flatnonzero(enough & ~goes_on).tolist():
            owner = int(np.searchsorted(starts, place[k], side="right")) - 1
            first, suffix, item = int(place[k] - starts[owner]), int(suffixes[k]), int(block.owner[suffixes[k]])
            own, test = spelled(owner, first, int(best[k])), block.spelled[suffix : suffix + int(best[k])]
            n = next((i for i, (x, y) in enumerate(zip(own, test)) if x != y), len(own))
            matches.setdefault(owner, []).append((n, first, item, suffix - int(block.begin[item]) + block.shift[item]))
    for k, n in enumerate(sizes):
        spans: list[tuple[int, int]] = []
        for first, last in sorted(hits.get(k, ())):
            if spans and first <= spans[-1][1] + 1:
                spans[-1] = (spans[-1][0], max(spans[-1][1], last))
            else:
                spans.append((first, last))
        yield n, spans, items.get(k, set()), matches.get(k, [])


def hits_column(text: Column, block, window: int = WINDOW) -> Column:
    """``RESULT`` of each whole text against a broadcast test block."""

    def find(texts: pa.Array) -> pa.Array:
        out, shard, words = [], [], 0
        names = block.value.names

        def flush():
            for n, spans, items, matches in _shard_hits(shard, block.value, window):
                told = [{"length": a, "first": b, "item": names[c], "start": d} for a, b, c, d in matches]
                out.append({"n_words": n, "spans": [{"first": a, "last": b} for a, b in spans], "items": sorted({names[i] for i in items if names[i] is not None}), "matches": told})
            shard.clear()

        for t in texts.cast(pa.large_binary()):
            shard.append(words_of(t.as_py() or b""))
            words += len(shard[-1][3])
            if words >= SHARD_WORDS:
                flush()
                words = 0
        flush()
        span = pa.struct([("first", pa.int64()), ("last", pa.int64())])
        match = pa.struct([("length", pa.int64()), ("first", pa.int64()), ("item", pa.string()), ("start", pa.int64())])
        return pa.array(out, pa.struct([("n_words", pa.int64()), ("spans", pa.list_(span)), ("items", pa.list_(pa.string())), ("matches", pa.list_(match))]))

    return F.arrow_udf(find, RESULT)(text)


def _pieces(window: int, most: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item_id, text, shift, n) of items cut into pieces of ``most`` words, which share ``window`` - 1 words."""
    for batch in batches:
        out: list[tuple] = []
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            low, s, e, h = words_of((text or "").encode())
            for at in range(0, max(1, len(h) - window + 1), most):
                end = min(len(h), at + most + window - 1)
                out.append((item, low[s[at] : e[end - 1]].tobytes().decode() if end > at else "", at, end - at))
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [[]] * 4, kinds)], ["item_id", "text", "shift", "n"])


def _blocks(spark: SparkSession, benchmark: DataFrame, scratch: Scratch, window: int) -> tuple[int, Iterator[TestBlock]]:
    """How many blocks of bounded size the test side has, and the blocks, read one after the other."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    cut = items.mapInArrow(partial(_pieces, window, BLOCK_WORDS), "item_id string, text string, shift long, n long")
    cut = scratch.cut(cut, "tests")
    parts = max(1, -(-(cut.agg(F.sum("n")).first()[0] or 0) // BLOCK_WORDS))
    part = F.pmod(F.xxhash64("item_id", "text", "shift"), F.lit(parts))

    def read() -> Iterator[TestBlock]:
        for k in range(parts):
            rows = cut.filter(part == k).select("item_id", "text", "shift").collect()  # about BLOCK_WORDS words
            yield test_block(sorted(map(tuple, rows), key=str), window)

    return parts, read()


def with_hits(docs: DataFrame, benchmark: DataFrame, scratch: Scratch, text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Add ``n_words``, ``hit_spans``, ``hit_items`` (sorted as strings) and ``matches`` to each document.

    A word is hit if it lies in any occurrence of a window: ``window`` consecutive words of an
    item, or all words of a shorter item. Null and blank texts and items have no words, so an
    empty benchmark hits nothing. An item with a null id hits but is not listed; items that
    share an id are one. ``matches`` has the longest match of each test suffix that holds a window,
    at one place of each shard. Columns with these names are replaced.
    """
    spark, hits = docs.sparkSession, free_name(docs, "hits")
    parts, blocks = _blocks(spark, benchmark, scratch, window)
    if parts == 1:
        docs = docs.withColumn(hits, hits_column(F.col(text_col), spark.sparkContext.broadcast(next(blocks)), window))
    else:
        docs = _hits_of_blocks(docs, blocks, scratch, text_col, window, hits)
    names = {"n_words": "n_words", "hit_spans": "spans", "hit_items": "items", "matches": "matches"}
    return docs.withColumns({n: F.col(hits)[f] for n, f in names.items()}).drop(hits)


def _hits_of_blocks(docs: DataFrame, blocks: Iterator[TestBlock], scratch: Scratch, text_col: str, window: int, hits: str) -> DataFrame:
    """Add ``RESULT`` over several blocks, of which one is broadcast at a time.

    Texts are written once, with a number for each row; a block writes the hits of the rows that it
    hits, and these are put together by row.
    """
    row = free_name(docs, "row")
    rows = scratch.cut(docs.withColumn(row, F.monotonically_increasing_id()), "rows", release=True)
    found = None
    for k, block in enumerate(blocks):
        sent = docs.sparkSession.sparkContext.broadcast(block)
        hit = rows.select(F.col(row).alias("row"), hits_column(F.col(text_col), sent, window).alias("h")).select("row", "h.*")
        if k:  # the first block tells how many words each text has
            hit = hit.filter((F.size("spans") > 0) | (F.size("matches") > 0))
        hit = scratch.cut(hit, f"hits-{k}")
        sent.destroy()
        found = hit if found is None else found.unionByName(hit)
    all_ = lambda c: F.flatten(F.collect_list(c))
    whole = F.struct(
        F.max("n_words").alias("n_words"), F.array_sort(all_("spans")).alias("spans"), F.array_sort(F.array_distinct(all_("items"))).alias("items"), all_("matches").alias("matches"),
    )
    merged = found.groupBy(F.col("row").alias(row)).agg(whole.alias(hits))
    return rows.join(merged, row).drop(row)


def longest_matches(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """(item, start, length, key, first): the longest verbatim match of each test suffix over all shards.

    ``found`` comes from ``with_hits``. Suffixes whose match goes on from the one before are part of
    it; of equally long matches the one with the least key and place stays. Matches of an item's pieces
    that lie side by side in one document, as those on both sides of a cut, are one.
    """
    each = found.select(F.col(key).alias("key"), F.inline("matches")).filter("item is not null")
    side = Window.partitionBy("item", "key", F.col("first") - F.col("start")).orderBy("start")
    reach = F.max(F.col("start") + F.col("length")).over(side.rowsBetween(Window.unboundedPreceding, -1))
    apart = each.withColumn("run", F.sum(F.when(F.col("start") <= reach, 0).otherwise(1)).over(side))
    runs = apart.groupBy("item", "key", (F.col("first") - F.col("start")).alias("side"), "run").agg(
        F.min("start").alias("start"), F.min("first").alias("first"), F.max(F.col("start") + F.col("length")).alias("end")
    )
    best = F.min(F.struct((F.col("start") - F.col("end")).alias("short"), "key", "first")).alias("m")
    return runs.groupBy("item", "start").agg(best).select("item", "start", (-F.col("m.short")).alias("length"), F.col("m.key").alias(key), F.col("m.first").alias("first"))


def n_hit() -> Column:
    """Words in the union of ``hit_spans``, which are sorted and may overlap between blocks."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("to"))
    step = lambda a, s: F.struct(
        (a["n"] + F.greatest(F.lit(0).cast("long"), s["last"] - F.greatest(s["first"] - 1, a["to"]))).alias("n"),
        F.greatest(a["to"], s["last"]).alias("to"),
    )
    return F.aggregate("hit_spans", start, step, lambda a: a["n"])


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, scratch: Scratch, text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Rows of ``docs`` in which no test window occurs, with the same columns."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    marked = with_hits(docs.select(row, F.col(text_col).alias("searched")), benchmark, scratch, "searched", window)
    return marked.filter(F.size("hit_spans") == 0).select("row.*")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 6 over all of ``documents`` and ``benchmark``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = with_hits(docs, table(spark, sf_dir, "benchmark"), Scratch(spark, "decontaminate")).withColumn("n_hit", n_hit())
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        F.array_max(F.transform("hit_spans", lambda s: s["last"] - s["first"] + 1)).alias("longest_hit_run"),
    )


QUERIES = {"op6_decontaminate": op6_decontaminate}
ORACLES: dict[str, str] = {}
