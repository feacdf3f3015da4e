"""BPE encoding and decoding (operator 2).

Method: a binary segment tree over the ranks of adjacent pairs. The root holds the lowest rank
and, among equal ranks, the leftmost pair; a merge updates at most three leaves and their
ancestors, and encoding ends when the root holds no mergeable pair. Each piece of two or more
symbols has its tree; the trees of many new pieces lie in one array and advance together.

Vocabulary and merges come from a tokenizer file whose path is a parameter; nothing is trained.
"""

from __future__ import annotations

import json
import re
from array import array
from bisect import bisect
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.llm.shared import table

# Fixed values of byte-level BPE: the pattern that cuts a text into pieces.
PIECES = (
    r"'s|'t|'re|'ve|'m|'ll|'d"
    r"| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
# The same pattern for texts below U+0250, with the classes spelled out for the faster re module.
_LETTER, _DIGIT, _GAP = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
LATIN_PIECES = (
    rf"'(?:[stmd]|re|ve|ll)"
    rf"| ?[{_LETTER}]+| ?[{_DIGIT}]+| ?[^{_GAP}{_LETTER}{_DIGIT}]+"
    rf"|[{_GAP}]+(?![^{_GAP}])|[{_GAP}]+"
)
BEYOND_LATIN = re.compile("[^\x00-\u024f]")
#: Cached pieces of one worker; a piece over LONG_PIECE characters is not cached.
CACHE_PIECES, LONG_PIECE = 300_000, 64
#: Pieces that are cut before their new ones are merged together; a longer text is cut in parts.
CHUNK_PIECES = 100_000
#: New pieces that share one array of trees; pieces over LONG_PIECE characters have a tree each.
MANY = 4_000


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies.

    Bytes that print as themselves in Latin-1 keep their character; the others take, in order,
    the characters from 256 on.
    """
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    other = iter(range(256, 512))
    return [chr(b if b in printable else next(other)) for b in range(256)]


_AT = (1 << 32) - 1
_NONE = 1 << 62


def merge_pairs(ids: list[int], pair_rank: dict[int, int], merged: list[int], base: int) -> list[int]:
    """Merge one sequence of symbols until no adjacent pair has a rank.

    ``tree`` is a binary segment tree: leaf ``m + i`` holds ``rank << 32 | i`` of the pair at place
    i, a node the least of its two children, so the root is the leftmost pair of the lowest rank.
    """
    n, rank_of = len(ids), pair_rank.get
    m = n - 1
    ranks = [rank_of(a * base + b, -1) for a, b in zip(ids, islice(ids, 1, None))]
    tree = [_NONE] * m + [r << 32 | i if r >= 0 else _NONE for i, r in enumerate(ranks)]
    for x in range(m - 1, 0, -1):
        tree[x] = min(tree[2 * x], tree[2 * x + 1])
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def put(leaf: int, rank: int) -> None:
        x, value = m + leaf, rank << 32 | leaf if rank >= 0 else _NONE
        while tree[x] != value:
            tree[x] = value
            if x == 1:
                return
            value = min(value, tree[x ^ 1])
            x >>= 1

    while (best := tree[1]) < _NONE:
        i = best & _AT
        ids[i] = symbol = merged[best >> 32]
        j = after[i]
        k = after[i] = after[j]
        ids[j] = -1
        if j < m:
            put(j, -1)
        if k < n:
            before[k] = i
        put(i, rank_of(symbol * base + ids[k], -1) if k < n else -1)
        if (p := before[i]) >= 0:
            put(p, rank_of(ids[p] * base + symbol, -1))
    return [x for x in ids if x >= 0]


class PairRanks:
    """Ranks of symbol pairs and the merged symbols, looked up for many pairs at once."""

    def __init__(self, pair_rank: dict[int, int], merged: list[int], base: int):
        keys = np.array(sorted(pair_rank), np.int64)
        self.keys = np.r_[keys, np.iinfo(np.int64).max]
        self.ranks = np.array([*map(pair_rank.get, keys.tolist()), 0], np.int64)
        self.merged, self.base = np.array([*merged, 0], np.int64), base

    def values(self, left: np.ndarray, right: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Leaves of the pairs: ``rank << 32 | place``, or none."""
        key = left * self.base + right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at] << 32 | place, _NONE)


def merge_many(flat: np.ndarray, sizes: np.ndarray, pairs: PairRanks) -> tuple[np.ndarray, np.ndarray]:
    """``merge_pairs`` of many sequences at once: a segment tree for each, one array for all trees.

    Sequences come, and their results go, one after the other in ``flat`` with their sizes. A step takes the root of every tree that still has a mergeable pair, merges there, and updates
    the three leaves that change, level by level.
    """
    count = len(sizes)
    width = 1 << max(0, int(sizes.max() - 2).bit_length())  # leaves of a tree
    wide = width + 3  # symbols of a row, with an end mark on both sides
    ids = np.full((count, wide), -1, np.int64)
    ids[:, 1:][np.arange(wide - 1) < sizes[:, None]] = flat
    tree = np.full((count, 2 * width), _NONE, np.int64)
    i, j = np.nonzero(np.arange(width) < (sizes - 1)[:, None])
    tree[i, width + j] = pairs.values(ids[i, j + 1], ids[i, j + 2], j)
    for level in range(width.bit_length() - 2, -1, -1):
        at = 1 << level
        np.minimum(tree[:, 2 * at : 4 * at : 2], tree[:, 2 * at + 1 : 4 * at : 2], out=tree[:, at : 2 * at])
    after = np.tile(np.arange(1, wide + 1), (count, 1))
    before = np.tile(np.arange(-1, wide - 1), (count, 1))
    ids, tree, after, before = ids.ravel(), tree.ravel(), after.ravel(), before.ravel()
    steps = width.bit_length() - 1

    def put(row: np.ndarray, leaf: np.ndarray, value: np.ndarray) -> None:
        top, x = row * (2 * width), leaf + width
        tree[top + x] = value
        for _ in range(steps):
            value = np.minimum(value, tree[top + (x ^ 1)])
            x = x >> 1
            tree[top + x] = value

    row = np.arange(count)
    while True:
        best = tree[row * (2 * width) + 1]
        row, best = row[best < _NONE], best[best < _NONE]
        if not len(row):
            break
        place = best & _AT
        at, top = row * wide, row * (2 * width)
        i = at + place + 1  # symbols are one place further than pairs, as a mark is before them
        symbol = pairs.merged[best >> 32]
        j = at + after[i]
        k = at + after[j]
        after[i], before[k], ids[i], ids[j] = after[j], place + 1, symbol, -1
        gone = j - at - 1
        inside = gone < width
        put(row[inside], gone[inside], np.full(int(inside.sum()), _NONE))
        # A mark is no symbol: its pair has a key below all others.
        put(row, place, np.where(ids[k] < 0, _NONE, pairs.values(symbol, ids[k], place)))
        p = at + before[i]
        has = ids[p] >= 0
        put(row[has], (p - at - 1)[has], pairs.values(ids[p[has]], symbol[has], (p - at - 1)[has]))
    ids = ids.reshape(count, wide)
    kept = ids >= 0
    return ids[kept].astype(np.int32), kept.sum(axis=1)


class ByteBpe(dict):
    """Encoder and decoder of one tokenizer file; as a dict, the cache of encoded pieces."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"]
        if pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or spec["normalizer"]:
            raise ValueError("only byte-level BPE without normalizer and prefix space")
        chars, vocab = byte_chars(), spec["model"]["vocab"]
        self.base = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.byte_ids = [vocab[c] for c in chars]
        self.pair_rank, self.merged = {}, []
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.pair_rank.setdefault(vocab[a] * self.base + vocab[b], rank)
            self.merged.append(vocab[a + b])
        self.byte_symbols = np.array(self.byte_ids, np.int64)
        self.pairs = PairRanks(self.pair_rank, self.merged, self.base)
        byte_of = {c: bytes([b]) for b, c in enumerate(chars)}
        self.token_bytes = [b""] * self.base
        for token, i in vocab.items():
            self.token_bytes[i] = b"".join(byte_of[c] for c in token)
        self.added = {}
        for t in spec["added_tokens"]:
            if t["lstrip"] or t["rstrip"] or t["single_word"]:
                raise ValueError(f"added token {t['content']!r} has options that are not supported")
            self.added[t["content"]] = t["id"]
            self.token_bytes[t["id"]] = t["content"].encode()
        longest_first = sorted(self.added, key=len, reverse=True)
        self.cut_added = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")") if self.added else None
        self.pieces, self.latin_pieces = regex.compile(PIECES), re.compile(LATIN_PIECES)

    def __missing__(self, piece: str | bytes) -> bytes:
        """Packed ids of what the cache does not keep: a long piece; an added token comes packed."""
        if isinstance(piece, bytes):
            return piece
        ids = [self.byte_ids[b] for b in piece.encode()]
        return array("i", merge_pairs(ids, self.pair_rank, self.merged, self.base) if len(ids) > 1 else ids).tobytes()

    def learn(self, pieces: Iterable[str]) -> None:
        """Keep the packed ids of new pieces, merged many at a time."""
        rows = sorted(((p.encode(), p) for p in pieces), key=lambda r: len(r[0]))
        short = bisect(rows, 1, key=lambda r: len(r[0]))
        for raw, piece in rows[:short]:
            self[piece] = array("i", [self.byte_ids[b] for b in raw]).tobytes()
        for k in range(short, len(rows), MANY):
            part = rows[k : k + MANY]
            symbols = self.byte_symbols[np.frombuffer(b"".join([raw for raw, _ in part]), np.uint8)]
            flat, counts = merge_many(symbols, np.array([len(raw) for raw, _ in part]), self.pairs)
            packed, at = flat.tobytes(), 0
            for (_, piece), end in zip(part, (4 * np.cumsum(counts)).tolist()):
                self[piece], at = packed[at:end], end

    def _pieces(self, text: str) -> Iterator[Iterator[str | bytes]]:
        """The pieces of a text in order, in runs; an added token comes as its packed id."""
        for part in self.cut_added.split(text) if self.cut_added else [text]:
            if part in self.added:
                yield iter([array("i", [self.added[part]]).tobytes()])
            elif part:
                cut = self.pieces if BEYOND_LATIN.search(part) else self.latin_pieces
                yield iter(cut.findall(part)) if len(part) <= CHUNK_PIECES else (m.group() for m in cut.finditer(part))

    def encode_all(self, texts: Iterable[str]) -> list[np.ndarray]:
        """Ids of each text. New pieces of many texts, or of a part of a long one, are merged together."""
        out: list[list[bytes]] = []
        held: list[tuple[list[bytes], list]] = []
        size = 0

        def flush() -> None:
            new = set().union(*[pieces for _, pieces in held])
            missing = new.difference(self)
            if len(self) + len(missing) > CACHE_PIECES:
                self.clear()
                missing = new
            self.learn(p for p in missing if isinstance(p, str) and len(p) <= LONG_PIECE)
            for own, pieces in held:
                own.append(b"".join(map(self.__getitem__, pieces)))
            held.clear()

        for text in texts:
            out.append([])
            stream = chain.from_iterable(self._pieces(text))
            while pieces := list(islice(stream, CHUNK_PIECES)):
                held.append((out[-1], pieces))
                size += len(pieces)
                if size >= CHUNK_PIECES:
                    flush()
                    size = 0
        flush()
        return [np.frombuffer(b"".join(own), dtype=np.int32) for own in out]

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", "replace")


_LOADED: dict[str, ByteBpe] = {}


def _codec(path: str) -> ByteBpe:
    if path not in _LOADED:
        _LOADED[path] = ByteBpe(path)
    return _LOADED[path]


def encode_column(text: Column, path: str) -> Column:
    """Token ids of a text as ``array<int>``; a null text counts as empty."""

    def encode(texts: pa.Array) -> pa.Array:
        codec = _codec(path)
        ids = codec.encode_all(t.as_py() or "" for t in texts)
        ends = np.cumsum([0, *map(len, ids)])
        values = np.concatenate(ids) if ids else np.empty(0, np.int32)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()))

    return F.arrow_udf(encode, "array<int>")(text)


def decode_column(ids: Column, path: str) -> Column:
    """Text of an array of token ids, special tokens included; null ids give null."""

    def decode(rows: pa.Array) -> pa.Array:
        codec = _codec(path)
        return pa.array([None if not r.is_valid else codec.decode(r.values.to_numpy().tolist()) for r in rows], pa.string())

    return F.arrow_udf(decode, "string")(ids)


def encode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """Add the token ids of each whole text.

    Null and empty texts get an empty array. Every row is encoded by itself, so ties, repeated
    rows and an empty table need no rule. An input column named ``ids_col`` is replaced.
    """
    return docs.withColumn(ids_col, encode_column(F.col(text_col), path))


def decode(docs: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """Add the text of each row's token ids; null ids give null. ``text_col`` is replaced if there."""
    return docs.withColumn(text_col, decode_column(F.col(ids_col), path))


def tokenized(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """Add ``ids``, ``n_tokens`` and ``round_trip`` (decoding the ids gives the text; a null text
    counts as empty). Columns with these names are replaced."""
    coded = encode(docs, path, text_col).withColumn("n_tokens", F.size("ids").cast("long"))
    same = decode_column(F.col("ids"), path) == F.coalesce(F.col(text_col), F.lit(""))
    return coded.withColumn("round_trip", same)


def tokenizer_path() -> str:
    """The public byte-level vocabulary that the query uses."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Encode and decode ``text`` and digest both."""
    coded = decode(encode(docs, path), path)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 2 over all of ``documents``."""
    return digests(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())


QUERIES = {"op2_bpe": op2_bpe}
ORACLES: dict[str, str] = {}
