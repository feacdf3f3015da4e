"""Language identification (operator 1).

Method: averaged hashed subword embeddings with a linear softmax, trained by stochastic gradient
descent in numpy, with calibrated rejection. A text is the mean embedding of the subwords (letter
n-grams with word borders, and whole words) of its words; a temperature fitted on held-back rows
calibrates the probability, and a limit found there marks predictions to reject.

As both steps are linear, a subword's embedding is turned into its label scores once and a word's
scores are the sum over its subwords, so prediction adds rows of a small table.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.llm.shared import free_name, table

#: Slots of hashed subwords, width of embeddings, letters of an n-gram.
SLOTS, WIDTH, NGRAMS = 1 << 15, 16, (2, 3)
#: Labelled rows of a language that are learned from (about), and bytes of text of all of them at most (about).
SAMPLE_ROWS, SAMPLE_BYTES = 600, 16 << 20
PASSES, BATCH, STEP = 6, 16, 0.3
#: Share of accepted held-back rows that must be right.
WANTED_ACCURACY = 0.99
UNKNOWN = "und"
CACHED_WORDS, CACHED_GRAMS, LONG_WORD = 600_000, 200_000, 40

_WORD = regex.compile(r"\p{L}+")


class _Slots(dict):
    """Slots of subwords seen so far."""

    def __missing__(self, gram: str) -> int:
        if len(self) >= CACHED_GRAMS:
            self.clear()
        slot = self[gram] = zlib.crc32(gram.encode()) % SLOTS
        return slot


_SLOTS = _Slots()


def slots_of(word: str) -> list[int]:
    """Slots of a word's subwords."""
    marked = f"<{word}>"
    grams = [marked[i : i + n] for n in NGRAMS for i in range(len(marked) - n + 1)]
    return [*map(_SLOTS.__getitem__, grams), zlib.crc32(f"={word}".encode()) % SLOTS]


def words_of(text: str):
    """Words of a text in lower case, one after the other."""
    return (m.group() for m in _WORD.finditer(text.lower()))


@dataclass
class Model:
    """Label names, label scores of each slot, bias, temperature and the limit of acceptance."""

    labels: list[str]
    scores: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    limit: float = 0.0

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        p = np.exp(z - z.max(axis=-1, keepdims=True))
        return p / p.sum(axis=-1, keepdims=True)


def _matrix(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(slots, weights) of each text; weights sum to 1."""
    out, seen = [], {}
    for t in texts:
        slots = []
        for w in words_of(t):
            if w not in seen:
                seen[w] = slots_of(w)
            slots += seen[w]
        found, n = np.unique(np.array(slots, np.int64), return_counts=True)
        out.append((found, n / max(1, len(slots))))
    return out


def train(rows: list[tuple[str, str]], seed: int = 7) -> Model:
    """Learn from (text, label) rows; a fifth of them is held back for calibration.

    No rows give a model without labels. The result depends on the rows, not on their order; equal
    scores go to the label that is first by name.
    """
    rows = sorted(r for r in rows if _WORD.search(r[0]))
    labels = sorted({y for _, y in rows})
    if not labels:
        return Model([], np.zeros((SLOTS, 0)), np.zeros(0))
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    rows = [rows[i] for i in order]
    data, y = _matrix([t for t, _ in rows]), np.array([labels.index(x) for _, x in rows])
    held = np.arange(len(rows)) % 5 == 0 if len(rows) >= 50 else np.zeros(len(rows), bool)
    embed = rng.uniform(-0.5, 0.5, (SLOTS, WIDTH)) / WIDTH
    out, bias = np.zeros((WIDTH, len(labels))), np.zeros(len(labels))
    slot_sum, out_sum = np.zeros(SLOTS), np.zeros_like(out)
    fit = np.flatnonzero(~held)
    for k in range(PASSES):
        step = STEP * (1 - k / PASSES)
        for at in range(0, len(fit), BATCH):
            part = fit[at : at + BATCH]
            slots = np.concatenate([data[i][0] for i in part])
            weight = np.concatenate([data[i][1] for i in part])
            starts = np.cumsum([0, *[len(data[i][0]) for i in part]])[:-1]
            mean = np.add.reduceat(embed[slots] * weight[:, None], starts)
            z = mean @ out + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(part)), y[part]] -= 1
            back = p @ out.T
            p /= len(part)
            # Steps shrink with the squared gradients so far, for each slot and output weight.
            owner = np.repeat(np.arange(len(part)), np.diff(np.r_[starts, len(slots)]))
            slope = weight[:, None] * back[owner] / len(part)
            np.add.at(slot_sum, slots, (slope**2).sum(axis=1))
            np.subtract.at(embed, slots, step * slope / np.sqrt(slot_sum[slots] + 1e-12)[:, None])
            slope = mean.T @ p
            out_sum += slope**2
            out -= step * slope / np.sqrt(out_sum + 1e-12)
            bias -= 0.1 * step * p.sum(axis=0)
    model = Model(labels, embed @ out, bias)
    if held.any():
        _calibrate(model, np.array([(model.scores[s] * w[:, None]).sum(axis=0) + bias for s, w in (data[i] for i in np.flatnonzero(held))]), y[held])
    return model


def _calibrate(model: Model, logits: np.ndarray, y: np.ndarray) -> None:
    """Temperature of the least log loss, and the lowest limit that gives the wanted accuracy."""
    grid = np.exp(np.linspace(-0.7, 3, 38))
    loss = []
    for t in grid:
        model.temperature = t
        loss.append(-np.log(model.probabilities(logits)[np.arange(len(y)), y] + 1e-12).mean())
    model.temperature = float(grid[int(np.argmin(loss))])
    p = model.probabilities(logits)
    top, right = p.max(axis=1), p.argmax(axis=1) == y
    order = np.argsort(-top)
    accuracy = np.cumsum(right[order]) / np.arange(1, len(y) + 1)
    good = np.flatnonzero(accuracy >= WANTED_ACCURACY)
    # Reject what is no more certain than the first row that spoils the accuracy.
    first_bad = good[-1] + 1 if len(good) else 0
    model.limit = float(np.nextafter(top[order][first_bad], 2)) if first_bad < len(y) else 0.0


class _Words(dict):
    """Scores and number of subwords of cached words, as bytes of float64."""

    def __init__(self, model: Model):
        self.model = model
        self.counted = np.c_[model.scores, np.ones(len(model.scores))]

    def __missing__(self, word: str) -> bytes:
        """Words that are not kept: long ones, and those of very long texts."""
        return self.counted[slots_of(word)].sum(axis=0).tobytes()

    def keep(self, found: list[str]) -> None:
        """Have all but the long words of a text in the cache, the new ones by one sum."""
        new = [w for w in set(found) if w not in self]
        if len(self) + len(new) > CACHED_WORDS:
            self.clear()
            new = list(set(found))
        new = [w for w in new if len(w) <= LONG_WORD]
        if new:
            slots = list(map(slots_of, new))
            starts = np.cumsum([0, *map(len, slots[:-1])])
            rows = np.add.reduceat(self.counted[np.fromiter(chain.from_iterable(slots), np.int64)], starts)
            self.update(zip(new, map(np.ndarray.tobytes, rows)))


def logits_of(text: str, words: _Words) -> np.ndarray | None:
    """Label scores of a whole text; None without a letter."""
    width = len(words.model.labels) + 1
    total, low = np.zeros(width), text.lower()
    if len(low) <= 1 << 20:
        found = _WORD.findall(low)
        if found:
            words.keep(found)
            total = np.frombuffer(b"".join(map(words.__getitem__, found))).reshape(-1, width).sum(axis=0)
    else:  # the pieces of a very long text are never all in memory
        for m in _WORD.finditer(low):
            total = total + np.frombuffer(words[m.group()])
    return total[:-1] / total[-1] + words.model.bias if total[-1] else None


RESULT = "struct<lang_pred:string,score:double,rejected:boolean>"
_CACHES: dict[int, _Words] = {}


def predicted_column(text: Column, model) -> Column:
    """``RESULT`` of each whole text, from a broadcast model."""

    def predict(texts: pa.Array) -> pa.Array:
        m = model.value
        if id(m) not in _CACHES:
            _CACHES.clear()
            _CACHES[id(m)] = _Words(m)
        words, rows = _CACHES[id(m)], [logits_of(t.as_py() or "", _CACHES[id(m)]) if m.labels else None for t in texts]
        p = [None if z is None else words.model.probabilities(z) for z in rows]
        return pa.StructArray.from_arrays(
            [
                pa.array([UNKNOWN if x is None else m.labels[int(x.argmax())] for x in p], pa.string()),
                pa.array([0.0 if x is None else float(x.max()) for x in p], pa.float64()),
                pa.array([True if x is None else bool(x.max() < m.limit) for x in p], pa.bool_()),
            ],
            ["lang_pred", "score", "rejected"],
        )

    return F.arrow_udf(predict, RESULT)(text)


def training_rows(docs: DataFrame, label_col: str = "lang", text_col: str = "text") -> list[tuple[str, str]]:
    """About SAMPLE_ROWS whole texts of each language, chosen by a hash of the text."""
    known = docs.filter(F.col(label_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = known.groupBy(label_col).agg(F.count("*").alias("n"), F.avg(F.octet_length(text_col)).alias("bytes")).collect()
    share = F.lit(0)
    for r in sizes:
        rows = min(SAMPLE_ROWS, SAMPLE_BYTES / len(sizes) / max(1.0, r["bytes"]))
        share = F.when(F.col(label_col) == r[label_col], int(min(1.0, rows / r["n"]) * (1 << 30)) + 1).otherwise(share)
    chosen = known.filter(F.pmod(F.xxhash64(text_col), F.lit(1 << 30)) < share).select(text_col, label_col).distinct()
    return [(r[0], r[1]) for r in chosen.collect()]


def with_language(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Add ``lang_pred``, ``score`` and ``rejected``.

    Texts that are null or without a letter get ``und`` with score 0, as all do where nothing
    was learned. A ``rejected`` prediction is less certain than the calibrated limit. Rows are
    read one by one, so ties and repeated rows need no rule; columns with these names are replaced.
    """
    sent, lang = docs.sparkSession.sparkContext.broadcast(model), free_name(docs, "lang")
    found = docs.withColumn(lang, predicted_column(F.col(text_col), sent))
    return found.withColumns({c: F.col(f"{lang}.{c}") for c in ("lang_pred", "score", "rejected")}).drop(lang)


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 1 over all of ``documents``; a third of the ids, by CRC32, is held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    model = train(training_rows(docs.filter(~held)))
    return with_language(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")


QUERIES = {"op1_langid": op1_langid}
ORACLES: dict[str, str] = {}
