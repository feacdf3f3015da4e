"""Personal data (operator 5).

Base spans come from four patterns. The method adds spans to them: a skip-chain conditional
random field labels every other token that could be personal data. Neighbouring candidates share
chain potentials; equal or similar tokens anywhere in the document share skip potentials; loopy
message passing makes their labels consistent, so a number that is a phone in one place is one
where its plus sign is missing too. A candidate becomes a span if its belief is high, by whatever
evidence: its own features, its neighbours in the chain, or its repeats.

Weights are learned in numpy from a bounded sample of texts whose base spans are the labels. In a
second view of each text the base spans are masked: they have the features of their bare repeats
(digits only, local part only), so the field learns to recover what the patterns don't see.
Words without digit, ``@`` or a part of a found address carry the label "none" with certainty
and are left out of the graph, so its size follows the candidates and not the text.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.llm.shared import free_name, table

KINDS = ("email", "ip", "card", "phone")
NONE = len(KINDS)
#: Texts to learn from, chosen by a hash of the text, at most about; bytes of all of them and of one text.
SAMPLE_TEXTS, SAMPLE_BYTES, SAMPLE_TEXT_BYTES = 3_000, 16 << 20, 1 << 18
#: Passes over them; step; weight decay.
PASSES, STEP, DECAY = 8, 0.1, 1e-4
#: Message passing: rounds, share of the old message, and the belief from which a span is added.
ROUNDS, DAMPING, MIN_BELIEF = 12, 0.3, 0.9
#: Neighbours at most so many characters apart share the potentials of close ones, others those of far ones.
CLOSE = 12

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# The look-behinds change no match: inside a run of digits a pattern fails where its start does.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile("[0-9]")
# A number that is written like a phone; it ends where a base span starts.
_DIALLED = re.compile(r"\+[0-9]+(?:[ .-]?(?:\([0-9]+\)|[0-9]+))+")
_CANDIDATE = re.compile(r"[+(]*[0-9@](?:[^\s,;:!?]|[,;:!?](?=[0-9@]))*|[^\s0-9@]*[0-9@]\S*")

Span = tuple[int, int]


def emails(text: str) -> list[Span]:
    """Leftmost matches of the address pattern, found from their ``@`` in linear time."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append((start, domain.end()))
        # A local part can't hold an @, nor characters that a match has used.
        free = domain.end() if domain else at + 1
        at = text.find("@", free)
    return out


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d)
        if k % 2:
            x = x * 2 - 9 * (x > 4)
        total += x
    return total % 10 == 0


def _fits(n: str) -> bool:
    n = n.lstrip("0")
    return len(n) < 3 or len(n) == 3 and int(n) <= 255


def base_spans(text: str) -> dict[str, list[Span]]:
    """Spans of the four patterns; matches that fail their check are dropped without a retry."""
    found = {"email": emails(text) if "@" in text else []}
    if _DIGITS.search(text):
        found["ip"] = [m.span() for m in _IP.finditer(text) if all(map(_fits, m.group().split(".")))]
        cards = ((m.span(), m.group().translate(_NO_GAPS)) for m in _CARD.finditer(text))
        found["card"] = [s for s, d in cards if 16 <= len(d) <= 19 and luhn(d)]
    if "+" in text:
        found["phone"] = [m.span() for m in _PHONE.finditer(text) if 8 <= len(_DIGITS.findall(m.group())) <= 15]
    return {k: found.get(k, []) for k in KINDS}


_NO_GAPS = {ord(" "): None, ord("-"): None}


@dataclass
class Graph:
    """Candidate tokens of one text, their features, chain edges (close and far) and skip edges."""

    spans: list[Span]
    features: list[tuple[int, ...]]
    close: list[tuple[int, int]]
    far: list[tuple[int, int]]
    skip: list[tuple[int, int]]

    def edges(self) -> list[list[tuple[int, int]]]:
        return [self.close, self.far, self.skip]


FEATURES = 128


def _bucket(name: str, value: object) -> int:
    """Slot of a feature: one of FEATURES, by a hash that is the same in every process."""
    h = 5381
    for c in f"{name}={value}".encode():
        h = (h * 33 + c) & 0xFFFFFFFF
    return (h ^ h >> 15) % FEATURES


def _features(token: str, before: str) -> tuple[int, ...]:
    numbers = "".join(_DIGITS.findall(token))
    digits, letters = len(numbers), sum(c.isalpha() for c in token)
    return (
        _bucket("bias", 0),
        _bucket("digits", min(digits, 20)),
        _bucket("letters", min(letters, 3)),
        _bucket("at", token.count("@") == 1),
        _bucket("dots", min(token.count("."), 5)),
        _bucket("shape", re.sub("[a-z]+", "a", re.sub("[0-9]+", "0", token.lower()))[:12]),
        _bucket("plus", "+" in token or before.endswith("+")),
        _bucket("only", digits == len(token)),
        _bucket("sum", luhn(numbers) if 16 <= digits <= 19 else None),
    )


def _bare(token: str) -> str:
    """What a repeat of a base span looks like when its marks are missing."""
    return token.split("@")[0] if "@" in token else "".join(_DIGITS.findall(token)) if token.startswith("+") else token.replace(" ", "").replace("-", "")


def _in_gaps(found: Iterator[re.Match], taken: list[Span]) -> Iterator[Span]:
    """Matches that overlap none of the sorted spans."""
    k = 0
    for m in found:
        while k < len(taken) and taken[k][1] <= m.start():
            k += 1
        if k == len(taken) or taken[k][0] >= m.end():
            yield m.span()


def candidate_graph(text: str, base: dict[str, list[Span]], masked: bool = False) -> Graph:
    """Tokens: base spans, numbers written like phones, other runs with a digit or @, and repeats of
    addresses' local parts.

    A local part that is one word of letters is any word, and no candidate. ``masked`` gives base
    spans the features of their bare repeats.
    """
    own = sorted({s for found in base.values() for s in found})
    ends = [0, *[b for _, b in own]]
    gaps = zip(ends, [*[a for a, _ in own], len(text)])
    dialled = [m.span() for a, b in gaps if a < b for m in _DIALLED.finditer(text, a, b)] if "+" in text else []
    tokens = sorted([*own, *dialled])
    taken = []
    for a, b in _in_gaps(_CANDIDATE.finditer(text), tokens):
        while b > a and text[b - 1] in ".,;:!?)\"'":
            b -= 1
        if b > a:
            taken.append((a, b))
    tokens = sorted([*tokens, *taken])
    parts = {text[a:b].split("@")[0] for a, b in base["email"]}
    parts = sorted((p for p in parts if not p.isalpha()), key=len, reverse=True)
    if parts:
        again = re.compile(r"(?<![\w@.])(?:" + "|".join(map(re.escape, parts)) + r")(?![\w@])")
        tokens = sorted([*tokens, *_in_gaps(again.finditer(text), tokens)])
    chain = [(i, i + 1) for i in range(len(tokens) - 1) if tokens[i + 1][0] >= tokens[i][1]]
    close = [(i, j) for i, j in chain if tokens[j][0] - tokens[i][1] <= CLOSE]
    far = [(i, j) for i, j in chain if tokens[j][0] - tokens[i][1] > CLOSE]
    skip, last = [], {}
    for i, (a, b) in enumerate(tokens):
        for key in _link_keys(text[a:b]):
            if key in last and last[key] != i:
                skip.append((last[key], i))  # to the last one only: links stay linear in repeats
            last[key] = i
    mask = set(own) if masked else ()
    features = [_features(_bare(text[a:b]), "") if (a, b) in mask else _features(text[a:b], text[max(0, a - 2) : a]) for a, b in tokens]
    return Graph(tokens, features, close, far, sorted(set(skip)))


def _link_keys(token: str) -> list[str]:
    """Keys under which equal and similar tokens meet: all digits, and an address's local part."""
    digits = "".join(_DIGITS.findall(token))
    keys = ["=" + token.casefold()]
    if len(digits) >= 7:
        keys.append("#" + digits)
    local = token.casefold().split("@")[0]
    if not local.isalpha() and not local.isdigit():
        keys.append("@" + local)
    return keys


@dataclass
class Field:
    """Weights: of features per label, and of label pairs on close, far and skip edges."""

    unary: np.ndarray
    pairs: list[np.ndarray]

    @classmethod
    def blank(cls) -> Field:
        n = NONE + 1
        return cls(np.zeros((FEATURES, n)), [np.zeros((n, n)) for _ in range(3)])

    def scores(self, g: Graph) -> np.ndarray:
        return self.unary[np.array(g.features, np.int64)].sum(axis=1)

    def beliefs(self, g: Graph, clamped: dict[int, int]) -> np.ndarray:
        """Label probabilities of each token by loopy message passing; clamped tokens are known."""
        labels = NONE + 1
        unary = self.scores(g)
        for i, y in clamped.items():
            unary[i] = -50.0
            unary[i, y] = 0.0
        edges = np.array([e for kind in g.edges() for e in kind], np.int64).reshape(-1, 2)
        weight = np.concatenate([np.repeat(w[None], len(kind), 0) for w, kind in zip(self.pairs, g.edges())])
        # Message 2e goes along edge e and message 2e+1 against it.
        source, target = edges.ravel(), edges[:, ::-1].ravel()
        weights = np.stack([weight, weight.transpose(0, 2, 1)], 1).reshape(-1, labels, labels)
        back = np.arange(len(source)) ^ 1
        messages = np.zeros((len(source), labels))
        for _ in range(ROUNDS if len(source) else 0):
            incoming = unary.copy()
            np.add.at(incoming, target, messages)
            out = incoming[source] - messages[back]
            sent = np.logaddexp.reduce(out[:, :, None] + weights, axis=1)
            sent -= np.logaddexp.reduce(sent, axis=1, keepdims=True)
            moved = np.abs(sent - messages).max()
            messages = DAMPING * messages + (1 - DAMPING) * sent
            if moved < 1e-4:
                break
        np.add.at(unary, target, messages)
        p = np.exp(unary - unary.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def _known(g: Graph, base: dict[str, list[Span]]) -> dict[int, int]:
    at = {s: i for i, s in enumerate(g.spans)}
    return {at[s]: k for k, kind in enumerate(KINDS) for s in base[kind]}


def _labelled(text: str) -> Iterator[tuple[Graph, np.ndarray, np.ndarray]]:
    """(graph, labels, trusted) of a text as it is, and with its base spans masked.

    Labels are the base spans, and "none" for other candidates. A candidate that a skip edge links
    with a base span is what the field is asked about: it counts as that kind for the skip
    weights and teaches nothing else. One written like a phone teaches nothing.
    """
    base = base_spans(text)
    for masked in (False, True):
        g = candidate_graph(text, base, masked)
        known = _known(g, base)
        if not g.spans or masked and not known:
            continue
        y = np.full(len(g.spans), NONE)
        for i, k in known.items():
            y[i] = k
        trusted = np.array([i in known or not _DIALLED.fullmatch(text[a:b]) for i, (a, b) in enumerate(g.spans)])
        near = defaultdict(list)
        for a, b in g.skip:
            near[a].append(b)
            near[b].append(a)
        todo = list(known)
        while todo:
            i = todo.pop()
            for j in near[i]:
                if y[j] == NONE:
                    y[j], trusted[j] = y[i], False
                    todo.append(j)
        yield g, y, trusted


def learn(texts: list[str]) -> Field:
    """Fit a field by pseudo-likelihood: each token given the labels of its neighbours."""
    field, n = Field.blank(), NONE + 1
    data = [x for text in texts for x in _labelled(text)]
    weights = [field.unary, *field.pairs]
    total = [np.zeros_like(w) for w in weights]
    for _ in range(PASSES):
        for g, y, trusted in data:
            score = field.scores(g)
            for edges, w in zip(g.edges(), field.pairs):
                for a, b in edges:
                    score[a] += w[:, y[b]]
                    score[b] += w[y[a], :]
            p = np.exp(score - score.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            slope = -p
            slope[np.arange(len(y)), y] += 1
            grads = [np.zeros_like(w) for w in weights]
            for i, f in enumerate(g.features):
                if trusted[i]:
                    np.add.at(grads[0], list(f), slope[i])
            for k, edges in enumerate(g.edges(), 1):
                for a, b in edges:
                    if k == 3 or trusted[a] and trusted[b]:
                        grads[k][:, y[b]] += slope[a]
                        grads[k][y[a], :] += slope[b]
            for w, grad, t in zip(weights, grads, total):
                t += grad**2
                w += STEP * grad / np.sqrt(t + 1e-8) - STEP * DECAY * w
    return field


def added_spans(text: str, base: dict[str, list[Span]], field: Field) -> dict[str, list[Span]]:
    """Spans that the field finds among the candidates that are no base spans; they overlap none."""
    out: dict[str, list[Span]] = defaultdict(list)
    if "@" not in text and not _DIGITS.search(text):
        return out  # no candidate
    g = candidate_graph(text, base)
    known = _known(g, base)
    if len(known) == len(g.spans):
        return out  # nothing to label
    p = field.beliefs(g, known)
    for i in np.flatnonzero((p.argmax(axis=1) != NONE) & (p.max(axis=1) >= MIN_BELIEF)).tolist():
        if i not in known:
            out[KINDS[int(p[i].argmax())]].append(g.spans[i])
    return out


SPAN = "struct<kind:string,start:bigint,end:bigint,base:boolean>"


def spans_column(text: Column, field) -> Column:
    """All spans of a whole text, by kind as in ``KINDS`` and then start; ``base`` marks base spans."""
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])

    def find(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts:
            text = t.as_py() or ""
            base = base_spans(text)
            more = added_spans(text, base, field.value)
            out.append([
                {"kind": k, "start": a, "end": b, "base": own}
                for k in KINDS
                for (a, b), own in sorted([*((s, True) for s in base[k]), *((s, False) for s in more.get(k, ()))])
            ])
        return pa.array(out, pa.list_(kind))

    return F.arrow_udf(find, f"array<{SPAN}>")(text)


def training_texts(docs: DataFrame, text_col: str = "text") -> list[str]:
    """At most about SAMPLE_TEXTS whole texts, and SAMPLE_BYTES, that hold a digit and an @ or +, by a hash of the text."""
    size = F.octet_length(F.col(text_col)).cast("long")
    has = docs.filter(F.col(text_col).rlike("[0-9]") & F.col(text_col).rlike("[@+]") & (size <= SAMPLE_TEXT_BYTES)).select(F.col(text_col).alias("t"))
    n, total = has.agg(F.count("*"), F.sum(F.octet_length("t").cast("long"))).first()
    share = min(1.0, SAMPLE_TEXTS / max(1, n), SAMPLE_BYTES / max(1, total or 0))
    return sorted(r.t for r in has.filter(F.pmod(F.xxhash64("t"), F.lit(1 << 20)) < int((1 << 20) * share) + 1).distinct().collect())


def with_spans(docs: DataFrame, text_col: str = "text", out_col: str = "pii") -> DataFrame:
    """Add the array of spans of each row's text.

    Positions are code points, the end exclusive. Null and blank texts have no spans, and an empty
    table gives no rows. Rows are read one by one, so ties and repeated rows need no rule.
    ``out_col`` is replaced if there.
    """
    field = docs.sparkSession.sparkContext.broadcast(learn(training_texts(docs, text_col)))
    return docs.withColumn(out_col, spans_column(F.col(text_col), field))


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; of overlapping spans, the first.

    A text is cut in one pass over its spans. Null texts stay null.
    """

    def cut(texts: pa.Array, rows: pa.Array) -> pa.Array:
        out = []
        for t, row in zip(texts, rows):
            told = t.as_py()
            if told is not None and len(row):
                parts, at = [], 0
                for start, back, kind in sorted((x["start"], -x["end"], x["kind"]) for x in row.as_py()):
                    if start >= at:
                        parts += [told[at:start], f"[{kind.upper()}]"]
                        at = -back
                told = "".join([*parts, told[at:]])
            out.append(told)
        return pa.array(out, pa.string())

    return F.arrow_udf(cut, "string")(text, spans)


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` with the spans of ``text_col`` replaced; all other columns stay, whatever their names."""
    spans = free_name(docs, "pii")
    found = with_spans(docs, text_col, spans)
    return found.withColumn(text_col, redacted(F.col(text_col), F.col(spans))).drop(spans)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 5 over all of ``documents``."""
    found = with_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("pii", lambda s: s["base"])
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(told(base), 256).alias("base_sha256"),
        told(F.col("pii")).alias("spans"),
    )


QUERIES = {"op5_pii": op5_pii}
ORACLES: dict[str, str] = {}
