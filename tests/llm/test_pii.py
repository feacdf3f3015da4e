"""Personal data: base spans against the plain patterns, the field on planted repeats."""

import hashlib
import random
import re

import pytest

from driftloom.llm import pii as P

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    digits = lambda s: re.sub("[^0-9]", "", s)

    def luhn(d):
        return sum(sum(divmod(int(x) * (1 + k % 2), 10)) for k, x in enumerate(reversed(d))) % 10 == 0

    ok = {
        "email": lambda s: True,
        "ip": lambda s: all(int(x) <= 255 for x in s.split(".")),
        "card": lambda s: 16 <= len(digits(s)) <= 19 and luhn(digits(s)),
        "phone": lambda s: 8 <= len(digits(s)) <= 15,
    }
    return {k: [m.span() for m in re.finditer(p, text) if ok[k](m.group())] for k, p in PLAIN.items()}


@pytest.mark.parametrize("alphabet", ["a@.-1 ", "0123.4 ", "0 -1234", "+0 ().-12", "@a1.+%_- é9"])
def test_base_spans_of_random_texts(alphabet):
    rng = random.Random(alphabet)
    for _ in range(3000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(45)))
        assert P.base_spans(text) == plain(text), text


def test_real_cards_and_addresses():
    text = "4111 1111 1111 1111, x@y.zz, 256.1.1.1 1.2.3.4.5.6.7.8 +1 (456) 555-2186 a@b@c.d"
    assert P.base_spans(text) == plain(text)
    assert [text[a:b] for a, b in P.base_spans(text)["card"]] == ["4111 1111 1111 1111"]


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000, "1" * 200_000, "a@" * 100_000, "1." * 100_000, "+1" * 100_000):
        P.base_spans(text)


def _corpus(spark, n=160):
    rng = random.Random(8)
    words = "lorem ipsum dolor sit amet consectetur".split()
    rows = []
    for k in range(n):
        phone = f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}"
        bare = re.sub("[^0-9]", "", phone)
        text = " ".join(rng.choice(words) for _ in range(20)) + f" call {phone} or mail person{k}.x@mail.example.com " + " ".join(rng.choice(words) for _ in range(20))
        if k % 2:
            text += f" again {bare} and person{k}.x here, not item{k} nor 12345"
        rows.append((k, text))
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_repeats_are_added_and_base_stays(spark):
    found = {r.doc_id: (r.text, r.pii) for r in P.with_spans(_corpus(spark)).collect()}
    hit = 0
    for k, (text, spans) in found.items():
        base = plain(text)
        assert [(s.kind, s.start, s.end) for s in spans if s.base] == [(kind, *x) for kind in P.KINDS for x in base[kind]]
        more = [(s.kind, text[s.start : s.end]) for s in spans if not s.base]
        assert all(x[1] not in (f"item{k}", "12345") for x in more)
        hit += ("phone", re.sub("[^0-9]", "", text[slice(*base["phone"][0])])) in more if k % 2 else 0
        if not k % 2:
            assert not more
    assert hit >= 70


def test_nulls_empties_redaction_and_digests(spark, sf):
    rows = [(1, None, "p"), (2, "", "q"), (3, "mail a@b.cc or b.a@c.dd!", "r"), (3, "é +12345678 x", "r"), (None, "none", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pii string")
    out = P.redact(docs)
    assert out.columns == docs.columns
    texts = [r.text for r in out.collect()]
    assert texts == [None, "", "mail [EMAIL] or [EMAIL]!", "é [PHONE] x", "none"]
    assert P.redact(docs.limit(0)).count() == 0
    for r in P.op5_pii(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), "doc_id").collect():
        base = plain(r.text or "")
        told = ",".join(f"{k}:{a}:{b}" for k in P.KINDS for a, b in base[k])
        assert r.base_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(len(base[k]) for k in P.KINDS)
        assert set(filter(None, told.split(","))) <= set(r.spans.split(","))


def _field(spark, sf):
    texts = P.training_texts(spark.read.parquet(f"{sf}/documents.parquet"))
    return texts, P.learn(texts)


def test_field_labels_every_document_with_open_candidates(spark, monkeypatch):
    """Messages pass in each document that has a candidate beside its base spans, linked or not."""
    sf = "/root/testdata/sf0.01"
    texts, field = _field(spark, sf)
    asked, beliefs = [], P.Field.beliefs
    monkeypatch.setattr(P.Field, "beliefs", lambda self, g, known: asked.append(len(g.spans)) or beliefs(self, g, known))
    rows = [r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    open_ = 0
    for text in rows:
        base = P.base_spans(text)
        open_ += len(P.candidate_graph(text, base).spans) > len({s for v in base.values() for s in v})
        P.added_spans(text, base, field)
    assert len(asked) == open_ > 10


def test_spans_without_a_repeat_are_added(spark):
    """What a pattern drops whole, as two values stand side by side: the field's own evidence adds the parts."""
    _, field = _field(spark, "/root/testdata/sf0.1")
    text = "thonble. Shre +1 (826) 555-4081 190.137.223.204 du and 7536784127813050 4845168114407329 end, 2353820953013749 here"
    base = P.base_spans(text)
    assert base == plain(text) and not base["phone"] and not base["card"]
    more = {(k, text[a:b]) for k, spans in P.added_spans(text, base, field).items() for a, b in spans}
    assert more == {("phone", "+1 (826) 555-4081"), ("card", "7536784127813050"), ("card", "4845168114407329")}


def test_precision_and_recall_on_planted_repeats(spark):
    """Bare repeats of a phone and of an address's local part among numbers that are neither."""
    found, right, planted = 0, 0, 0
    for r in P.with_spans(_corpus(spark)).collect():
        phone = re.sub("[^0-9]", "", r.text[slice(*plain(r.text)["phone"][0])])
        wanted = {("phone", phone), ("email", f"person{r.doc_id}.x")} if r.doc_id % 2 else set()
        added = [(s.kind, r.text[s.start : s.end]) for s in r.pii if not s.base]
        planted += len(wanted)
        found += len(added)
        right += sum(x in wanted for x in added)
    assert right / found > 0.95 and right / planted > 0.8


def test_many_candidates_and_clashing_names(spark):
    _, field = _field(spark, "/root/testdata/sf0.01")
    rng = random.Random(3)
    text = " ".join(str(rng.randrange(10**rng.randrange(3, 18))) for _ in range(60_000)) + " +1 (826) 555-4081, 18265554081"
    base = P.base_spans(text)
    assert base == plain(text)
    spans = [s for v in P.added_spans(text, base, field).values() for s in v]
    assert all(b <= c or d <= a for a, b in spans for v in base.values() for c, d in v)
    docs = spark.createDataFrame([(1, "mail a@b.cc now", 5, "k")], "doc_id long, text string, _pii int, pii string")
    out = P.redact(docs)
    assert out.columns == docs.columns and tuple(out.first()) == (1, "mail [EMAIL] now", 5, "k")


def test_sample_is_bounded_in_bytes(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"+{k} " + "word " * 200) for k in range(400)], "doc_id long, text string")
    monkeypatch.setattr(P, "SAMPLE_BYTES", 100_000)
    assert 0 < sum(map(len, P.training_texts(docs))) < 200_000
    monkeypatch.setattr(P, "SAMPLE_TEXT_BYTES", 100)
    assert P.training_texts(docs) == []
