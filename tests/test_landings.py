"""Packets against a plain reader of bytes, rounding against Python's, lines, launches and backups by cases."""

import json
import random
import struct
from datetime import UTC, datetime

from pyspark.sql import functions as F

from driftloom.functions.rounding import rounded
from driftloom.operators import listings, records
from driftloom.sources import landed, packets


def hello(name: bytes, session=b"", others=(), ciphers=b"\x13\x01", more=b""):
    named = struct.pack(">HBH", len(name) + 3, 0, len(name)) + name
    exts = b"".join(struct.pack(">HH", k, len(v)) + v for k, v in (*others, (0, named))) + more
    fields = bytes([len(session)]) + session + struct.pack(">H", len(ciphers)) + ciphers + b"\x01\x00"
    return b"\x16\x03\x01\x00\x00\x01\x00\x00\x00\x03\x03" + bytes(32) + fields + struct.pack(">H", len(exts)) + exts


def plain_name(data):
    """Extensions as a list first, then the first of kind 0."""
    if data is None or len(data) < 43 or data[0] != 0x16 or data[5] != 1:
        return None
    take, at = (lambda i, n: int.from_bytes(data[i : i + n], "big") if i + n <= len(data) else None), 43
    for width in (1, 2, 1):
        if (size := take(at, width)) is None:
            return None
        at += width + size
    if (size := take(at, 2)) is None:
        return None
    end, at, found = min(at + 2 + size, len(data)), at + 2, []
    while at + 4 <= end:
        found.append((take(at, 2), at + 4))
        at += 4 + take(at + 2, 2)
    first = next((i for k, i in found if k == 0), None)
    if first is None or (size := take(first + 3, 2)) is None:
        return None
    return "".join(chr(b) if b < 128 else "�" for b in data[first + 5 : first + 5 + size]) or None


def plain_question(data):
    at, labels = 12, []
    while at < len(data) and data[at]:
        labels.append("".join(chr(b) if b < 128 else "�" for b in data[at + 1 : at + 1 + data[at]]))
        at += 1 + data[at]
    return ".".join(labels) or None


def test_packets(spark):
    rng = random.Random(8)
    whole = [hello(b"a.example"), hello(b"x" * 300, bytes(32), [(10, b"abc"), (43, b"")]), hello(b"", others=[(5, bytes(9))]), hello(b"caf\xe9.example", more=b"\x00\x00\x00\x02zz")]
    lookups = [bytes(12) + b"\x01a\x07example\x00\x00\x01\x00\x01", bytes(12) + b"\x00", bytes(12) + b"\xc0\x0cabc", bytes(12) + b"\x03ab\xff\x01", bytes(5), bytes(12) + b"\x02"]
    rows = [*whole, *lookups, b"", b"\x16" * 60]
    for p in (*whole, *lookups):
        rows += [p[: rng.randrange(len(p) + 1)] for _ in range(12)]
        rows += [bytes(b if rng.random() > 0.05 else rng.randrange(256) for b in p) for _ in range(12)]
    df = spark.createDataFrame([(k, bytearray(p)) for k, p in enumerate(rows)] + [(-1, None)], "k int, p binary")
    got = {r.k: (r.n, r.q) for r in df.select("k", packets.server_name(F.col("p")).alias("n"), packets.question(F.col("p")).alias("q")).collect()}
    assert got.pop(-1) == (None, None)
    assert got == {k: (plain_name(p), plain_question(p)) for k, p in enumerate(rows)}
    assert got[0][0] == "a.example" and got[4][1] == "a.example"


def test_packet_events(spark):
    rows = [("dns", bytearray(bytes(12) + b"\x01a\x00"), 53), ("dns", bytearray(3), 53), ("tcp", bytearray(hello(b"h.example")), 443), ("tcp", bytearray(b"GET \xff"), 80), ("tcp", None, 22), ("udp", bytearray(b"x"), 1)]
    got = packets.packet_events(spark.createDataFrame(rows, "kind string, data binary, dest_port int")).collect()
    assert [r.event for r in got] == ["DNS a", None, "TCP h.example", "TCP port 80", "TCP port 22", None]
    assert got[3].prefix == "GET �" and got[0].prefix is None and [r.bytes for r in got][3:] == [5, None, 1]


def test_rounded_as_python(spark):
    rng = random.Random(3)
    values = [2.675, 1.005, 0.5, 1.5, 2.5, -0.5, -2.5, -2.675, 0.125, 0.375, 1e16, 4503599627370497.5, 9007199254740991.0, 1e300, 0.1, 2.5e-9, 5e-324, 123456789.123456785]
    values += [rng.uniform(-10, 10) for _ in range(300)] + [rng.randrange(-4000, 4000) / 16 for _ in range(300)] + [rng.randrange(10**6) / 10**4 + 5e-5 for _ in range(300)]
    values += [float(1 << 52) + rng.randrange(1 << 20) / 2 for _ in range(50)]
    digits = (0, 1, 2, 3, 4, 6, 9)
    df = spark.createDataFrame([(v,) for v in values], "x double").select("x", *[rounded(F.col("x"), n).alias(f"r{n}") for n in digits])
    for r in df.collect():
        assert [r[f"r{n}"] for n in digits] == [round(r.x, n) for n in digits], r.x
    odd = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),)], "x double").select(rounded(F.col("x"), 2).alias("r")).collect()
    assert odd[0].r is None and odd[1].r != odd[1].r and odd[2].r == float("inf")


def test_launch_arguments(spark):
    args = [{"type": "named", "name": "--a", "value": "1"}, {"type": "named", "name": "--b"}, {"type": "named", "name": "", "value": "x"}, "no", {"value": None, "default": 2}, {"type": "positional"}, {"value": False}]
    cases = [json.dumps({"packageArguments": args}), json.dumps({}), None, "no json"]
    got = spark.createDataFrame([(c,) for c in cases], "p string").select(listings.launch_arguments(F.col("p")).alias("l")).collect()
    assert [r.l for r in got] == [["--a", "1", "--b", "2", "False"], [], [], []]


def test_malformed_lines_by_cause(spark, tmp_path):
    at = "_meta", {"io.modelcontextprotocol.registry/official": {"publishedAt": "2026-07-27T10:44:51.359634Z", "isLatest": True}}
    good = {"server": {"name": " n "}, at[0]: at[1]}
    (tmp_path / "l.json").write_text("\n".join([json.dumps(good), '{"server":{"name":"m"}}', "[]", '{"server":[]}', '{"server":{"name":7}}', "{"]))
    rows = landed.version_rows(spark, f"file://{tmp_path}/l.json").collect()
    assert [r.fault for r in rows] == [None, None, "not_an_object", "no_server", "no_name", "not_an_object"]
    assert rows[0].published_at is not None and rows[1].published_at is None and not rows[1].malformed and rows[0].name == "n"


def test_times_need_an_offset(spark):
    texts = ["2026-07-27T10:44:51.359634Z", "2026-07-27T12:44:51.359634+02:00", "2026-07-27T10:44:51", "soon", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(F.unix_micros(records.from_iso(F.col("t"))).alias("u")).collect()
    want = int(datetime(2026, 7, 27, 10, 44, 51, 0, UTC).timestamp()) * 10**6 + 359634
    assert [r.u for r in got] == [want, want, None, None, None]


def test_backups(spark):
    now = F.lit("2026-01-03 12:00:00Z").cast("timestamp")
    checks = lambda rows: {r.name.split(".")[1]: r.ok for r in records.backup_checks(spark.createDataFrame(rows, "created_at string, verified boolean"), now).collect()}
    assert checks([]) == {"present": False, "freshness": False, "verified": False}
    assert checks([("2026-01-02T00:00:00+00:00", True), ("2026-01-01T00:00:00+00:00", False)]) == {"present": True, "freshness": True, "verified": True}
    assert checks([("2026-01-01T23:59:59+00:00", None), (None, True)]) == {"present": True, "freshness": False, "verified": False}


def test_latest_stats(spark):
    rows = [("a", 1, 2, '{"n":1}'), ("a", 5, None, '{"n":9}'), ("a", 3, 4, '{"n":2,"r":"x"}'), ("b", 1, 1, "[1]"), ("c", 1, None, '{"n":1}')]
    got = records.latest_stats(spark.createDataFrame(rows, "k string, s int, f int, j string"), "k", "s", "f", "j", {"n": "bigint", "r": "double"}).collect()
    assert sorted((r.k, r.n, r.r) for r in got) == [("a", 2, None), ("b", None, None)]
