"""Names that captured packets ask for: the server name of a TLS ClientHello, the question of a DNS query.

Bytes come from programs that may send anything. Fields carry their lengths, and a field that would lie
beyond the packet is null, which ends the walk; nothing raises. Walks are folds over BINARY columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Where a ClientHello's first field of its own length lies, and the widths of the lengths of three such fields.
_HELLO, _LENGTHS = 43, (1, 2, 1)
#: Bytes of a DNS header.
_HEADER = 12


def unsigned(data: Column, at: Column, width: int) -> Column:
    """The big-endian number of ``width`` bytes at ``at`` (from 0); null beyond the end."""
    part = F.substring(data, at + 1, F.lit(width))
    return F.when(F.length(part) == width, F.conv(F.hex(part), 16, 10).cast("int"))


def ascii_text(data: Column) -> Column:
    """Bytes as ASCII text, each other byte as U+FFFD."""
    return F.regexp_replace(F.decode(data, "ISO-8859-1"), "[\u0080-ÿ]", "�")


def server_name(data: Column) -> Column:
    """The first server name of a TLS ClientHello; null for null, for other bytes and for an empty name.

    A name that the capture cuts is given as far as it goes.
    """
    size = F.length(data)
    past = F.aggregate(F.array(*map(F.lit, _LENGTHS)), F.lit(_HELLO), lambda at, width: at + width + F.when(width == 1, unsigned(data, at, 1)).otherwise(unsigned(data, at, 2)))
    none = F.lit(None).cast("int")
    start = F.struct(past.alias("at"), none.alias("end"), none.alias("name"))

    def step(s: Column, k: Column) -> Column:
        # The first step reads how long all extensions are, each later one passes an extension.
        end = F.when(k == 0, F.least(s["at"] + 2 + unsigned(data, s["at"], 2), size)).otherwise(s["end"])
        open_ = (k > 0) & s["name"].isNull() & (s["at"] + 4 <= s["end"])
        is_name = unsigned(data, s["at"], 2) == 0
        at = F.when(k == 0, s["at"] + 2).when(open_ & ~is_name, s["at"] + 4 + unsigned(data, s["at"] + 2, 2)).otherwise(s["at"])
        return F.struct(at.alias("at"), end.alias("end"), F.when(open_ & is_name, s["at"] + 4).otherwise(s["name"]).alias("name"))

    # A list of names has a length of 2 bytes, then each name a type of 1 and a length of 2.
    cut = lambda s: F.when(s["name"] + 5 <= size, F.substring(data, s["name"] + 6, unsigned(data, s["name"] + 3, 2)))
    walked = F.aggregate(F.sequence(F.lit(0), F.floor(size / 4).cast("int") + 1), start, step, cut)
    hello = (unsigned(data, F.lit(0), 1) == 0x16) & (unsigned(data, F.lit(5), 1) == 0x01)
    return F.when(hello, F.nullif(ascii_text(walked), F.lit("")))


def question(data: Column) -> Column:
    """The name that a DNS query asks for, its labels joined by dots; null where there is none.

    A label that the capture cuts is given as far as it goes.
    """
    start = F.struct(F.lit(_HEADER).alias("at"), F.lit(None).cast("string").alias("name"))

    def step(s: Column, _: Column) -> Column:
        size = unsigned(data, s["at"], 1)
        label = ascii_text(F.substring(data, s["at"] + 2, size))
        more = F.coalesce(size > 0, F.lit(False))
        name = F.when(more, F.concat(F.coalesce(F.concat(s["name"], F.lit(".")), F.lit("")), label)).otherwise(s["name"])
        return F.struct(F.when(more, s["at"] + 1 + size).otherwise(s["at"]).alias("at"), name.alias("name"))

    # A label takes two bytes, but the last may be a lone length.
    return F.nullif(F.aggregate(F.sequence(F.lit(0), F.floor(F.length(data) / 2).cast("int")), start, step, lambda s: s["name"]), F.lit(""))


def packet_events(rows: DataFrame, kind: str = "kind", data: str = "data", port: str = "dest_port") -> DataFrame:
    """``rows`` with ``event``, ``bytes`` and ``prefix`` of captured packets.

    A lookup is ``DNS name``, a connection ``TCP name``, or ``TCP port n`` without a name. Any other kind,
    and a lookup without a name, has a null event. The prefix is the first 200 bytes of a connection as text.
    """
    lookup = F.when(F.col(kind) == "dns", F.concat(F.lit("DNS "), question(F.col(data))))
    to = F.coalesce(server_name(F.col(data)), F.concat(F.lit("port "), F.col(port).cast("string")))
    event = lookup.when(F.col(kind) == "tcp", F.concat(F.lit("TCP "), to))
    prefix = F.when((F.col(kind) == "tcp") & (F.length(data) > 0), F.make_valid_utf8(F.substring(F.col(data), 1, 200).cast("string")))
    return rows.withColumns({"event": event, "bytes": F.length(data), "prefix": prefix})
