"""Readers of landed files: version listings, traces, sinkhole records, event-stream frames, blobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.operators.listings import clean
from driftloom.operators.records import from_iso

_TRACE = r"^(?:\[pid\s+\d+\]\s+|\d+\s+)?(\d+\.\d+)\s+(\w+)\((.*)$"


def trace_events(spark: SparkSession, path: str) -> DataFrame:
    """(at, call, args) of system-call traces; lines that don't parse are skipped."""
    lines = spark.read.text(path)
    parts = lines.select(*[F.regexp_extract("value", _TRACE, k).alias(n) for k, n in ((1, "at"), (2, "call"), (3, "args"))])
    return parts.filter("call <> ''").withColumn("at", F.col("at").try_cast("double"))


def sinkhole_events(spark: SparkSession, path: str) -> DataFrame:
    """(at, event) of sinkhole records; only name lookups and connections count."""
    rows = spark.read.schema("at double, kind string, query string, sni string, dest_port int").json(path)
    event = F.when(F.col("kind") == "dns", F.concat(F.lit("DNS "), "query")).when(
        F.col("kind") == "tcp", F.concat(F.lit("TCP "), F.coalesce("sni", F.concat(F.lit("port "), F.col("dest_port").cast("string"))))
    )
    return rows.select("at", event.alias("event")).filter("event is not null")


def event_frames(body: Column) -> Column:
    """JSON messages of an event stream: frames end at an empty line, data lines are joined."""
    frames = F.split(F.regexp_replace(body, "\r\n?", "\n"), "\n\n+")
    data = F.transform(frames, lambda f: F.array_join(F.transform(F.filter(F.split(f, "\n"), lambda x: x.startswith("data:")), lambda x: F.regexp_replace(x, "^data: ?", "")), "\n"))
    return F.filter(data, lambda x: F.try_parse_json(x).isNotNull() & (x != ""))


def version_rows(spark: SparkSession, path: str) -> DataFrame:
    """(name, published_at, is_latest, status, document, malformed, fault) of landed listing lines."""
    return parsed_rows(spark.read.text(path).withColumnRenamed("value", "document"))


def row_fault(document: Column) -> Column:
    """Why a listing line is malformed: it is no JSON object, its server is none, or the name is no text; else null."""
    kind = lambda path: F.schema_of_variant(F.try_variant_get(F.try_parse_json(document), path, "variant"))
    is_object = lambda path: F.coalesce(kind(path).startswith("OBJECT"), F.lit(False))
    named = F.coalesce((kind("$.server.name") == "STRING") & clean(F.get_json_object(document, "$.server.name")).isNotNull(), F.lit(False))
    return F.when(~is_object("$"), "not_an_object").when(~is_object("$.server"), "no_server").when(~named, "no_name")


def fault_counts(rows: DataFrame) -> DataFrame:
    """(fault, n): how many lines are malformed, by cause."""
    return rows.filter("fault is not null").groupBy("fault").agg(F.count("*").alias("n"))


def parsed_rows(doc: DataFrame) -> DataFrame:
    """The same of lines (document) that are read already. Times that cannot be read are null and their rows stay."""
    meta = "$._meta['io.modelcontextprotocol.registry/official']"
    name = clean(F.get_json_object("document", "$.server.name"))
    return doc.select(
        name.alias("name"),
        from_iso(F.get_json_object("document", f"{meta}.publishedAt")).alias("published_at"),
        F.get_json_object("document", f"{meta}.isLatest").alias("is_latest"),
        F.get_json_object("document", f"{meta}.status").alias("status"),
        "document",
        row_fault(F.col("document")).isNotNull().alias("malformed"),
        row_fault(F.col("document")).alias("fault"),
    )


def new_blobs(held: DataFrame, bodies: DataFrame, body: str = "body") -> DataFrame:
    """(sha, body) of bodies that the store lacks, each once."""
    fresh = bodies.select(F.sha2(body, 256).alias("sha"), F.col(body).alias("body"))
    return fresh.join(held.select("sha"), "sha", "left_anti").groupBy("sha").agg(F.first("body").alias("body"))


def damaged_blobs(blobs: DataFrame) -> DataFrame:
    """Blobs whose body does not hash to their name."""
    return blobs.filter(F.sha2("body", 256) != F.col("sha"))
