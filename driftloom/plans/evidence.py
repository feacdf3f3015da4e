"""Queries of typed comparison, streams with late facts, exactly-once appends, call windows, divergence and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.functions.typed import changed_members
from driftloom.operators import chain, changesets, divergence, records, stats
from driftloom.operators.snapshots import Store, mirror
from driftloom.plans import catalog
from driftloom.plans.registry import query
from driftloom.session import own_folder, spread, table
from driftloom.streaming import late, ledger

# Values that look alike without their types. The same text makes documents in both engines.
_LOOK = """CASE CAST({} AS BIGINT) % 9 WHEN 0 THEN '"1"' WHEN 1 THEN '1' WHEN 2 THEN '1.0' WHEN 3 THEN 'true' WHEN 4 THEN '"true"' WHEN 5 THEN 'null' WHEN 6 THEN '{{"n":1}}' WHEN 7 THEN '{{"n":"1"}}' ELSE '[1,true]' END"""
_LISTING = "concat('{{\"server\":{{\"name\":\"n\",', CASE WHEN {k} % 4 = 0 THEN '' ELSE concat('\"title\":', {look}, ',') END, '\"website\":', {other}, '}}}}')"
_SIDES = {
    "before": _LISTING.format(k="o_orderkey", look=_LOOK.format("o_orderkey"), other=_LOOK.format("o_custkey")),
    "after": _LISTING.format(k="o_custkey", look=_LOOK.format("o_orderkey + o_custkey"), other=_LOOK.format("o_custkey + o_orderkey * (o_custkey % 3)")),
}
_DOCS = f"docs AS (SELECT o_orderkey AS key, {_SIDES['before']} AS before, {_SIDES['after']} AS after FROM orders)"
_FIELD = "SELECT key, '{f}' AS f, nullif(json_extract(before, '$.server.{f}')::VARCHAR, 'null') AS b, nullif(json_extract(after, '$.server.{f}')::VARCHAR, 'null') AS a FROM docs"
_FIELDS = f"{_DOCS}, x AS ({_FIELD.format(f='title')} UNION ALL {_FIELD.format(f='website')})"


def listing_pairs(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey").selectExpr("o_orderkey as key", f"{_SIDES['before']} as before", f"{_SIDES['after']} as after")


@query(f"WITH {_FIELDS} SELECT key, 'server_field_changed' AS kind, 'server/' || f AS path FROM x WHERE a IS DISTINCT FROM b")
def q106_typed_fields(spark, d):
    """Members whose JSON differs in value or only in type; null is absent."""
    return changesets.listing_rows(listing_pairs(spark, d), "key", "before", "after").select("key", "kind", "path")


_TYPED_TOOL = "concat('{{\"inputSchema\":{{\"properties\":{{\"p\":{{\"type\":', {kind}, '}}}}}},\"name\":\"t\",\"title\":', {title}, '}}')"
_TYPED_MANIFEST = "concat('{{\"protocolVersion\":', {protocol}, ',\"tools\":[', {tool}, ']}}')"
_PART_SIDES = {
    side: _TYPED_MANIFEST.format(protocol=_LOOK.format(p), tool=_TYPED_TOOL.format(kind=_LOOK.format(k), title=_LOOK.format(t)))
    for side, p, k, t in (("before", "p_partkey", "p_size", "p_partkey + 1"), ("after", "p_partkey + p_size % 2", "p_size + p_partkey % 2", "p_partkey + 1 + p_size % 3"))
}
_PART_FIELD = "SELECT p_partkey AS key, {kind} AS kind, {path} AS path FROM part WHERE nullif(json_extract({before}, '{at}')::VARCHAR, 'null') IS DISTINCT FROM nullif(json_extract({after}, '{at}')::VARCHAR, 'null')"


@query(" UNION ALL ".join(
    _PART_FIELD.format(kind=repr(kind), path=repr(path), at=at, **_PART_SIDES)
    for kind, path, at in (
        ("manifest_field_changed", "protocolVersion", "$.protocolVersion"), ("tool_field_changed", "tools/t/title", "$.tools[0].title"),
        ("param_type_changed", "tools/t/inputSchema/properties/p", "$.tools[0].inputSchema.properties.p.type"),
    )
))
def q107_typed_manifest_fields(spark, d):
    pairs = spread(table(spark, d, "part").select("p_partkey", "p_size"), "p_partkey").selectExpr("p_partkey as key", f"{_PART_SIDES['before']} as before", f"{_PART_SIDES['after']} as after")
    return changesets.manifest_changes(pairs, "key", "before", "after").select("key", "kind", "path")


_PYTHON = "CASE WHEN {0} IN ('1', '1.0', 'true') THEN '1' WHEN {0} = '[1,true]' THEN '[1,1]' ELSE {0} END"


@query(f"""WITH {_FIELDS}, y AS (SELECT key, f, {_PYTHON.format('b')} AS b, {_PYTHON.format('a')} AS a FROM x), c AS (SELECT * FROM y WHERE a IS DISTINCT FROM b)
SELECT f AS field, count(*) AS n, count(*) / (SELECT count(*) FROM docs)::DOUBLE AS share FROM c GROUP BY f""")
def q108_python_field_frequency(spark, d):
    """How often each member of the server changes as Python compares: 1, 1.0 and true are equal."""
    pairs = listing_pairs(spark, d).select("key", *[F.get_json_object(c, "$.server").alias(c) for c in ("before", "after")])
    return records.field_frequency(pairs.withColumn("fields", changed_members(F.col("before"), F.col("after"), "python")), "fields")


@query(f"WITH {catalog._EVENT_STEPS}{catalog._WALK}SELECT key, obs_id, verdict, from_id AS from_obs FROM (SELECT key, obs_id, verdict, CASE WHEN verdict <> 'new' THEN from_id END AS from_id FROM v)")
def q109_walk_in_parts(spark, d):
    """The walk of each key in days, each from the state that the days before it leave."""
    return chain.verdicts(catalog.event_steps(spark, d), part="day").select("key", "obs_id", "verdict", "from_obs")


_MARK = "(SELECT (epoch_ms(max(ts)) - (epoch_ms(max(ts)) - epoch_ms(min(ts))) // 2) * 1000 FROM events)"


@query(f"WITH {catalog._EVENT_STEPS}{catalog._WALK}SELECT key, obs_id, verdict FROM v WHERE epoch_us(eff) < {_MARK}")
def q110_late_stream(spark, d):
    """The walk as a stream over events that land up to a sixth of all time too late: all that the watermark has passed."""
    events = catalog.event_steps(spark, d)
    span = events.agg(F.unix_millis(F.min("at")).alias("first"), F.unix_millis(F.max("at")).alias("last")).first()
    width = max(1, (span["last"] - span["first"]) // 6)
    delay = (span["last"] - span["first"]) // 2
    lands = F.floor((F.unix_millis("at") - F.lit(span["first"]) + F.pmod(F.xxhash64("obs_id"), F.lit(width))) / width)
    at = own_folder(spark, "landing")
    for k in range(8):  # whatever the table's size
        events.filter(lands == k).repartition(2).write.mode("append").parquet(at)
    steps = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(at)
    rows, _ = late.landed(spark, steps, f"{delay} milliseconds")
    return late.verdicts(rows.filter(F.unix_micros("at") < (span["last"] - delay) * 1000))


@query("SELECT o_custkey, o_orderdate::VARCHAR AS stamp, min(o_orderpriority) AS o_orderpriority FROM orders GROUP BY o_custkey, o_orderdate")
def q111_exactly_once(spark, d):
    """Orders appended by a stream, appended again by its replay and once more by a later batch, beside a batch that was cut."""
    schema = table(spark, d, "orders").select("o_custkey", F.col("o_orderdate").cast("string").alias("stamp"), "o_orderpriority")
    at = own_folder(spark, "appended")
    kept = ledger.Ledger(spark, at, "o_custkey long, stamp string, o_orderpriority string")
    sink = kept.sink(["o_custkey"], "stamp")
    landed = spark.readStream.schema(table(spark, d, "orders").schema).parquet(f"{d}/[o]rders.parquet")
    stream = landed.select(F.col("o_custkey").cast("long").alias("o_custkey"), F.col("o_orderdate").cast("string").alias("stamp"), "o_orderpriority")
    for turn in range(2):  # the second has lost its checkpoint and reads all again
        stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{at}/state-{turn}").trigger(availableNow=True).start().awaitTermination()
    again = schema.withColumn("o_custkey", F.col("o_custkey").cast("long"))
    sink(again.filter("o_custkey % 2 = 0"), 7)
    kept.write_rows(again.withColumn("stamp", F.lit("never entered")), 8)
    return kept.rows()


# Events stand in for traced system calls, purchases for calls of tools.
_CALL = """CASE WHEN event_type = 'error' THEN 'execve' WHEN event_type = 'purchase' OR event_id % 3 > 0 THEN 'openat' ELSE 'connect' END"""
_ARGS = """CASE WHEN event_type = 'error' THEN '"/bin/sh"' WHEN event_type = 'purchase' THEN 'AT_FDCWD, "/data/out", O_WRONLY|O_CREAT' WHEN event_id % 3 = 0 THEN '3, {sa_family=AF_INET}' WHEN event_id % 3 = 1 THEN 'AT_FDCWD, "/etc/hosts", O_RDONLY'
ELSE 'AT_FDCWD, "/root/.ssh/id_rsa", O_RDONLY' END"""
_SEEN = """w AS (SELECT user_id, event_id AS tool, ts AS a, ts + INTERVAL 1 HOUR AS b FROM events WHERE event_type = 'purchase'),
inside AS (SELECT w.user_id, tool, event_type AS t, event_id FROM w JOIN events e ON e.user_id = w.user_id AND e.ts BETWEEN a AND b),
seen AS (SELECT user_id, tool, event_id, unnest(CASE WHEN t = 'error' THEN ['subprocess'] WHEN t = 'purchase' THEN ['filesystem_write'] WHEN event_id % 3 = 0 THEN ['network'] WHEN event_id % 3 = 1 THEN []
ELSE ['credential_access', 'filesystem_read'] END) AS capability FROM inside)"""


def seen_in_calls(spark: SparkSession, d: str) -> DataFrame:
    """(user_id, tool, event_id, capability): what each purchase's hour of events shows."""
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    windows = e.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("tool"), F.col("ts").alias("start"), F.col("ts").alias("end"))
    windows = windows.withColumn("end", F.expr("end + interval 1 hour"))
    traced = e.selectExpr("user_id", "event_id", "ts as at", f"{_CALL} as call", f"{_ARGS} as args")
    inside = divergence.in_windows(traced, windows, "user_id")
    return inside.select("user_id", "tool", "event_id", F.explode(divergence.observed_all(F.col("call"), F.col("args"))).alias("capability"))


@query(f"WITH {_SEEN} SELECT tool, event_id, capability FROM seen")
def q112_events_of_calls(spark, d):
    return seen_in_calls(spark, d).select("tool", "event_id", "capability")


@query(f"""WITH {_SEEN}, said AS (SELECT event_id AS tool, unnest(CASE event_id % 4 WHEN 0 THEN ['network'] WHEN 1 THEN ['subprocess'] WHEN 2 THEN ['filesystem_read', 'filesystem_write'] ELSE [] END) AS capability FROM events WHERE event_type = 'purchase'),
found AS (SELECT DISTINCT user_id, tool, CASE capability WHEN 'network' THEN 'undeclared_network' WHEN 'subprocess' THEN 'undeclared_subprocess' WHEN 'credential_access' THEN 'undeclared_credential_access' ELSE 'undeclared_filesystem' END AS class
  FROM seen WHERE NOT EXISTS (SELECT 1 FROM said WHERE said.tool = seen.tool AND said.capability = seen.capability)),
t AS (SELECT class, count(*) AS tools FROM found GROUP BY class UNION ALL SELECT 'all', count(DISTINCT (user_id, tool)) FROM found), n AS (SELECT count(*) AS exercised FROM w), z AS (SELECT 1.959963984540054::DOUBLE AS z)
SELECT class, tools, exercised, tools / exercised::DOUBLE AS rate,
  greatest(0, (tools / exercised + z * z / (2 * exercised) - z * sqrt(tools / exercised * (1 - tools / exercised) / exercised + z * z / (4 * exercised * exercised))) / (1 + z * z / exercised)) AS low,
  least(1, (tools / exercised + z * z / (2 * exercised) + z * sqrt(tools / exercised * (1 - tools / exercised) / exercised + z * z / (4 * exercised * exercised))) / (1 + z * z / exercised)) AS high FROM t, n, z""")
def q113_divergence_report(spark, d):
    """From traced calls and the tools' own words to rates with bounds, as a whole and by class."""
    tools = table(spark, d, "events").filter("event_type = 'purchase'").selectExpr(
        "user_id", "event_id as tool", "concat('{\"description\":\"', element_at(array('reaches a url', 'runs a shell', 'saves and reads files', 'plain'), cast(event_id % 4 + 1 as int)), '\",\"name\":\"t\"}') as document",
    )
    said = tools.select("user_id", "tool", F.explode(divergence.declared_tool(F.col("document"))["capability"]).alias("capability"))
    seen = seen_in_calls(spark, d).select("user_id", "tool", "capability", F.col("event_id").cast("string").alias("evidence"))
    return divergence.report(tools, seen, said, records.divergence_class(F.col("capability")), ["user_id", "tool"])


_STATES = """r AS (SELECT o_custkey AS key, o_orderkey AS obs_id, o_orderdate AS eff, o_orderkey % 3 AS run, concat(o_orderpriority, '|', o_orderkey % 100) AS body FROM orders),
s AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY key, run ORDER BY eff DESC, obs_id DESC) = 1), o AS (SELECT *, lag(body) OVER (PARTITION BY key ORDER BY run) IS DISTINCT FROM body AS fresh FROM s)"""


def snapshot(spark: SparkSession, d: str, run: int) -> DataFrame:
    return table(spark, d, "orders").filter(F.col("o_orderkey") % 3 == run).selectExpr(
        "o_custkey as key", "o_orderkey as obs_id", "cast(o_orderdate as timestamp) as at", "concat(o_orderpriority, '|', o_orderkey % 100) as body"
    )


@query(f"""WITH {_STATES} SELECT key, min(eff)::DATE::VARCHAR AS first_seen, max(eff)::DATE::VARCHAR AS last_seen, sha256(arg_max(body, run)) AS sha, count(*) FILTER (fresh) AS observations FROM o GROUP BY key""")
def q114_snapshot_cycles(spark, d):
    """Three snapshots in one store, the last two of them written twice."""
    store = Store(spark, own_folder(spark, "store"))
    for run in (0, 1, 1, 2, 1, 2):
        store.write_run(run, snapshot(spark, d, run))
    servers = store.servers()
    return servers.select("key", *[F.date_format(c, "yyyy-MM-dd").alias(c) for c in ("first_seen", "last_seen")], "sha", "observations")


@query(f"WITH {_STATES} SELECT DISTINCT sha256(body) AS sha, 'missing' AS fault FROM o WHERE fresh AND sha256(body) LIKE '0%' AND body IN (SELECT body FROM r WHERE run = 0)")
def q115_mirror_damage(spark, d):
    """A mirror made in two steps, of which the second copies one run; then bodies of its first run are lost."""
    at = own_folder(spark, "mirror")
    store, copy = Store(spark, f"{at}/store"), Store(spark, f"{at}/copy")
    for run in (0, 1):
        store.write_run(run, snapshot(spark, d, run))
    steps = [mirror(store, copy), mirror(store, copy)]
    store.write_run(2, snapshot(spark, d, 2))
    steps.append(mirror(store, copy))
    if steps != [2, 0, 1] or not copy.damage().isEmpty():
        raise AssertionError(f"the mirror copied {steps} runs")
    copy._write(store.read("blobs").filter("of_run = 0 and sha not like '0%'").drop("of_run"), "blobs", 0)
    return copy.damage()


_RATERS = """u AS (SELECT doc_id, 'quality' AS rater, quality AS label FROM labels UNION ALL SELECT doc_id, 'toxic', 1 - toxic FROM labels UNION ALL SELECT doc_id, 'thirds', CAST(doc_id % 3 = 0 AS INTEGER) FROM labels WHERE doc_id % 5 > 0),
p AS (SELECT a.rater AS first, b.rater AS second, a.label AS x, b.label AS y FROM u a JOIN u b ON a.doc_id = b.doc_id AND a.rater < b.rater WHERE a.label IS NOT NULL AND b.label IS NOT NULL)"""


@query(f"""WITH {_RATERS}, n AS (SELECT first, second, count(*) AS n, count(*) FILTER (x = y) / count(*)::DOUBLE AS observed,
  (count(*) FILTER (x = 1) * count(*) FILTER (y = 1) + count(*) FILTER (x = 0) * count(*) FILTER (y = 0)) / (count(*)::DOUBLE * count(*)) AS expected FROM p GROUP BY ALL)
SELECT first, second, n, CASE WHEN expected < 1 THEN (observed - expected) / (1 - expected) END AS kappa, coalesce(n >= 50 AND (observed - expected) / nullif(1 - expected, 0) >= 0.6, false) AS passes FROM n""")
def q116_rater_kappas(spark, d):
    """Agreement of each pair of raters beyond chance, and whether it is enough to go on."""
    t = table(spark, d, "labels")
    raters = [("quality", F.col("quality"), F.lit(True)), ("toxic", 1 - F.col("toxic"), F.lit(True)), ("thirds", (F.col("doc_id") % 3 == 0).cast("int"), F.col("doc_id") % 5 > 0)]
    each = t.select("doc_id", F.explode(F.array(*[F.struct(F.lit(n).alias("rater"), F.when(who, label.cast("int")).alias("label")) for n, label, who in raters])).alias("o")).select("doc_id", "o.*")
    return stats.kappa_gate(stats.rater_pairs(each, "doc_id", "rater", "label"), 0.6, 50)


_EVENT_LINES = """concat('{"at":"', strftime(eff, '%Y-%m-%d'), '","content":', coalesce('"' || content || '"', 'null'), ',"from_obs":', coalesce(from_id::VARCHAR, 'null'), ',"key":', key, ',"obs_id":', obs_id, ',"verdict":"', verdict, '"}')"""


@query(f"WITH {catalog._STEPS}{catalog._WALK}SELECT {_EVENT_LINES} AS line FROM (SELECT key, obs_id, eff, verdict, CASE WHEN NOT absent THEN content END AS content, CASE WHEN verdict <> 'new' THEN from_id END AS from_id FROM v)")
def q117_change_lines(spark, d):
    """Change sets as lines of JSON with sorted names and nulls kept, as they are written and read again."""
    v = chain.verdicts(catalog.order_steps(spark, d))
    rows = v.select("verdict", "key", "obs_id", F.date_format("at", "yyyy-MM-dd").alias("at"), F.when(~F.col("absent"), F.col("content")).alias("content"), "from_obs")
    at = own_folder(spark, "lines") + "/json"
    records.write_lines(rows, at)
    return spark.read.text(at).withColumnRenamed("value", "line")


_FAILURES = ["auth_required", "protocol", "timeout", "tls", "connect", "too_many_redirects", "transport", "value", "other"]


@query("""WITH f AS (SELECT event_id, event_id % 9 AS k, CASE WHEN event_id % 2 = 0 THEN 'SSL: CERTIFICATE expired' ELSE 'refused' END AS detail FROM events)
SELECT CASE WHEN k = 0 THEN 'auth_required' WHEN k IN (1, 5, 7, 8) THEN 'protocol_error' WHEN k = 2 THEN 'timeout' ELSE 'unreachable' END AS status,
CASE k WHEN 0 THEN 'auth_required' WHEN 1 THEN 'mcp_protocol_error' WHEN 3 THEN 'tls_error' WHEN 4 THEN CASE WHEN event_id % 2 = 0 THEN 'tls_error' ELSE 'connect_error' END WHEN 5 THEN 'too_many_redirects'
ELSE 'Named' END AS class, count(*) AS n FROM f GROUP BY ALL""")
def q118_probe_failures(spark, d):
    kind = F.element_at(F.array(*map(F.lit, _FAILURES)), (F.col("event_id") % 9 + 1).cast("int"))
    told = F.when(F.col("event_id") % 2 == 0, "SSL: CERTIFICATE expired").otherwise("refused")
    found = table(spark, d, "events").select(records.probe_failure(kind, F.lit("Named"), told).alias("f"))
    return found.groupBy("f.status", "f.class").agg(F.count("*").alias("n"))


_RUN_STATS = """concat('{"kept":', o_custkey, ',"pages":', o_orderkey % 10, CASE WHEN o_orderkey % 3 = 0 THEN concat(',"errors":', o_custkey % 4) ELSE '' END, '}')"""


@query("SELECT o_orderpriority AS collector, count(*) AS runs, sum(o_orderkey % 10)::BIGINT AS pages, coalesce(sum(CASE WHEN o_orderkey % 3 = 0 THEN o_custkey % 4 END), 0)::BIGINT AS errors, 0::BIGINT AS gone FROM orders GROUP BY 1")
def q119_run_totals(spark, d):
    """Counters of runs, which stand in JSON, summed by collector; a counter that is not there counts 0."""
    runs = table(spark, d, "orders").select(F.col("o_orderpriority").alias("collector"), F.expr(_RUN_STATS).alias("stats"))
    return records.run_totals(runs, "collector", "stats", ["pages", "errors", "gone"])


@query(catalog._GAPS + "SELECT was_status, count(*) AS n, avg(gap) AS mean_days, min(gap) AS least_days, max(gap) AS most_days FROM g GROUP BY was_status")
def q120_gap_means(spark, d):
    steps = table(spark, d, "orders").select(
        F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("obs_id"), F.col("o_orderdate").cast("timestamp").alias("at"), F.col("o_orderstatus").alias("content"),
    )
    return chain.transitions(steps).groupBy(F.col("was").alias("was_status")).agg(
        F.count("*").alias("n"), F.avg("gap_days").alias("mean_days"), F.min("gap_days").alias("least_days"), F.max("gap_days").alias("most_days")
    )
