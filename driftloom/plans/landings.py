"""Queries of captured packets, launches, malformed lines, quotas, rounded rates and the health of backups."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftloom.functions.rounding import rounded
from driftloom.operators import changes, listings, records
from driftloom.plans.registry import query
from driftloom.session import table
from driftloom.sources import landed, packets

# Packets of events, as Spark builds them. A hello's session, ciphers and first extension differ in length,
# its name comes last, and a third of all packets lose up to 31 bytes at their end.
_HOST = "concat(event_type, '.h', user_id, '.example')"
_U16 = "unhex(lpad(hex({}), 4, '0'))"
_NAMED = "concat({n5}, X'00', {n}, encode({host}, 'UTF-8'))".format(host=_HOST, n=_U16.format(f"length({_HOST})"), n5=_U16.format(f"length({_HOST}) + 3"))
_EXTENSIONS = f"concat(X'000A', {_U16.format('event_id % 50')}, unhex(repeat('00', cast(event_id % 50 as int))), X'0000', {_U16.format(f'length({_HOST}) + 5')}, {_NAMED})"
_HELLO = (
    "concat(X'160301FFFF01', unhex(repeat('07', 37)), unhex(lpad(hex(event_id % 33), 2, '0')), unhex(repeat('11', cast(event_id % 33 as int))), "
    f"{_U16.format('2 * (event_id % 20)')}, unhex(repeat('1301', cast(event_id % 20 as int))), X'0100', {_U16.format(f'octet_length({_EXTENSIONS})')}, {_EXTENSIONS})"
)
_QUESTION = (
    "concat(unhex(repeat('00', 12)), unhex(lpad(hex(length(event_type)), 2, '0')), encode(event_type, 'UTF-8'), "
    "unhex(lpad(hex(length(concat('h', user_id))), 2, '0')), encode(concat('h', user_id), 'UTF-8'), X'07', encode('example', 'UTF-8'), X'0000010001')"
)
_LOST = "CASE WHEN event_id % 3 = 0 THEN event_id % 32 ELSE 0 END"


@query(f"""WITH e AS (SELECT event_id, event_id % 4 AS k, {_LOST} AS lost, event_type || '.h' || user_id || '.example' AS host FROM events),
n AS (SELECT *, CASE WHEN k < 2 THEN host[1:greatest(length(host) - lost, 0)] WHEN k = 2 THEN host[1:length(host) - greatest(lost % 13 - 5, 0)] END AS name FROM e)
SELECT event_id, CASE WHEN k = 2 THEN 'DNS ' || name WHEN k < 2 AND name <> '' THEN 'TCP ' || name ELSE 'TCP port ' || event_id % 1000 END AS event FROM n""")
def q121_packet_names(spark, d):
    """Names that packets ask for: three kinds of hellos, whole and cut, lookups, and connections that say nothing."""
    k = F.col("event_id") % 4
    body = F.when(k < 2, F.expr(_HELLO)).when(k == 2, F.expr(_QUESTION)).otherwise(F.lit(b"GET / HTTP/1.1"))
    lost = F.when(k < 2, F.expr(_LOST)).when(k == 2, F.expr(f"({_LOST}) % 13")).otherwise(0)
    rows = table(spark, d, "events").withColumn("body", body).select(
        "event_id", F.when(k == 2, "dns").otherwise("tcp").alias("kind"), (F.col("event_id") % 1000).alias("dest_port"),
        F.substring("body", F.lit(1), F.length("body") - lost.cast("int")).alias("data"),
    )
    return packets.packet_events(rows).select("event_id", "event")


_PACKAGE = """concat('{"packageArguments":[{"type":"positional","value":"serve"},', CASE p_size % 4 WHEN 0 THEN '{"type":"named","name":"--size","value":"' || p_size || '"}'
WHEN 1 THEN '{"type":"named","name":"--size","default":' || p_size || '}' WHEN 2 THEN '{"type":"named","value":"lost"}' ELSE '{"type":"named","name":"--flag"},"text"' END,
CASE WHEN p_partkey % 3 = 0 THEN ',{"type":"positional","default":true}' WHEN p_partkey % 3 = 1 THEN ',{"type":"positional","value":null}' ELSE '' END, ']}')"""


@query("""SELECT p_partkey, 'serve' || CASE p_size % 4 WHEN 2 THEN '' WHEN 3 THEN ' --flag' ELSE ' --size ' || p_size END || CASE WHEN p_partkey % 3 = 0 THEN ' True' ELSE '' END AS line FROM part""")
def q122_launch_lines(spark, d):
    """Arguments of packages: positional and named ones, values before defaults."""
    packages = table(spark, d, "part").select("p_partkey", F.expr(_PACKAGE).alias("package"))
    return packages.select("p_partkey", F.array_join(listings.launch_arguments(F.col("package")), " ").alias("line"))


@query("""WITH g AS (SELECT l_quantity::BIGINT AS quantity, count(*) AS n FROM lineitem GROUP BY 1), t AS (SELECT count(*) AS total FROM lineitem)
SELECT quantity, n, ((quantity * 25) // 2 + CASE WHEN (quantity * 25) % 2 = 1 AND (quantity * 25) // 2 % 2 = 1 THEN 1 ELSE 0 END) / 100 AS eighth,
round(n / total, 6) AS share FROM g, t""")
def q123_rounded_rates(spark, d):
    """Rates of reports as they are rounded: eighths are ties at two digits and go to the even one."""
    rows = table(spark, d, "lineitem").groupBy(F.col("l_quantity").cast("long").alias("quantity")).agg(F.count("*").alias("n"))
    total = rows.agg(F.sum("n").alias("total"))  # one row
    return rows.join(F.broadcast(total)).select("quantity", "n", rounded(F.col("quantity") / 8, 2).alias("eighth"), rounded(F.col("n") / F.col("total"), 6).alias("share"))


@query("""WITH s AS (SELECT c_mktsegment || '/' || c_nationkey % 5 AS stratum, count(*) AS size FROM customer GROUP BY 1), p AS (SELECT *, least(size, greatest(5, round_even(200 * size / (sum(size) OVER ())::DOUBLE, 0)::BIGINT)) AS start FROM s),
r AS (SELECT *, 200 - sum(start) OVER () AS drift, greatest(start - 5, 0) AS above, size - start AS below FROM p),
c AS (SELECT *, coalesce(sum(above) OVER (ORDER BY size DESC, stratum ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above_before, coalesce(sum(below) OVER (ORDER BY size, stratum ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below_before FROM r),
q AS (SELECT stratum, size, (start - least(above, greatest(-drift - above_before, 0)) + least(below, greatest(drift - below_before, 0)))::BIGINT AS quota FROM c),
d AS (SELECT c_custkey, c_mktsegment || '/' || c_nationkey % 5 AS stratum, row_number() OVER (PARTITION BY c_mktsegment || '/' || c_nationkey % 5 ORDER BY md5('7|' || c_custkey), c_custkey) AS k FROM customer)
SELECT c_custkey, d.stratum, size, quota FROM d JOIN q ON d.stratum = q.stratum WHERE k <= quota""")
def q124_stratified_quotas(spark, d):
    """A draw of 200 customers with the size and quota of each stratum, which is what weights need."""
    rows = table(spark, d, "customer").select("c_custkey", F.concat("c_mktsegment", F.lit("/"), (F.col("c_nationkey") % 5).cast("string")).alias("stratum"))
    own = changes.quotas(rows.groupBy("stratum").agg(F.count("*").alias("size")), "stratum", "size", 200)
    return changes.stratified(rows, "stratum", "c_custkey", 200, 7).join(own, "stratum")


@query("""WITH m AS (SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS k FROM orders WHERE o_orderstatus <> 'O' GROUP BY o_custkey)
SELECT o_custkey, CASE WHEN k % 7 > 0 THEN k END AS servers, CASE WHEN k % 7 > 0 THEN (k % 10) / 10 END AS rate FROM m""")
def q125_latest_stats(spark, d):
    """What the newest finished run of each collector counted; a run whose record is no object tells nothing."""
    text = """concat(CASE WHEN o_orderkey % 7 = 0 THEN '["' ELSE '{"' END, lpad(o_orderkey, 12, '0'), CASE WHEN o_orderkey % 7 = 0 THEN '"]' ELSE concat('":0,"servers":', o_orderkey, ',"rate":', (o_orderkey % 10) / 10.0D, '}') END)"""
    finished = F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate"))
    runs = table(spark, d, "orders").select("o_custkey", F.struct("o_orderdate", "o_orderkey").alias("started"), finished.alias("finished"), F.expr(text).alias("stats"))
    return records.latest_stats(runs, "o_custkey", "started", "finished", "stats", {"servers": "bigint", "rate": "double"})


_LINE = """CASE event_id % 6 WHEN 0 THEN '[1]' WHEN 1 THEN '{"server":"text"}' WHEN 2 THEN '{"server":{"name":5}}' WHEN 3 THEN '{"server":{"name":"  "}}' WHEN 4 THEN 'no json {'
ELSE concat('{"server":{"name":" ', event_type, '/', user_id, ' "}}') END"""


@query("""SELECT CASE event_id % 6 WHEN 0 THEN 'not_an_object' WHEN 1 THEN 'no_server' WHEN 4 THEN 'not_an_object' ELSE 'no_name' END AS fault, count(*) AS n FROM events WHERE event_id % 6 < 5 GROUP BY 1""")
def q126_malformed_lines(spark, d):
    """How many lines of a listing are malformed, by cause."""
    return landed.fault_counts(landed.parsed_rows(table(spark, d, "events").select(F.expr(_LINE).alias("document"))))


@query("""SELECT CASE WHEN event_id % 5 = 0 THEN 'timeout' WHEN event_id % 5 = 1 THEN 'nondeterministic' ELSE 'ok' END AS status,
CASE WHEN event_id % 5 = 0 THEN 'timeout' WHEN event_id % 5 = 1 THEN 'hash_disagreement' WHEN user_id % 2 = 0 THEN 'attempted_egress' END AS error_class,
CASE WHEN event_id % 5 = 0 THEN 'late' ELSE nullif(trim(CASE WHEN event_id % 5 = 1 THEN 'the two launches produced different normalized manifests' ELSE '' END
|| CASE WHEN user_id % 2 = 0 THEN ' attempted egress to [''443'', ''h' || event_type || ''']' ELSE '' END), '') END AS error_detail, count(*) AS n FROM events GROUP BY ALL""")
def q127_launches(spark, d):
    """Servers that were launched twice, and what they reached."""
    mod = F.col("event_id") % 5
    reached = F.when(F.col("user_id") % 2 == 0, F.array(F.concat(F.lit("h"), "event_type"), F.lit("443"), F.lit("443")))
    found = records.launch_observation(F.when(mod == 0, "timeout"), F.lit("late"), F.lit("a"), F.when(mod == 1, "b").otherwise("a"), reached)
    return table(spark, d, "events").select(found.alias("f")).groupBy("f").agg(F.count("*").alias("n")).select("f.*", "n")


@query("""WITH b AS (SELECT max(ts) AS newest, arg_max(event_id % 2 = 0, (ts, event_id % 2 = 0)) AS verified FROM events WHERE event_type = 'purchase'), n AS (SELECT max(ts) AS now FROM events)
SELECT 'backup.present' AS name, true AS ok UNION ALL SELECT 'backup.freshness', now - newest <= INTERVAL 36 HOUR FROM b, n UNION ALL SELECT 'backup.verified', verified FROM b""")
def q128_backup_checks(spark, d):
    """Whether the newest backup is fresh at the end of all events, and verified."""
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    now = e.agg(F.max("ts").alias("now")).first()["now"]
    backups = e.filter("event_type = 'purchase'").select(records.to_iso(F.col("ts")).alias("created_at"), (F.col("event_id") % 2 == 0).alias("verified"))
    return records.backup_checks(backups, F.lit(now))


@query("""SELECT split_part(c_mktsegment || '/' || c_custkey, '/', 1) AS namespace, count(*) AS n FROM customer GROUP BY 1""")
def q129_namespaces(spark, d):
    key = F.concat("c_mktsegment", F.lit("/"), F.col("c_custkey").cast("string"))
    return table(spark, d, "customer").groupBy(records.namespace(key).alias("namespace")).agg(F.count("*").alias("n"))
