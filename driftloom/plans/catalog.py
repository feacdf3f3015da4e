"""Catalogue: each snapshot-analytics operator over the driver's tables, with its DuckDB SQL.

Orders are histories: a customer is a key, an order an observation, its priority the content and
status P an absence. Events are histories of users in the same way; conversations are texts that
change from turn to turn; labels are two raters' opinions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftloom.functions import canonical, text
from driftloom.operators import chain, changes, divergence, ingest, severity, stats
from driftloom.plans.registry import oracle_sql, query, queries  # noqa: F401
from driftloom.session import table

def order_steps(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(
        F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("obs_id"), F.col("o_orderdate").cast("timestamp").alias("at"),
        F.col("o_orderpriority").alias("content"), (F.col("o_orderstatus") == "P").alias("absent"),
    )


def event_steps(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(
        F.col("user_id").alias("key"), F.col("event_id").alias("obs_id"), F.col("ts").cast("timestamp").alias("at"),
        F.col("event_type").alias("content"), (F.col("event_type") == "error").alias("absent"),
    )


_STEPS = "steps AS (SELECT o_custkey AS key, o_orderkey AS obs_id, o_orderdate AS eff, o_orderpriority AS content, o_orderstatus = 'P' AS absent FROM orders)"
_EVENT_STEPS = "steps AS (SELECT user_id AS key, event_id AS obs_id, ts AS eff, event_type AS content, event_type = 'error' AS absent FROM events)"
_WALK = """,
walked AS (SELECT *, last_value(CASE WHEN NOT absent THEN obs_id END IGNORE NULLS) OVER p AS from_id,
  last_value(CASE WHEN NOT absent THEN content END IGNORE NULLS) OVER p AS from_c, coalesce(lag(absent) OVER o, false) AS gone FROM steps
  WINDOW p AS (PARTITION BY key ORDER BY eff, obs_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), o AS (PARTITION BY key ORDER BY eff, obs_id)),
emitted AS (SELECT *, CASE WHEN absent AND from_id IS NOT NULL AND NOT gone THEN 'disappeared' WHEN absent THEN NULL WHEN from_id IS NULL THEN 'new'
  WHEN gone THEN 'returned' WHEN from_c <> content THEN 'mutated' END AS verdict FROM walked),
v AS (SELECT * FROM emitted WHERE verdict IS NOT NULL)
"""
_GAPS = """WITH t AS (SELECT o_custkey AS key, o_orderdate AS eff, o_orderpriority AS content, lag(o_orderdate) OVER w AS was_at, lag(o_orderpriority) OVER w AS was,
  lag(o_orderstatus) OVER w AS was_status, o_orderstatus AS status, row_number() OVER w AS rn FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
g AS (SELECT *, (epoch_us(eff) - epoch_us(was_at)) / 86400000000.0::DOUBLE AS gap FROM t WHERE rn > 1) """
_PAIRS = """WITH t AS (SELECT conv_id, turn, text AS after, lag(text) OVER w AS before, row_number() OVER w AS rn FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
p AS (SELECT * FROM t WHERE rn > 1) """


@query(f"WITH {_STEPS}{_WALK}SELECT verdict, count(*) AS n FROM v GROUP BY verdict")
def q01_chain_verdict_counts(spark, d):
    return chain.verdicts(order_steps(spark, d)).groupBy("verdict").agg(F.count("*").alias("n"))


@query(f"""WITH {_STEPS}{_WALK}SELECT key, obs_id, verdict, CASE WHEN verdict <> 'new' THEN from_id END AS from_obs, content,
substr(sha256(concat(key, '|', coalesce(CAST(CASE WHEN verdict <> 'new' THEN from_id END AS VARCHAR), '-'), '|', obs_id)), 1, 16) AS change_id FROM v""")
def q02_chain_rows(spark, d):
    return chain.verdicts(order_steps(spark, d)).select("key", "obs_id", "verdict", "from_obs", "content", "change_id")


@query(f"WITH {_STEPS.replace('FROM orders)', "FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01')")}{_WALK}SELECT verdict, count(*) AS n FROM v WHERE eff >= TIMESTAMP '1995-01-01' GROUP BY verdict")
def q03_since_and_until(spark, d):
    found = chain.verdicts(order_steps(spark, d), since=F.lit("1995-01-01").cast("timestamp"), until=F.lit("1998-01-01").cast("timestamp"))
    return found.groupBy("verdict").agg(F.count("*").alias("n"))


@query(f"""WITH {_EVENT_STEPS}{_WALK}, q AS (SELECT DISTINCT user_id AS key FROM events WHERE event_type = 'signup')
SELECT verdict, q.key IS NOT NULL AS quarantined, count(*) AS n FROM v LEFT JOIN q USING (key) GROUP BY ALL""")
def q04_quarantine(spark, d):
    steps = event_steps(spark, d)
    unstable = steps.filter("content = 'signup'").select("key").distinct().withColumn("u", F.lit(True))
    marked = chain.verdicts(steps).join(unstable, "key", "left")
    return marked.groupBy("verdict", F.coalesce("u", F.lit(False)).alias("quarantined")).agg(F.count("*").alias("n"))


@query("SELECT o_custkey, o_orderkey, o_orderstatus, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def q05_latest_per_key(spark, d):
    return chain.latest(table(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_orderstatus", "o_totalprice"])


@query("""SELECT c_custkey, c_name FROM customer c WHERE (SELECT o_orderstatus FROM orders o WHERE o.o_custkey = c.c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) = 'O'""")
def q06_latest_is_open(spark, d):
    last = chain.latest(table(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_orderstatus"]).filter("o_orderstatus = 'O'")
    return table(spark, d, "customer").join(last, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01')")
def q07_absent_keys(spark, d):
    seen = table(spark, d, "orders").filter("o_orderdate >= timestamp_ntz'1997-01-01'").select(F.col("o_custkey").alias("c_custkey"))
    return ingest.absent_keys(table(spark, d, "customer").select("c_custkey"), seen, "c_custkey")


@query("SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def q08_pending(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id", "left_anti")


@query("""SELECT c_custkey, count(DISTINCT o_orderdate) AS versions FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P'
GROUP BY c_custkey HAVING count(DISTINCT o_orderdate) <> 1""")
def q09_verify_targets(spark, d):
    held = table(spark, d, "orders").filter("o_orderstatus = 'P'")
    joined = table(spark, d, "customer").join(held, F.col("o_custkey") == F.col("c_custkey"), "left")
    return joined.groupBy("c_custkey").agg(F.countDistinct("o_orderdate").alias("versions")).filter("versions <> 1")


@query("""SELECT o_custkey, min(o_orderdate) AS first_seen, max(o_orderdate) AS last_seen, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS o_orderpriority FROM orders GROUP BY o_custkey""")
def q10_fold(spark, d):
    return ingest.fold_servers(table(spark, d, "orders"), "o_custkey", ["o_orderpriority"], "o_orderdate", "o_orderkey")


@query("""SELECT o_custkey, o_orderkey, o_orderpriority FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, coalesce(nullif(o_orderpriority, '5-LOW'), '') ORDER BY o_orderdate, o_orderkey) = 1""")
def q11_first_identities(spark, d):
    rows = table(spark, d, "orders").withColumn("p", F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")))
    return ingest.first_identities(rows, ["o_custkey", "p"], "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey", "o_orderpriority")


_HELD = "SELECT o_custkey, o_orderpriority, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END AS stamp, o_orderkey FROM orders WHERE o_orderkey % 2 = {}"


@query(f"""WITH h AS ({_HELD.format(0)}), i AS ({_HELD.format(1)}) SELECT i.o_orderkey FROM i WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.o_custkey = i.o_custkey
AND h.o_orderpriority = i.o_orderpriority AND h.stamp IS NOT DISTINCT FROM i.stamp)""")
def q12_idempotent_ingest(spark, d):
    rows = table(spark, d, "orders").withColumn("stamp", F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")))
    fresh = ingest.new_versions(rows.filter("o_orderkey % 2 = 0"), rows.filter("o_orderkey % 2 = 1"), ["o_custkey", "o_orderpriority"], "stamp")
    return fresh.select("o_orderkey")


@query("""WITH r AS (SELECT CAST(ts AS DATE) AS day, min(ts) AS started_at, count(*) FILTER (event_type = 'error') AS errors, count(*) AS n FROM events GROUP BY day)
SELECT max(started_at) - INTERVAL 1 HOUR AS mark FROM r WHERE errors * 4 < n""")
def q13_water_mark(spark, d):
    runs = table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(
        F.min("ts").alias("started_at"), F.count_if(F.col("event_type") == "error").alias("errors"), F.count("*").alias("n"))
    return ingest.water_mark(runs, F.col("errors") * 4 < F.col("n"), 3600)


_VERSIONS = [("1", 1), ("2-4", 4), ("5-9", 9), ("10-19", 19), ("20-99", 99), ("100+", None)]
_GAP_DAYS = [("same", 0), ("<=1", 1), ("<=7", 7), ("<=30", 30), ("<=90", 90), ("<=365", 365), (">365", None)]


def _histogram_sql(value: str, source: str, ceilings) -> str:
    when = " ".join(f"WHEN {value} <= {c} THEN '{n}'" for n, c in ceilings if c is not None)
    names = ", ".join(f"('{n}')" for n, _ in ceilings)
    return f"SELECT b AS bucket, count({value}) AS n FROM (VALUES {names}) AS x(b) LEFT JOIN (SELECT {value}, CASE {when} ELSE '{ceilings[-1][0]}' END AS k FROM {source}) ON k = b GROUP BY b"


@query(_histogram_sql("c", "(SELECT count(DISTINCT o_orderdate) AS c FROM orders GROUP BY o_custkey)", _VERSIONS))
def q14_version_histogram(spark, d):
    counts = table(spark, d, "orders").groupBy("o_custkey").agg(F.countDistinct("o_orderdate").alias("c"))
    return stats.histogram(counts, F.col("c"), _VERSIONS)


@query(_GAPS + _histogram_sql("gap", "g", _GAP_DAYS))
def q15_gap_histogram(spark, d):
    return stats.histogram(chain.transitions(order_steps(spark, d)), F.col("gap_days"), _GAP_DAYS)


_FRACTIONS = [0.1, 0.25, 0.5, 0.75, 0.9, 1.0]


@query(_GAPS + """, s AS (SELECT list(gap ORDER BY gap) AS v, count(*) AS n FROM g) SELECT f AS fraction, v[1 + least(n - 1, CAST(floor(f * n) AS BIGINT))] AS gap_days
FROM s, (VALUES (0.1::DOUBLE), (0.25), (0.5), (0.75), (0.9), (1.0)) AS x(f)""")
def q16_nearest_rank(spark, d):
    return stats.nearest_rank(chain.transitions(order_steps(spark, d)), "gap_days", _FRACTIONS)


@query(_GAPS + "SELECT count(*) AS n, median(gap) AS median_days, min(gap) AS min_days, max(gap) AS max_days FROM g")
def q17_gap_summary(spark, d):
    g = chain.transitions(order_steps(spark, d))
    bounds = g.agg(F.count("gap_days").alias("n"), F.min("gap_days").alias("min_days"), F.max("gap_days").alias("max_days"))
    return bounds.join(F.broadcast(stats.median(g, "gap_days").withColumnRenamed("median_gap_days", "median_days")))  # one row each


@query(_GAPS + "SELECT concat(coalesce(was_status, '?'), ' -> ', status) AS step, count(*) AS n FROM g GROUP BY step")
def q18_status_transitions(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("obs_id"), F.col("o_orderdate").cast("timestamp").alias("at"), F.col("o_orderstatus").alias("content"))
    t = chain.transitions(rows)
    return t.groupBy(F.concat_ws(" -> ", F.coalesce("was", F.lit("?")), "content").alias("step")).agg(F.count("*").alias("n"))


_R = "r AS (SELECT doc_id, quality AS a, 1 - toxic AS b FROM labels)"


@query(f"""WITH {_R}, t AS (SELECT count(*) AS n, count(*) FILTER (a = b) / count(*)::DOUBLE AS observed FROM r),
m AS (SELECT sum(x.n * y.n) AS s FROM (SELECT a AS l, count(*) AS n FROM r GROUP BY a) x JOIN (SELECT b AS l, count(*) AS n FROM r GROUP BY b) y USING (l)),
k AS (SELECT n, observed, s / (n::DOUBLE * n) AS expected FROM t, m) SELECT n, observed, expected, (observed - expected) / (1 - expected) AS kappa FROM k""")
def q19_kappa(spark, d):
    return stats.kappa(table(spark, d, "labels").select(F.col("quality").alias("x"), (1 - F.col("toxic")).alias("y")), "x", "y")


@query(f"""WITH {_R}, p AS (SELECT l AS label, a = l AS a, b = l AS b FROM r, (VALUES (0), (1)) AS x(l)), t AS (SELECT label, count(*) AS n, count(*) FILTER (a = b) / count(*)::DOUBLE AS observed,
(count(*) FILTER (a) * count(*) FILTER (b) + count(*) FILTER (NOT a) * count(*) FILTER (NOT b)) / (count(*)::DOUBLE * count(*)) AS expected FROM p GROUP BY label)
SELECT *, (observed - expected) / (1 - expected) AS kappa FROM t""")
def q20_kappa_per_class(spark, d):
    rows = table(spark, d, "labels").select(F.col("quality").alias("x"), (1 - F.col("toxic")).alias("y"), F.explode(F.array(F.lit(0), F.lit(1))).alias("label"))
    return stats.kappa(rows.select("label", (F.col("x") == F.col("label")).alias("x"), (F.col("y") == F.col("label")).alias("y")), "x", "y", ["label"])


@query(f"WITH {_R} SELECT a, b, count(*) AS n FROM r GROUP BY a, b")
def q21_confusion(spark, d):
    return table(spark, d, "labels").groupBy(F.col("quality").alias("a"), (1 - F.col("toxic")).alias("b")).agg(F.count("*").alias("n"))


@query(f"WITH {_R} SELECT b AS label, count(*) AS hits, count(*) FILTER (a = b) / count(*)::DOUBLE AS precision FROM r GROUP BY b")
def q22_precision(spark, d):
    r = table(spark, d, "labels").select(F.col("quality").alias("a"), (1 - F.col("toxic")).alias("label"))
    return r.groupBy("label").agg(F.count("*").alias("hits"), (F.count_if(F.col("a") == F.col("label")) / F.count("*")).alias("precision"))


@query(f"""WITH t AS (SELECT l_suppkey, count(*)::DOUBLE AS n, count(*) FILTER (l_returnflag = 'R')::DOUBLE AS k FROM lineitem GROUP BY l_suppkey), c AS (SELECT *, k / n AS p, {stats.Z95}::DOUBLE AS z FROM t)
SELECT l_suppkey, CAST(n AS BIGINT) AS n, greatest(0.0::DOUBLE, (p + z * z / (2 * n)) / (1 + z * z / n) - z / (1 + z * z / n) * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) >= 0.3 AS surely_high,
least(1.0::DOUBLE, (p + z * z / (2 * n)) / (1 + z * z / n) + z / (1 + z * z / n) * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) <= 0.35 AS surely_low FROM c""")
def q23_wilson(spark, d):
    t = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").cast("double").alias("k"))
    low, high = stats.wilson(F.col("k"), F.col("n").cast("double"))
    return t.select("l_suppkey", "n", (low >= 0.3).alias("surely_high"), (high <= 0.35).alias("surely_low"))


_IDENT = "i AS (SELECT c_custkey AS key, concat(c_nationkey, '/', c_mktsegment) AS repo, CAST(c_nationkey AS VARCHAR) AS endpoint, min(o_orderdate) AS first_seen, max(o_orderdate) AS last_seen FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY ALL)"


@query(f"""WITH {_IDENT}, p AS (SELECT n.key, CASE WHEN n.repo = o.repo THEN 0 ELSE 1 END AS rank, min(o.key) AS old FROM i n JOIN i o ON n.endpoint = o.endpoint AND n.key <> o.key AND o.last_seen <= n.first_seen GROUP BY ALL)
SELECT key, arg_min(old, rank) AS predecessor FROM p GROUP BY key""")
def q24_predecessors(spark, d):
    seen = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.min("o_orderdate").alias("first_seen"), F.max("o_orderdate").alias("last_seen"))
    who = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.concat_ws("/", "c_nationkey", "c_mktsegment").alias("repo"), F.col("c_nationkey").cast("string").alias("endpoint"))
    return changes.predecessors(who.join(seen, "key"))


@query("""WITH t AS (SELECT o_custkey AS key, o_orderkey AS obs_id, o_orderdate AS eff, lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS was FROM orders),
f AS (SELECT o_custkey AS key, o_orderpriority, min(o_orderdate) AS first FROM orders GROUP BY ALL)
SELECT obs_id, EXISTS (SELECT 1 FROM f WHERE f.key = t.key AND f.first > t.was AND f.first <= t.eff) AS moved FROM t WHERE was IS NOT NULL""")
def q25_identity_moved(spark, d):
    t = chain.transitions(order_steps(spark, d)).select("key", "obs_id", "at", "was_at")
    first = order_steps(spark, d).groupBy("key", "content").agg(F.min("at").alias("first"))
    inside = (F.col("t.key") == F.col("f.key")) & (F.col("f.first") > F.col("t.was_at")) & (F.col("f.first") <= F.col("t.at"))
    hits = t.alias("t").join(first.alias("f"), inside, "left_semi").select("obs_id", F.lit(True).alias("hit"))
    return t.join(hits, "obs_id", "left").select("obs_id", F.coalesce("hit", F.lit(False)).alias("moved"))


@query("""WITH w AS (SELECT user_id, event_id AS call, ts AS a, ts + INTERVAL 1 HOUR AS b FROM events WHERE event_type = 'purchase')
SELECT call, count(*) AS n FROM w JOIN events e ON e.user_id = w.user_id AND e.ts BETWEEN a AND b GROUP BY call""")
def q26_events_in_windows(spark, d):
    e = table(spark, d, "events")
    w = e.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("call"), F.col("ts").alias("start"), F.expr("ts + interval 1 hour").alias("end"))
    return divergence.counts_in_windows(w, e.select("user_id", F.col("ts").alias("at")), "user_id", "call")


@query("""WITH x AS (SELECT p_type, p_size, min(p_brand) AS v FROM part WHERE p_partkey % 2 = 0 GROUP BY ALL), y AS (SELECT p_type, p_size, min(p_brand) AS v FROM part WHERE p_partkey % 2 = 1 GROUP BY ALL)
SELECT p_type, p_size, CASE WHEN x.v IS NULL THEN 'added' WHEN y.v IS NULL THEN 'removed' WHEN x.v <> y.v THEN 'changed' ELSE 'same' END AS status, x.v AS before, y.v AS after FROM x FULL JOIN y USING (p_type, p_size)""")
def q27_named_diff(spark, d):
    side = lambda k: table(spark, d, "part").filter(f"p_partkey % 2 = {k}").groupBy("p_type", "p_size").agg(F.min("p_brand").alias("v"))
    return changes.named_diff(side(0), side(1), ["p_type"], "p_size", "v")


@query("""WITH u AS (SELECT doc_id, 'quality' AS rater, quality AS label FROM labels UNION ALL SELECT doc_id, 'toxic', 1 - toxic FROM labels)
SELECT a.rater AS first, b.rater AS second, count(*) AS n, count(*) FILTER (a.label = b.label) AS agree FROM u a JOIN u b ON a.doc_id = b.doc_id AND a.rater < b.rater GROUP BY ALL""")
def q28_rater_pairs(spark, d):
    t = table(spark, d, "labels")
    u = t.select("doc_id", F.lit("quality").alias("rater"), F.col("quality").alias("label")).union(t.select("doc_id", F.lit("toxic"), 1 - F.col("toxic")))
    pairs = u.alias("a").join(u.alias("b"), (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.rater") < F.col("b.rater")))
    return pairs.groupBy(F.col("a.rater").alias("first"), F.col("b.rater").alias("second")).agg(F.count("*").alias("n"), F.count_if(F.col("a.label") == F.col("b.label")).alias("agree"))


@query("""SELECT count(*) AS digests, count(*) FILTER (sha NOT IN (SELECT sha256(text) FROM documents WHERE text IS NOT NULL)) AS dangling
FROM (SELECT sha256(text) AS sha FROM documents UNION SELECT sha256(text) FROM benchmark UNION SELECT sha256(text) FROM conversations) WHERE sha IS NOT NULL""")
def q29_dangling_digests(spark, d):
    sha = lambda t: table(spark, d, t).select(F.sha2("text", 256).alias("sha")).filter("sha is not null")
    refs = sha("documents").union(sha("benchmark")).union(sha("conversations")).distinct()
    held = sha("documents").distinct().withColumn("held", F.lit(1))
    return refs.join(held, "sha", "left").agg(F.count("*").alias("digests"), F.count_if(F.col("held").isNull()).alias("dangling"))


@query("SELECT event_id, sha256(concat('{\"k\":', json_extract_string(props, '$.k'), '}')) AS sha FROM events")
def q30_canonical_hash(spark, d):
    return table(spark, d, "events").select("event_id", canonical.canonical_hash(F.col("props")).alias("sha"))


@query("""WITH t AS (SELECT event_id, props, lag(props) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM events)
SELECT event_id, CASE WHEN json_extract_string(props, '$.k') IS DISTINCT FROM json_extract_string(was, '$.k') THEN 'k' ELSE '' END AS changed FROM t WHERE was IS NOT NULL""")
def q31_changed_keys(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    t = table(spark, d, "events").withColumn("was", F.lag("props").over(w)).filter("was is not null")
    return t.select("event_id", F.array_join(changes.json_keys_changed(F.col("was"), F.col("props")), ",").alias("changed"))


@query(r"SELECT doc_id, len(regexp_extract_all(text, '[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\s]')) AS n_tokens FROM documents WHERE lang = 'en'")
def q34_token_counts(spark, d):
    return table(spark, d, "documents").filter("lang = 'en'").select("doc_id", F.size(text.tokens(F.col("text"))).cast("long").alias("n_tokens"))


@query()
def q56_all_token_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(text.tokens(F.col("text"))).cast("long").alias("n_tokens"))


def turn_pairs(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("after"), F.lag("text").over(w).alias("before"), F.row_number().over(w).alias("rn")).filter("rn > 1")


@query()
def q35_token_diff(spark, d):
    return turn_pairs(spark, d).withColumn("x", text.token_diff(F.col("before"), F.col("after"))).select(
        "conv_id", "turn", F.size("x.added").alias("added"), F.size("x.removed").alias("removed"), F.col("x.similarity").alias("similarity"))


@query(r"SELECT c_custkey, trim(regexp_replace(regexp_replace(c_name, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '[_\-.\s#]+', ' ', 'g')) AS words FROM customer")
def q36_split_names(spark, d):
    return table(spark, d, "customer").select("c_custkey", text.split_name(F.replace("c_name", F.lit("#"), F.lit("_"))).alias("words"))


@query(r"SELECT lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS host, count(*) AS n FROM pages GROUP BY host")
def q37_hosts(spark, d):
    return table(spark, d, "pages").groupBy(F.lower(F.parse_url("url", F.lit("AUTHORITY"))).alias("host")).agg(F.count("*").alias("n"))


@query(_PAIRS + "SELECT conv_id, turn, length(before) > 0 AND length(after) >= 2 * length(before) AS grew FROM p")
def q38_growth(spark, d):
    return turn_pairs(spark, d).select("conv_id", "turn", text.grew_sharply(F.col("before"), F.col("after")).alias("grew"))


_MARKERS = ["the ", "and ", "that", "with"]


@query(_PAIRS + "SELECT conv_id, turn, " + " + ".join(f"CAST(contains(lower(after), '{m}') AND NOT contains(lower(coalesce(before, '')), '{m}') AS BIGINT)" for m in _MARKERS) + " AS new_markers FROM p")
def q39_new_markers(spark, d):
    new = F.array_except(text.markers(F.col("after"), _MARKERS), text.markers(F.col("before"), _MARKERS))
    return turn_pairs(spark, d).select("conv_id", "turn", F.size(new).cast("long").alias("new_markers"))


@query("""SELECT p_partkey, p_brand, CASE WHEN p_size > 40 THEN 'not_allowed' WHEN row_number() OVER (PARTITION BY p_brand ORDER BY p_size > 40, p_partkey) > 10 THEN 'over_budget' ELSE 'chosen' END AS outcome FROM part""")
def q44_budget(spark, d):
    return changes.budgeted(table(spark, d, "part"), "p_brand", "p_partkey", F.col("p_size") <= 40, 10).select("p_partkey", "p_brand", "outcome")


@query()
def q45_stratified_draw(spark, d):
    band = F.when(F.col("c_acctbal") < 0, "debt").when(F.col("c_acctbal") < 5000, "low").otherwise("high")
    rows = table(spark, d, "customer").withColumn("stratum", F.concat_ws("/", "c_mktsegment", band))
    return changes.stratified(rows, "stratum", "c_custkey", 100, 7).select("c_custkey", "stratum")


_POLICIES = [("everything", []), ("not_flags", ["flag_A", "flag_N", "flag_R"]), ("not_status", ["status_F", "status_O"]), ("returns", ["flag_A", "flag_N", "status_F", "status_O"]), ("nothing", ["flag_A", "flag_N", "flag_R", "status_F", "status_O"])]
_POLICY_SQL = ", ".join(f"('{p}', {[*e] if e else '[]::VARCHAR[]'})" for p, e in _POLICIES)


@query(f"""WITH c AS (SELECT ['flag_' || l_returnflag, 'status_' || l_linestatus] AS kinds, l_discount >= 0.05 AS flagged FROM lineitem), x AS (SELECT policy, flagged, len(list_filter(kinds, lambda k: NOT list_contains(exempt, k))) > 0 AS b FROM c, (VALUES {_POLICY_SQL}) AS t(policy, exempt)),
y AS (SELECT policy, count(*) FILTER (b) AS blocked, count(*) FILTER (NOT b) AS passed, count(*) FILTER (b AND flagged) AS caught, count(*) FILTER (NOT b AND flagged) AS missed FROM x GROUP BY policy)
SELECT *, CASE WHEN caught > 0 THEN (blocked - caught) / caught::DOUBLE END AS friction FROM y""")
def q46_policy_replay(spark, d):
    c = table(spark, d, "lineitem").select(F.array(F.concat(F.lit("flag_"), "l_returnflag"), F.concat(F.lit("status_"), "l_linestatus")).alias("kinds"), (F.col("l_discount") >= 0.05).alias("flagged"))
    return changes.replay(c, spark.createDataFrame(_POLICIES, "policy string, exempt array<string>"))


@query("""WITH n AS (SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_suppkey), t AS (SELECT l_suppkey AS top, n FROM n ORDER BY n DESC, l_suppkey LIMIT 1), s AS (SELECT sum(n) AS total FROM n)
SELECT top, n, n / total::DOUBLE AS share, CAST(total - n AS BIGINT) AS rest FROM t, s""")
def q47_concentration(spark, d):
    n = table(spark, d, "lineitem").filter("l_returnflag = 'R'").groupBy("l_suppkey").agg(F.count("*").alias("n"))
    best = n.agg(F.max_by("l_suppkey", F.struct(F.col("n"), -F.col("l_suppkey"))).alias("top"), F.max("n").alias("n"), F.sum("n").alias("total"))
    return best.select("top", "n", (F.col("n") / F.col("total")).alias("share"), (F.col("total") - F.col("n")).alias("rest"))


@query("SELECT event_type AS status, count(*) AS n FROM events WHERE CAST(ts AS DATE) = (SELECT max(CAST(ts AS DATE)) FROM events) GROUP BY event_type")
def q48_coverage(spark, d):
    days = table(spark, d, "events").groupBy(F.to_date("ts").alias("day"), F.col("event_type").alias("status")).agg(F.count("*").alias("n"))
    return days.join(F.broadcast(days.agg(F.max("day").alias("day"))), "day").select("status", "n")  # one row


@query("""SELECT 'errors' AS name, count(*) FILTER (event_type = 'error') * 10 <= count(*) * 3 AS ok FROM events UNION ALL SELECT 'volume', count(*) > 0 FROM events
UNION ALL SELECT 'references', count(*) = 0 FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)""")
def q49_health(spark, d):
    e = table(spark, d, "events").agg((F.count_if(F.col("event_type") == "error") * 10 <= F.count("*") * 3).alias("errors"), (F.count("*") > 0).alias("volume"))
    orphans = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").agg((F.count("*") == 0).alias("ok"))
    checks = e.select(F.inline(F.array(F.struct(F.lit("errors").alias("name"), F.col("errors").alias("ok")), F.struct(F.lit("volume").alias("name"), F.col("volume").alias("ok")))))
    return checks.union(orphans.select(F.lit("references").alias("name"), "ok"))


@query(f"WITH {_STEPS}{_WALK}SELECT count(DISTINCT key) AS servers, count(DISTINCT key) FILTER (verdict <> 'new') AS changed FROM v")
def q50_layer_metrics(spark, d):
    v = chain.verdicts(order_steps(spark, d))
    return v.agg(F.countDistinct("key").alias("servers"), F.countDistinct(F.when(F.col("verdict") != "new", F.col("key"))).alias("changed"))


@query(_GAPS + "SELECT count(*) AS transitions, count(DISTINCT key) AS multi_version, count(*) FILTER (was_at = eff) AS restated, count(*) FILTER (was <> content) AS moved FROM g")
def q51_retrospective(spark, d):
    t = chain.transitions(order_steps(spark, d))
    return t.agg(F.count("*").alias("transitions"), F.countDistinct("key").alias("multi_version"), F.count_if("restated").alias("restated"), F.count_if(F.col("was") != F.col("content")).alias("moved"))


# Capability patterns over words that the documents hold.
_LEXICON = {"license": r"\b(license|licensed|copyright)\b", "order": r"\b(with|that)\b", "place": r"\b(mail[0-9]+|example)\b", "secret": r"\b(api key|token|secret)\b"}
_HITS = "h AS (SELECT doc_id, c AS capability, regexp_extract(lower(coalesce(text, '')), p, 0) AS evidence FROM documents, (VALUES " + ", ".join(f"('{c}', '{p}')" for c, p in _LEXICON.items()) + ") AS x(c, p) WHERE regexp_matches(lower(coalesce(text, '')), p))"


def capabilities(spark, d):
    return table(spark, d, "documents").select("doc_id", F.inline(divergence.declared(F.col("text"), _LEXICON)))


@query(f"WITH {_HITS} SELECT * FROM h")
def q40_lexical_profile(spark, d):
    return capabilities(spark, d)


@query("""SELECT doc_id, CASE WHEN contains(text, '@') AND length(text) > 2000 THEN 'personal' WHEN regexp_matches(text, '[0-9]{16}') THEN 'card' WHEN regexp_matches(text, '[#$%&]{3}') THEN 'noise'
WHEN length(text) < 100 THEN 'short' ELSE 'deferred' END AS label FROM documents""")
def q41_rule_ladder(spark, d):
    t = F.col("text")
    rules = [("personal", F.contains(t, F.lit("@")) & (F.length(t) > 2000)), ("card", t.rlike("[0-9]{16}")), ("noise", t.rlike("[#$%&]{3}")), ("short", F.length(t) < 100)]
    return table(spark, d, "documents").select("doc_id", severity.first_rule(rules).alias("label"))


@query(f"""WITH {_HITS}, s AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'order' ELSE 'license' END AS capability FROM labels)
SELECT doc_id, capability, evidence FROM h WHERE (doc_id, capability) NOT IN (SELECT doc_id, capability FROM s)""")
def q43_undeclared(spark, d):
    said = table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "order").otherwise("license").alias("capability"))
    found = divergence.undeclared(capabilities(spark, d), said, ["doc_id"])
    return found.select("doc_id", "capability", F.element_at("evidence", 1).alias("evidence"))


@query(_PAIRS + "SELECT conv_id, turn, concat_ws(',', CASE WHEN " + " OR ".join(f"(contains(lower(after), '{m}') AND NOT contains(lower(coalesce(before, '')), '{m}'))" for m in _MARKERS) + """ THEN 'imperative_language_added' END,
CASE WHEN length(before) > 0 AND length(after) >= 2 * length(before) THEN 'description_grew_sharply' END) AS flags FROM p""")
def q53_change_flags(spark, d):
    pairs = turn_pairs(spark, d)
    found = severity.change_flags(F.lit("tool_description_changed"), F.lit("text"), F.col("before"), F.col("after"), _MARKERS)
    return pairs.select("conv_id", "turn", F.array_join(found, ",").alias("flags"))


@query("""WITH t AS (SELECT o_custkey AS key, o_orderkey AS obs_id, o_orderpriority AS c, lag(o_orderpriority) OVER w AS was, row_number() OVER w AS rn FROM orders WHERE o_orderstatus <> 'P'
WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) SELECT obs_id, rn = 1 OR c <> was AS changed FROM t""")
def q54_changed_since_last(spark, d):
    return chain.changed_since_last(order_steps(spark, d).filter("not absent"), "content").select("obs_id", "changed")


@query("""WITH a AS (SELECT doc_id AS k, CASE WHEN toxic = 1 THEN 'timeout' ELSE 'ok' END AS s, quality AS h FROM labels), b AS (SELECT doc_id AS k, CASE WHEN doc_id % 7 = 0 THEN 'unreachable' ELSE 'ok' END AS s, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE quality END AS h FROM labels)
SELECT CASE WHEN b.s <> 'ok' THEN b.s WHEN a.s = 'ok' AND a.h IS DISTINCT FROM b.h THEN 'nondeterministic' ELSE 'ok' END AS status, count(*) AS n FROM a JOIN b USING (k) GROUP BY status""")
def q55_reconcile_probes(spark, d):
    t = table(spark, d, "labels")
    a = t.select("doc_id", F.when(F.col("toxic") == 1, "timeout").otherwise("ok").alias("status"), F.col("quality").cast("string").alias("hash"))
    b = t.select("doc_id", F.when(F.col("doc_id") % 7 == 0, "unreachable").otherwise("ok").alias("status"), F.when(F.col("doc_id") % 3 == 0, 1).otherwise(F.col("quality")).cast("string").alias("hash"))
    return ingest.reconcile(a, b, "doc_id").groupBy("status").agg(F.count("*").alias("n"))


from driftloom.plans import evidence, landings, manifests, release, wordings  # noqa: E402, F401  register their queries
