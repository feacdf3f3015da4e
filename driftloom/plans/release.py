"""Queries of releases, records, health and selection over the driver's tables, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftloom.functions import canonical
from driftloom.functions.fixed import AUTH_HINTS, CREDENTIAL_HINTS, DEPENDENCY_HINTS, HIGH_SIGNAL_FLAGS
from driftloom.operators import chain, exercise, ingest, records, release
from driftloom.plans import catalog
from driftloom.plans.registry import query
from driftloom.session import spread, table
from driftloom.streaming import walk

_KINDS = "list_filter([CASE l_returnflag WHEN 'A' THEN 'tool_added' WHEN 'N' THEN 'tool_description_changed' ELSE 'schema_param_added' END, CASE WHEN l_linenumber = 1 THEN 'tool_removed' END], lambda x: x IS NOT NULL)"
_FLAGS = "list_filter([CASE WHEN l_discount >= 0.07 THEN 'network_param_added' END, CASE WHEN l_tax >= 0.05 THEN 'tool_count_grew' END], lambda x: x IS NOT NULL)"
_POLICY = ", ".join(f"('{p}', {[*e] if e else '[]::VARCHAR[]'})" for p, e in release.POLICIES)
_REPLAY = f"""WITH c AS (SELECT l_suppkey AS ns, {_KINDS} AS kinds, {_FLAGS} AS flags FROM lineitem), x AS (SELECT policy, ns, flags, len(flags) > 0 AS flagged, list_contains(flags, 'network_param_added') AS high,
len(list_filter(kinds, lambda k: NOT list_contains(exempt, k))) > 0 AS b FROM c, (VALUES {_POLICY}) AS t(policy, exempt)),
o AS (SELECT policy, count(*) FILTER (b) AS blocked, count(*) FILTER (NOT b) AS passed, count(*) FILTER (b AND flagged) AS caught, count(*) FILTER (b AND high) AS caught_high, count(*) FILTER (NOT b AND flagged) AS missed FROM x GROUP BY policy)"""
assert "network_param_added" in HIGH_SIGNAL_FLAGS and "tool_count_grew" not in HIGH_SIGNAL_FLAGS


def line_changes(spark, d):
    """Order lines as change sets with kinds, flags and a namespace."""
    kind = F.when(F.col("l_returnflag") == "A", "tool_added").when(F.col("l_returnflag") == "N", "tool_description_changed").otherwise("schema_param_added")
    return table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("ns"), F.array_compact(F.array(kind, F.when(F.col("l_linenumber") == 1, "tool_removed"))).alias("kinds"),
        F.array_compact(F.array(F.when(F.col("l_discount") >= 0.07, "network_param_added"), F.when(F.col("l_tax") >= 0.05, "tool_count_grew"))).alias("flags"),
    )


@query(f"{_REPLAY} SELECT *, CASE WHEN caught > 0 THEN (blocked - caught) / caught::DOUBLE END AS friction FROM o")
def q63_policy_outcomes(spark, d):
    c = line_changes(spark, d)
    return release.outcomes(c, release.policy_table(c))


@query(f"{_REPLAY} SELECT policy, f AS flag, count(*) AS n FROM (SELECT policy, unnest(flags) AS f FROM x WHERE b) GROUP BY ALL")
def q64_caught_by_flag(spark, d):
    c = line_changes(spark, d)
    return release.caught_by_flag(c, release.policy_table(c))


@query(f"""{_REPLAY}, n AS (SELECT policy, ns, count(*) FILTER (b) AS nb, count(*) FILTER (b AND flagged) AS nc FROM x GROUP BY ALL), t AS (SELECT *, row_number() OVER (PARTITION BY policy ORDER BY nb DESC, ns) AS rn FROM n)
SELECT policy, ns AS top, nb AS top_blocked, CASE WHEN blocked > 0 THEN nb / blocked::DOUBLE END AS share, CASE WHEN caught - nc > 0 THEN (blocked - nb - (caught - nc)) / (caught - nc)::DOUBLE END AS friction_without,
coalesce(nb / nullif(blocked, 0)::DOUBLE >= 0.2, false) AS concentrated FROM t JOIN o USING (policy) WHERE rn = 1""")
def q65_policy_concentration(spark, d):
    c = line_changes(spark, d)
    return release.concentration(c, release.policy_table(c), "ns")


@query(f"{_REPLAY} SELECT count(DISTINCT (blocked, passed, caught, missed)) = 1 AS identical FROM o")
def q66_identical_outcomes(spark, d):
    c = line_changes(spark, d)
    return release.identical_outcomes(release.outcomes(c, release.policy_table(c)))


_EVENT_SETS = f"""WITH {catalog._EVENT_STEPS}{catalog._WALK}, q AS (SELECT DISTINCT user_id AS key FROM events WHERE event_type = 'signup' AND value > 230),
s AS (SELECT v.key, v.verdict, CASE WHEN verdict = 'new' THEN 0 ELSE 1 END AS changes, e.value > 50 AS flagged, q.key IS NOT NULL AS quarantined, v.obs_id FROM v JOIN events e ON e.event_id = v.obs_id LEFT JOIN q ON q.key = v.key)"""


def event_sets(spark, d):
    """Verdicts of users' events as change sets with flags and quarantine."""
    e = table(spark, d, "events")
    steps = e.select(F.col("user_id").alias("key"), F.col("event_id").alias("obs_id"), F.col("ts").cast("timestamp").alias("at"), F.col("event_type").alias("content"), (F.col("event_type") == "error").alias("absent"), (F.col("value") > 50).alias("flagged"), ((F.col("event_type") == "signup") & (F.col("value") > 230)).alias("unstable"))
    bad = steps.filter("unstable").select("key").distinct().withColumn("quarantined", F.lit(True))
    found = chain.verdicts(steps).join(bad, "key", "left").withColumn("quarantined", F.coalesce("quarantined", F.lit(False)))
    flags = F.array_compact(F.array(F.when(F.col("flagged"), "network_param_added")))
    return found.select("key", "obs_id", "verdict", F.when(F.col("verdict") == "new", 0).otherwise(1).alias("changes"), flags.alias("flags"), "quarantined")


@query(f"""{_EVENT_SETS}, m AS (SELECT count(*) AS transitions, count(DISTINCT key) AS servers, count(*) FILTER (quarantined) AS quarantined_transitions, count(*) FILTER (NOT quarantined AND changes > 0) AS changed,
count(DISTINCT key) FILTER (NOT quarantined AND changes > 0) AS servers_changed, count(*) FILTER (NOT quarantined AND changes > 0 AND flagged) AS flagged FROM s)
SELECT *, CASE WHEN servers > 0 THEN servers_changed / servers::DOUBLE ELSE 0.0 END AS mutation_rate, CASE WHEN changed > 0 THEN flagged / changed::DOUBLE ELSE 0.0 END AS flagged_rate FROM m""")
def q67_layer_metrics(spark, d):
    return release.layer_metrics(event_sets(spark, d))


@query(f"{_EVENT_SETS} SELECT key, obs_id FROM s WHERE NOT quarantined AND flagged AND changes > 0")
def q68_emitted_flagged(spark, d):
    """Change sets as they are written by default: no quarantined ones, flagged only."""
    return event_sets(spark, d).filter(~F.col("quarantined") & (F.size("flags") > 0) & (F.col("changes") > 0)).select("key", "obs_id")


_OPINIONS = "u AS (SELECT doc_id, 'a' AS rater, quality AS label FROM labels UNION ALL SELECT doc_id, 'b', 1 - toxic FROM labels UNION ALL SELECT doc_id, 'c', CAST(doc_id % 2 AS INT) FROM documents WHERE doc_id % 5 = 0), k AS (SELECT doc_id, min(label) AS label FROM u WHERE label IS NOT NULL GROUP BY doc_id HAVING count(DISTINCT label) = 1)"


def opinions(spark, d):
    t = table(spark, d, "labels")
    third = table(spark, d, "documents").filter("doc_id % 5 = 0").select("doc_id", (F.col("doc_id") % 2).cast("int").alias("label"))
    return t.select("doc_id", F.col("quality").cast("int").alias("label")).unionByName(t.select("doc_id", (1 - F.col("toxic")).cast("int").alias("label"))).unionByName(third)


@query(f"WITH {_OPINIONS} SELECT doc_id, label FROM k")
def q69_consensus(spark, d):
    return release.consensus(opinions(spark, d), "doc_id", "label")


@query(f"""WITH {_OPINIONS}, m AS (SELECT doc_id, CASE WHEN n_chars < 200 THEN 'deferred' WHEN n_chars > 800 THEN '1' ELSE '0' END AS label FROM documents), j AS (SELECT m.label, m.label = CAST(k.label AS VARCHAR) AS ok FROM m JOIN k USING (doc_id) WHERE m.label <> 'deferred')
SELECT label, count(*) AS hits, count(*) FILTER (ok) AS right, count(*) FILTER (ok) / count(*)::DOUBLE AS precision FROM j GROUP BY label""".replace("AS right", 'AS "right"'))
def q70_machine_precision(spark, d):
    n = F.col("n_chars")
    machine = table(spark, d, "documents").select("doc_id", F.when(n < 200, "deferred").when(n > 800, "1").otherwise("0").alias("label"))
    truth = release.consensus(opinions(spark, d), "doc_id", "label").withColumn("label", F.col("label").cast("string"))
    return release.precision(machine, truth, "doc_id", "label")


@query("SELECT o_orderstatus, (epoch_us((SELECT max(l_shipdate) FROM lineitem)) - epoch_us(min(o_orderdate))) / 86400000000.0::DOUBLE AS collected_days, (epoch_us(max(o_orderdate)) - epoch_us(min(o_orderdate))) / 86400000000.0::DOUBLE AS span_days FROM orders GROUP BY o_orderstatus")
def q71_spans(spark, d):
    now = table(spark, d, "lineitem").agg(F.max("l_shipdate").alias("now"))
    rows = table(spark, d, "orders").join(F.broadcast(now))  # one row
    return release.spans(rows, "o_orderstatus", "o_orderdate", "o_orderdate", F.max("now"))


@query("SELECT concat(p_type, '/', p_size) AS kind, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, kind LIMIT 15")
def q72_top_kinds(spark, d):
    return release.top(table(spark, d, "part").select(F.concat_ws("/", "p_type", "p_size").alias("kind")), "kind", 15)


_MOVES = """WITH t AS (SELECT o_custkey AS key, o_orderstatus AS s, o_orderpriority AS p, o_totalprice > 150000 AS b, lag(o_orderstatus) OVER w AS s0, lag(o_orderpriority) OVER w AS p0, lag(o_totalprice > 150000) OVER w AS b0, row_number() OVER w AS rn FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
m AS (SELECT key, list_filter([CASE WHEN s IS DISTINCT FROM s0 THEN 'status' END, CASE WHEN p IS DISTINCT FROM p0 THEN 'priority' END, CASE WHEN b IS DISTINCT FROM b0 THEN 'band' END], lambda x: x IS NOT NULL) AS fields FROM t WHERE rn > 1)"""


def order_moves(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    now = {"status": F.col("o_orderstatus"), "priority": F.col("o_orderpriority"), "band": F.col("o_totalprice") > 150000}
    rows = table(spark, d, "orders").withColumns({"_n": F.row_number().over(w), **{f"_{n}": F.lag(c).over(w) for n, c in now.items()}}).filter("_n > 1")
    return rows.select(F.col("o_custkey").alias("key"), records.changed_fields({n: F.col(f"_{n}") for n in now}, now).alias("fields"))


@query(f"{_MOVES} SELECT f AS field, count(*) AS n, count(*) / (SELECT count(*) FROM m)::DOUBLE AS share FROM (SELECT unnest(fields) AS f FROM m) GROUP BY f")
def q73_field_frequency(spark, d):
    return records.field_frequency(order_moves(spark, d), "fields")


@query(f"{_MOVES} SELECT count(*) FILTER (list_contains(fields, 'priority')) AS swaps, count(DISTINCT key) FILTER (list_contains(fields, 'priority')) AS servers FROM m")
def q74_swaps(spark, d):
    hit = F.array_contains("fields", "priority")
    return order_moves(spark, d).agg(F.count_if(hit).alias("swaps"), F.countDistinct(F.when(hit, F.col("key"))).alias("servers"))


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey ORDER BY n DESC, o_custkey LIMIT 10")
def q75_busiest(spark, d):
    return release.top(table(spark, d, "orders").select("o_custkey"), "o_custkey", 10)


_RUNS = "r AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS run_id, min(ts) AS started_at, CASE WHEN count(*) FILTER (event_type = 'error') * 5 < count(*) THEN max(ts) END AS finished_at, count(*) AS n FROM events GROUP BY 1)"


def event_runs(spark, d):
    days = table(spark, d, "events").groupBy(F.to_date("ts").cast("string").alias("run_id"))
    return days.agg(F.min("ts").alias("started_at"), F.when(F.count_if(F.col("event_type") == "error") * 5 < F.count("*"), F.max("ts")).alias("finished_at"), F.count("*").alias("n"))


@query(f'WITH {_RUNS} SELECT run_id, started_at, finished_at, finished_at IS NULL AS "open" FROM r')
def q76_run_view(spark, d):
    r = event_runs(spark, d)
    return records.run_view(r.select("run_id", "started_at"), r.filter("finished_at is not null").select("run_id", "finished_at"))


@query(f"""WITH {_RUNS}, w AS (SELECT max(started_at) + INTERVAL 1 DAY AS now FROM r), l AS (SELECT n, row_number() OVER (ORDER BY started_at DESC) AS k FROM r WHERE finished_at IS NOT NULL),
c AS (SELECT 'freshness' AS name, max(started_at) >= any_value(now) - INTERVAL 36 HOUR AS ok FROM r, w UNION ALL SELECT 'volume', sum(n) > 0 FROM r
UNION ALL SELECT 'died', count(*) = 0 FROM r, w WHERE finished_at IS NULL AND started_at >= now - INTERVAL 7 DAY AND started_at < now - INTERVAL 12 HOUR
UNION ALL SELECT 'coverage', coalesce(max(CASE WHEN k = 1 THEN n END) / nullif(max(CASE WHEN k = 2 THEN n END), 0)::DOUBLE >= 0.9, true) FROM l)
SELECT bool_and(ok) AS ok, coalesce(string_agg(name, ',' ORDER BY name) FILTER (NOT ok), '') AS failed FROM c""")
def q77_health_report(spark, d):
    r = event_runs(spark, d)
    now = r.agg((F.max("started_at") + F.expr("interval 1 day")).alias("now"))
    timed = r.join(F.broadcast(now))  # one row
    name = lambda n: F.lit(n).alias("name")
    checks = timed.agg(name("freshness"), (F.max("started_at") >= F.max("now") - F.expr("interval 36 hours")).alias("ok"))
    checks = checks.union(r.agg(name("volume"), (F.sum("n") > 0).alias("ok")))
    checks = checks.union(records.died_runs(timed, F.col("now")).agg(name("died"), (F.count("*") == 0).alias("ok")))
    checks = checks.union(records.coverage_ratio(r.filter("finished_at is not null"), "n").select(name("coverage"), F.coalesce(F.col("ratio") >= 0.9, F.lit(True)).alias("ok")))
    return records.health_report(checks)


@query("""SELECT o_custkey, o_orderkey, versions FROM (SELECT o_custkey, o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS versions, row_number() OVER (PARTITION BY o_custkey ORDER BY coalesce(o_orderpriority = '1-URGENT', false) DESC, (o_orderstatus = 'P') DESC,
CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END DESC NULLS LAST, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1""")
def q78_grouped_ingest(spark, d):
    rows = table(spark, d, "orders").withColumns({"stamp": F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")), "latest": F.col("o_orderpriority") == "1-URGENT"})
    return records.representatives(rows, "o_custkey", "stamp", "o_orderkey", "latest", ["o_orderkey"])


@query("""SELECT DISTINCT o_custkey, o_orderdate FROM orders i WHERE o_orderpriority = '2-HIGH' AND o_orderkey % 2 = 1 AND NOT EXISTS (SELECT 1 FROM orders h WHERE h.o_orderkey % 2 = 0 AND h.o_custkey = i.o_custkey AND h.o_orderdate = i.o_orderdate)""")
def q79_withdrawals(spark, d):
    rows = table(spark, d, "orders").withColumn("status", F.when(F.col("o_orderpriority") == "2-HIGH", "deleted").when(F.col("o_orderpriority") == "1-URGENT", "deprecated").otherwise("active"))
    return records.withdrawals(rows.filter("o_orderkey % 2 = 0"), rows.filter("o_orderkey % 2 = 1"), "o_custkey", "status", "o_orderdate")


@query(f"""WITH steps AS (SELECT user_id AS key, event_id AS obs_id, ts AS eff, event_type AS content, event_type = 'error' AS absent FROM events WHERE event_type <> 'error' OR value < 30){catalog._WALK} SELECT verdict, count(*) AS n FROM v GROUP BY verdict""")
def q80_chain_membership(spark, d):
    """Failures other than absent and withdrawn are passed over."""
    error, low = F.col("event_type") == "error", F.col("value")
    rows = table(spark, d, "events").select(
        F.col("user_id").alias("key"), F.col("event_id").alias("obs_id"), F.col("ts").cast("timestamp").alias("at"), F.col("event_type").alias("content"),
        F.when(error, "skipped").otherwise("ok").alias("status"), F.when(error & (low < 15), "absent").when(error & (low < 30), "withdrawn").when(error, "tls_error").alias("error_class"),
    )
    return chain.verdicts(records.steps_of(rows, "status", "error_class")).groupBy("verdict").agg(F.count("*").alias("n"))


_REPO = "CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' END"


@query(f"""WITH steps AS (SELECT o_custkey AS key, o_orderkey AS obs_id, o_orderdate AS eff, o_orderpriority AS content, o_orderstatus = 'P' AS absent, {_REPO} AS repo FROM orders){catalog._WALK},
w AS (SELECT v.*, f.repo AS was FROM v LEFT JOIN steps f ON f.obs_id = v.from_id), {catalog._IDENT}, p AS (SELECT DISTINCT n.key FROM i n JOIN i o ON n.endpoint = o.endpoint AND n.key <> o.key AND o.last_seen <= n.first_seen)
SELECT CASE WHEN verdict = 'mutated' AND repo <> was THEN 'replaced' WHEN verdict = 'new' AND p.key IS NOT NULL THEN 'renamed' ELSE verdict END AS verdict, count(*) AS n FROM w LEFT JOIN p ON p.key = w.key GROUP BY 1""")
def q81_replaced_and_renamed(spark, d):
    price = F.col("o_totalprice")
    steps = table(spark, d, "orders").select(
        F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("obs_id"), F.col("o_orderdate").cast("timestamp").alias("at"), F.col("o_orderpriority").alias("content"), (F.col("o_orderstatus") == "P").alias("absent"),
        F.when(price > 200000, "high").when(price > 100000, "mid").alias("repo"),
    )
    found = chain.with_identity(chain.verdicts(steps, identity=["repo"]), catalog.q24_predecessors(spark, d), ["repo"])
    return found.groupBy("verdict").agg(F.count("*").alias("n"))


_CRASH = ["ModuleNotFoundError: x", "API_KEY must be set", "segfault", "Cannot find module token", "unauthorized"]
_DETAIL = "CASE event_id % 5 " + " ".join(f"WHEN {k} THEN '{t}'" for k, t in enumerate(_CRASH)) + " END"
_KIND = "CASE WHEN event_type IN ('error', 'signup') THEN 'crashed' WHEN event_type = 'view' THEN 'timeout' WHEN event_type = 'click' THEN 'install_failed' ELSE 'odd' END"
_says = lambda hints: "(" + " OR ".join(f"contains(lower(detail), '{h}')" for h in hints) + ")"


@query(f"""WITH e AS (SELECT {_KIND} AS kind, {_DETAIL} AS detail, value > 50 AS declared FROM events), c AS (SELECT CASE WHEN kind = 'crashed' AND {_says(DEPENDENCY_HINTS)} THEN 'dependency_broken' WHEN kind = 'crashed' AND {_says(CREDENTIAL_HINTS)} THEN 'requires_credentials' ELSE kind END AS class,
kind = 'crashed' AND NOT {_says(DEPENDENCY_HINTS)} AND {_says(CREDENTIAL_HINTS)} AND NOT declared AS undeclared FROM e)
SELECT class, undeclared, CASE WHEN class IN ('install_failed', 'dependency_broken') THEN 'unreachable' WHEN class = 'timeout' THEN 'timeout' WHEN class = 'requires_credentials' THEN 'auth_required' ELSE 'protocol_error' END AS status, count(*) AS n FROM c GROUP BY ALL""")
def q82_launch_failures(spark, d):
    e = table(spark, d, "events").select(F.expr(_KIND).alias("kind"), F.expr(_DETAIL).alias("detail"), (F.col("value") > 50).alias("declared"))
    c = e.select(F.inline(F.array(records.launch_failure(F.col("kind"), F.col("detail"), F.col("declared")))))
    return c.withColumn("status", records.launch_status(F.col("class"))).groupBy("class", "undeclared", "status").agg(F.count("*").alias("n"))


@query(f"""WITH e AS (SELECT event_id, CAST(400 + event_id % 9 AS INT) AS http, CAST(CASE WHEN event_id % 11 = 0 THEN -32001 ELSE -32600 END AS INT) AS code, {_DETAIL} AS detail FROM events)
SELECT event_id, http IN (401, 402, 403, 407) OR code IN (-32001, -32002) OR {_says(AUTH_HINTS)} AS wants FROM e""")
def q83_wants_credentials(spark, d):
    e = table(spark, d, "events")
    code = F.when(F.col("event_id") % 11 == 0, -32001).otherwise(-32600)
    return e.select("event_id", records.wants_credentials((400 + F.col("event_id") % 9).cast("int"), code, F.expr(_DETAIL)).alias("wants"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f+00:00') AS at FROM events")
def q84_iso_times(spark, d):
    return table(spark, d, "events").select("event_id", records.to_iso(F.col("ts")).alias("at"))


@query("SELECT count(*) FILTER (text IS NOT NULL) AS valid, count(*) FILTER (text IS NULL) AS missing FROM documents")
def q85_digests(spark, d):
    sha = F.sha2("text", 256)
    return table(spark, d, "documents").agg(F.count_if(records.is_digest(sha) & ~records.is_digest(F.upper(F.concat(sha, F.lit("a"))))).alias("valid"), F.count_if(~records.is_digest(sha)).alias("missing"))


@query("SELECT count(DISTINCT sha256(text)) AS blobs, CAST(coalesce(sum(bytes), 0) AS BIGINT) AS bytes FROM (SELECT DISTINCT text, strlen(text) AS bytes FROM documents WHERE text IS NOT NULL)")
def q86_blob_usage(spark, d):
    blobs = table(spark, d, "documents").filter("text is not null").groupBy(F.sha2("text", 256).alias("sha")).agg(F.first(F.octet_length("text").cast("long")).alias("bytes"))
    return blobs.agg(F.count("*").alias("blobs"), F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("bytes"))


@query("""WITH p AS (SELECT doc_id, quality = 1 AS flagged FROM labels WHERE doc_id % 10 <> 0), r AS (SELECT doc_id, CASE WHEN flagged THEN 'flagged' ELSE 'plain' END AS stratum, row_number() OVER (PARTITION BY flagged ORDER BY md5(concat('7|', doc_id)), doc_id) AS n FROM p)
SELECT doc_id, stratum FROM r WHERE n <= 20""")
def q87_calibration_draw(spark, d):
    pool = table(spark, d, "labels").select("doc_id", (F.col("quality") == 1).alias("flagged"))
    return release.calibration_draw(pool, "doc_id", "flagged", 40, 7, held=pool.filter("doc_id % 10 = 0")).select("doc_id", "stratum")


@query("""SELECT o_custkey, CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_orderstatus END AS model, arg_max(o_orderpriority, o_orderkey) AS label FROM orders GROUP BY ALL""")
def q88_label_upsert(spark, d):
    rows = table(spark, d, "orders").withColumn("model", F.nullif(F.col("o_orderstatus"), F.lit("O")))
    up = records.upserted(rows, ["o_custkey"], ["model"], "o_orderkey", ["o_orderpriority"])
    return up.select("o_custkey", F.nullif(F.col("model"), F.lit("")).alias("model"), F.col("o_orderpriority").alias("label"))


@query("SELECT DISTINCT c_custkey FROM customer WHERE c_nationkey < 15 AND c_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 10)")
def q89_fixed_sample(spark, d):
    c = table(spark, d, "customer")
    return records.inserted(c.filter("c_nationkey < 10"), c.filter("c_nationkey < 15").union(c.filter("c_nationkey < 12")), ["c_custkey"]).select("c_custkey")


@query("SELECT o_custkey, o_orderkey FROM orders i WHERE o_orderkey % 2 = 1 AND EXISTS (SELECT 1 FROM orders h WHERE h.o_orderkey % 2 = 0 AND h.o_custkey = i.o_custkey AND CAST(h.o_orderdate AS DATE) = CAST(i.o_orderdate AS DATE))")
def q90_restatements(spark, d):
    rows = table(spark, d, "orders").withColumn("day", F.to_date("o_orderdate"))
    return ingest.restatements(rows.filter("o_orderkey % 2 = 0"), rows.filter("o_orderkey % 2 = 1"), "o_custkey", "day").select("o_custkey", "o_orderkey")


_CLASS = {"license": "subprocess", "order": "filesystem_read", "place": "network", "secret": "credential_access"}


@query(f"""WITH {catalog._HITS} SELECT class, count(DISTINCT doc_id) AS tools FROM (SELECT doc_id, CASE capability WHEN 'license' THEN 'undeclared_subprocess' WHEN 'order' THEN 'undeclared_filesystem' WHEN 'place' THEN 'undeclared_network' ELSE 'undeclared_credential_access' END AS class FROM h) GROUP BY class""")
def q91_divergence_classes(spark, d):
    name = F.create_map(*[F.lit(x) for kv in _CLASS.items() for x in kv])
    rows = catalog.capabilities(spark, d).select("doc_id", records.divergence_class(name[F.col("capability")]).alias("class"))
    return rows.groupBy("class").agg(F.countDistinct("doc_id").alias("tools"))


@query("SELECT policy, 'withheld' AS top, share FROM (" + f"""{_REPLAY}, n AS (SELECT policy, ns, count(*) FILTER (b) AS nb FROM x GROUP BY ALL) SELECT policy, max(nb) / nullif(any_value(blocked), 0)::DOUBLE AS share FROM n JOIN o USING (policy) GROUP BY policy)""")
def q92_published(spark, d):
    return release.published(q65_policy_concentration(spark, d).withColumn("top", F.col("top").cast("string")), ["policy", "top", "share"], {"top": "withheld"})


@query("SELECT CASE WHEN c_custkey % 3 = 0 THEN 'npm' ELSE 'pypi' END || '/' || CASE WHEN n <= 1 THEN '1' WHEN n <= 4 THEN '2-4' ELSE '5+' END || '/' || CASE WHEN c_custkey % 7 = 0 THEN 'secret' ELSE 'nosecret' END AS stratum, count(*) AS n FROM (SELECT c_custkey, count(o_orderkey) % 7 AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1) WHERE c_custkey % 4 <> 0 AND c_custkey % 5 <> 0 GROUP BY 1")
def q93_candidate_strata(spark, d):
    n = table(spark, d, "customer").join(table(spark, d, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("c_custkey").agg((F.count("o_orderkey") % 7).alias("n"))
    listing = """concat('{"server":{"packages":[{"registryType":"oci","identifier":"o","transport":{"type":"stdio"}},{"environmentVariables":[{"isSecret":', if(c_custkey % 7 = 0, 'true', 'false'), '}],"identifier":"p","registryType":"', if(c_custkey % 3 = 0, 'npm', 'pypi'),
    '","transport":{"type":"', if(c_custkey % 5 = 0, 'sse', 'stdio'), '"}}],"remotes":[', if(c_custkey % 4 = 0, '{"url":"https://a"}', ''), ']}}')"""
    found = records.candidates(n.withColumn("listing", F.expr(listing)), "c_custkey", "listing", "n")
    return found.groupBy("stratum").agg(F.count("*").alias("n"))


_TOOLS = """concat('{"annotations":{', if(p_partkey % 5 = 0, '"destructiveHint":true', if(p_partkey % 5 = 1, '"readOnlyHint":false', '')), '},"description":"', if(p_partkey % 3 = 0, 'Deletes it. Fine', 'Reads it! This deletes nothing'), '","inputSchema":{"properties":{"q":{"type":"', if(p_size % 4 = 0, 'tuple', 'string'),
'"}},"required":["q"]},"name":"', if(p_partkey % 7 = 0, 'send_mail', 'get_item'), '"}')"""


@query("""SELECT CASE WHEN p_partkey % 5 = 0 THEN 'annotations.destructiveHint is true' WHEN p_partkey % 5 = 1 THEN 'annotations.readOnlyHint is false' WHEN p_partkey % 7 = 0 THEN 'name contains ''send''' WHEN p_partkey % 3 = 0 THEN 'description opens with ''deletes'''
WHEN p_size % 4 = 0 THEN 'parameter ''q'' has unsupported type ''tuple''' ELSE 'no exclusion applies' END AS reason, count(*) AS n FROM part GROUP BY 1""")
def q94_exercise_reasons(spark, d):
    tools = spread(table(spark, d, "part").select("p_partkey", "p_size"), "p_partkey").select(F.expr(_TOOLS).alias("tool"))
    return tools.select(exercise.decision(F.col("tool"))["reason"].alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN '{\"limit\":' || p_size || ',\"site_url\":\"https://driftloom-synthetic.invalid/driftloom-probe\"}' ELSE '{\"limit\":1,\"site_url\":\"https://driftloom-synthetic.invalid/driftloom-probe\"}' END AS arguments FROM part")
def q95_arguments(spark, d):
    schema = """concat('{"properties":{"limit":{"type":"integer"', if(p_size % 4 = 0, concat(',"minimum":', p_size), ''), '},"other":{},"site_url":{"type":["null","string"]}},"required":["limit","site_url"]}')"""
    return spread(table(spark, d, "part").select("p_partkey", "p_size"), "p_partkey").select("p_partkey", exercise.arguments(F.expr(schema))["arguments"].alias("arguments"))


_SCHEMA = """concat('{"properties":{"base_url":{"type":"string"},"inner":{"properties":{"', if(p_size % 2 = 0, 'password', 'plain'), '":{"type":"string"}}},"list":{"items":{"format":"', if(p_size % 3 = 0, 'ipv4', 'none'), '"}},"note":{"description":"', if(p_size % 5 = 0, 'runs a shell', 'nothing'), '"}}}')"""


@query("""SELECT p_partkey, concat_ws(',', CASE WHEN p_size % 2 = 0 THEN 'credential_access' END, 'network', CASE WHEN p_size % 5 = 0 THEN 'subprocess' END) AS capabilities FROM part""")
def q96_schema_profiles(spark, d):
    found = spread(table(spark, d, "part").select("p_partkey", "p_size"), "p_partkey").select("p_partkey", exercise.schema_capabilities(F.expr(_SCHEMA)).alias("c"))
    return found.select("p_partkey", F.array_join(F.array_sort(F.array_distinct(F.transform("c", lambda x: x["capability"]))), ",").alias("capabilities"))


@query("SELECT event_id, sha256(concat('{\"a\":{\"type\":\"', event_type, '\"},\"required\":[\"a\",\"b\"],\"z\":', user_id, '}')) AS sha FROM events")
def q97_canonical_documents(spark, d):
    """Keys out of order, keys that change on every answer, and a list whose order means nothing."""
    text = """concat('{"z":', user_id, ',"requestId":"', event_id, '","required":["b","a"],"a":{"Time-stamp":1,"type":"', event_type, '","mcp_session_id":"s"}}')"""
    return table(spark, d, "events").select("event_id", canonical.canonical_hash(F.expr(text)).alias("sha"))


@query("SELECT c_custkey FROM customer WHERE c_custkey > (SELECT max(o_custkey) // 2 FROM orders WHERE o_orderstatus = 'P')")
def q98_keyset_resume(spark, d):
    last = table(spark, d, "orders").filter("o_orderstatus = 'P'").agg(F.expr("max(o_custkey) div 2").alias("last"))
    return records.after_key(table(spark, d, "customer").select("c_custkey"), "c_custkey", last)


@query("""WITH a AS (SELECT p_brand, p_type FROM part WHERE p_partkey % 2 = 0), b AS (SELECT p_brand, p_type FROM part WHERE p_partkey % 2 = 1)
SELECT p_brand, p_type, 'missing' AS fault FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT p_brand, p_type, 'spurious' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""")
def q99_fixture_gate(spark, d):
    t = table(spark, d, "part")
    return records.gate(t.filter("p_partkey % 2 = 0").select("p_brand", "p_type"), t.filter("p_partkey % 2 = 1").select("p_brand", "p_type"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'network,subprocess' WHEN p_size % 3 = 1 THEN 'network' ELSE 'network,filesystem_read' END AS capabilities FROM part")
def q100_augmented(spark, d):
    model = F.when(F.col("p_size") % 3 == 0, F.array(F.lit("network"), F.lit("subprocess"))).when(F.col("p_size") % 3 == 2, F.array(F.lit("filesystem_read")))
    return table(spark, d, "part").select("p_partkey", F.array_join(records.augmented(F.array(F.lit("network")), model), ",").alias("capabilities"))


@query("""WITH i AS (SELECT doc_id, CASE WHEN toxic = 0 THEN 'manifest' ELSE 'registry' END AS layer FROM labels), d AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'registry' ELSE 'manifest' END AS layer, source FROM documents)
SELECT layer, count(*) AS n FROM i JOIN d USING (doc_id, layer) GROUP BY layer""")
def q101_items_by_layer(spark, d):
    items = table(spark, d, "labels").select("doc_id", F.when(F.col("toxic") == 1, "registry").alias("layer"))
    rows = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, "registry").otherwise("manifest").alias("layer"), "source")
    return records.resolved(items, rows, "doc_id", "layer", "manifest").groupBy("layer").agg(F.count("*").alias("n"))


@query("SELECT event_id, CASE WHEN user_id % 3 = 0 THEN CAST(event_id AS VARCHAR) WHEN user_id % 3 = 1 THEN '7' END AS answer FROM events")
def q102_responses(spark, d):
    body = """case user_id % 3 when 0 then concat('[{"id":1,"result":"no"},{"id":', event_id + 10, ',"result":"', event_id, '"},{"method":"note"}]')
    when 1 then concat('{"id":-1,"result":"7"}') else concat('[{"id":-1,"result":"7"},{"id":-2,"error":"8"}]') end"""
    return table(spark, d, "events").select("event_id", F.get_json_object(records.response_of(F.expr(body), F.col("event_id") + 10), "$.result").alias("answer"))


@query("SELECT conv_id, list_reduce(list_transform(list(text ORDER BY turn)[1:3], lambda x: CASE WHEN length(x) > 50 THEN substr(x, 1, 50) || '...' ELSE x END), lambda a, b: a || '|' || b) AS shown FROM conversations WHERE text IS NOT NULL GROUP BY conv_id")
def q103_trimmed(spark, d):
    rows = table(spark, d, "conversations").filter("text is not null")
    said = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))  # turns of one conversation
    return said.select("conv_id", F.array_join(records.trimmed(F.transform("t", lambda x: x["text"]), 50, 3), "|").alias("shown"))


@query(f"WITH {catalog._EVENT_STEPS}{catalog._WALK}SELECT verdict, count(*) AS n FROM v GROUP BY verdict")
def q52_stream_walk(spark, d):
    """The walk as a stream over the events that have landed, which gives what the batch gives."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    events = spark.readStream.schema(schema).parquet(f"{d}/[e]vents.parquet")  # a pattern may also be a file
    steps = events.select(
        F.col("user_id").alias("key"), F.col("event_id").alias("obs_id"), F.col("ts").cast("timestamp").alias("at"), F.col("event_type").alias("content"), (F.col("event_type") == "error").alias("absent"),
    )
    return walk.landed(spark, walk.stream_verdicts(steps)).groupBy("verdict").agg(F.count("*").alias("n"))


@query("SELECT host, n FROM (SELECT lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS host, count(*) AS n FROM pages GROUP BY host) ORDER BY n DESC, host LIMIT 1")
def q104_busiest_host(spark, d):
    return release.top(table(spark, d, "pages").select(F.lower(F.parse_url("url", F.lit("AUTHORITY"))).alias("host")), "host", 1)


@query("SELECT verdict, content, CASE WHEN grouping(content) = 1 THEN 'all' ELSE 'each' END AS level, count(*) AS n FROM (" + f"WITH {catalog._STEPS}{catalog._WALK}SELECT verdict, content FROM v) GROUP BY GROUPING SETS ((verdict, content), (verdict))")
def q105_tallies(spark, d):
    """Tallies of verdicts by content, and of each verdict as a whole, in one pass."""
    v = chain.verdicts(catalog.order_steps(spark, d))
    level = F.when(F.grouping("content") == 1, "all").otherwise("each").alias("level")
    return v.rollup("verdict", "content").agg(level, F.count("*").alias("n"), F.grouping("verdict").alias("g")).filter("g = 0").select("verdict", "content", "level", "n")
