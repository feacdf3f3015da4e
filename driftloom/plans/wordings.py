"""Queries of the whole word lists over all texts, of flags and rules of changes, and of landed lines and bodies.

Their SQL reads the same texts and lines and applies the lists by itself; it does not know what was put where.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.functions.fixed import AUTHORITY, COMMAND, CREDENTIALS, EXFILTRATION, FILES, FLAGS, INJECTION, NETWORK, ORDERS, PRECEDENCE
from driftloom.operators import changesets, divergence, records, severity
from driftloom.plans.registry import query
from driftloom.session import own_folder, spread, table
from driftloom.sources import landed


def _words(pattern: str) -> str:
    """A list of words between Unicode word borders, for an engine whose ``\\b`` is ASCII: group 1 is the word."""
    other = r"[^\p{L}\p{M}\p{N}_]"
    return rf"'(?:^|{other}){pattern.removeprefix('(?U)').removeprefix(chr(92) + 'b').removesuffix(chr(92) + 'b')}(?:$|{other})'"


def _listed(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _picked(by: str, values) -> str:
    """The value whose place is ``by`` modulo their number, in both engines."""
    return f"CASE {by} % {len(values)} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(values)) + " END"


_TOLD = " UNION ALL ".join(f"SELECT *, '{c}' AS capability, regexp_extract(low, {_words(p)}, 1) AS evidence FROM t" for c, p in divergence.DECLARED.items())


@query(f"WITH t AS (SELECT doc_id, lower(text) AS low FROM documents), h AS ({_TOLD}) SELECT doc_id, capability, evidence FROM h WHERE evidence <> ''")
def q130_declared_in_documents(spark, d):
    """What each whole document says that it can do, with the first word that says so."""
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.explode(divergence.declared(F.col("text"))).alias("h")).select("doc_id", "h.*")


@query(f"WITH t AS (SELECT role, lower(text) AS low FROM conversations), h AS ({_TOLD}) SELECT role, capability, count(*) AS n, count(DISTINCT evidence) AS words FROM h WHERE evidence <> '' GROUP BY ALL")
def q131_declared_in_turns(spark, d):
    """How many turns of each role name a capability, and by how many different words."""
    told = table(spark, d, "conversations").select("role", F.explode(divergence.declared(F.col("text"))).alias("h"))
    return told.groupBy("role", "h.capability").agg(F.count("*").alias("n"), F.countDistinct("h.evidence").alias("words"))


_KINDS = ["tool_added", "tool_description_changed", "schema_param_added", "schema_param_added", "schema_param_added", "param_schema_changed", "annotation_changed", "endpoint_changed", "repository_changed"]
_NAMES = [
    "webhookUrl", "forward_to", "shellCmd", "fileName", "user-key", "sessionTTL", "plain", "host_port", "evalScript", "sinkPath", "APIKey", "remoteURL", "x", "exec.args", "rootDir", "bearer_x", "callback",
]
_SAID = ["", "an origin", "the workdir", "a secret", "none of these"]
_HINTS = ["true", "false", "null", '"true"', "1"]
_SIGNS = [*INJECTION, *AUTHORITY, *ORDERS, "plain words", "other words"]
_PHRASE = f"CASE WHEN doc_id % 2 = 0 THEN upper({_picked('doc_id', _SIGNS)}) ELSE {_picked('doc_id', _SIGNS)} END"
_HINT = """'{{"destructiveHint":' || {} || ',"readOnlyHint":' || {} || '}}'"""
_CHANGE = [
    "doc_id AS change_id", f"{_picked('doc_id', _KINDS)} AS kind", f"{_picked('doc_id', _NAMES)} AS name",
    f"""CASE doc_id % 9 WHEN 1 THEN text WHEN 5 THEN '{{"enum":["a","b"]}}' WHEN 6 THEN {_HINT.format(_picked('doc_id', _HINTS), _picked('(doc_id + 1)', _HINTS))} WHEN 7 THEN 'a' WHEN 8 THEN 'a' END AS before""",
    f"""CASE doc_id % 9 WHEN 0 THEN text || ' ' || {_PHRASE} WHEN 1 THEN text || CASE WHEN doc_id % 4 = 1 THEN text ELSE '' END || ' ' || {_PHRASE}
WHEN 5 THEN '{{"enum":["c' || CAST(doc_id % 4 AS STRING) || '","b","c1"]}}' WHEN 6 THEN {_HINT.format(_picked('(doc_id + 3)', ['false', 'true', '"false"', 'null']), _picked('(doc_id + 2)', _HINTS))}
WHEN 7 THEN 'b' WHEN 8 THEN 'b' ELSE '{{"description":"' || {_picked('(doc_id + 2)', _SAID)} || '","type":"string"}}' END AS after""",
]
_C = f"""c AS (SELECT {', '.join(_CHANGE)} FROM documents), s AS (SELECT *, trim(regexp_replace(regexp_replace(name, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[_.-]+', ' ', 'g')) AS words,
kind IN ('tool_description_changed', 'tool_added') AS told, CASE WHEN kind IN ('annotation_changed', 'param_schema_changed', 'schema_param_added') THEN after END AS aj, CASE WHEN kind IN ('annotation_changed', 'param_schema_changed') THEN before END AS bj FROM c),
w AS (SELECT *, lower(words || chr(10) || coalesce(json_extract_string(aj, '$.description'), '')) AS reach, json_extract(bj, '$.destructiveHint')::VARCHAR AS d0, json_extract(aj, '$.destructiveHint')::VARCHAR AS d1,
json_extract(bj, '$.readOnlyHint')::VARCHAR AS r0, json_extract(aj, '$.readOnlyHint')::VARCHAR AS r1 FROM s)"""
_TESTS = [
    *[f"kind = 'schema_param_added' AND regexp_matches(reach, {_words(p)})" for p in (NETWORK, FILES, CREDENTIALS)],
    f"told AND len(list_filter({_listed(ORDERS)}, lambda p: contains(lower(after), p) AND NOT contains(lower(coalesce(before, '')), p))) > 0",
    "kind = 'tool_added'",
    "kind = 'annotation_changed' AND d0 = 'true' AND d1 = 'false'",
    "kind = 'annotation_changed' AND coalesce(r0, '') <> 'true' AND r1 = 'true'",
    "kind = 'tool_description_changed' AND length(before) > 0 AND length(after) >= 2 * length(before)",
    "kind IN ('endpoint_changed', 'repository_changed')",
]
_FLAGGED = ", ".join(f"CASE WHEN {t} THEN '{f}' END" for t, f in zip(_TESTS, FLAGS))


def changes_of_documents(spark: SparkSession, d: str) -> DataFrame:
    """A change (change_id, kind, name, before, after) for each document; texts are whole and end in a phrase."""
    return table(spark, d, "documents").selectExpr(*_CHANGE)


@query(f"WITH {_C} SELECT change_id, kind, concat_ws(',', {_FLAGGED}) AS flags FROM w")
def q132_flags_of_changes(spark, d):
    """All nine flags with their whole lists; hints that are no booleans raise none."""
    found = severity.change_flags(F.col("kind"), F.col("name"), F.col("before"), F.col("after"))
    return changes_of_documents(spark, d).select("change_id", "kind", F.array_join(found, ",").alias("flags"))


_FIRST = "list_filter({}, lambda p: contains(lower(after), p))[1]"
_PARAM = "CASE WHEN kind = 'schema_param_added' {} THEN words END"
_LEAKS, _RUNS = (f"regexp_matches(lower(words), {_words(p)})" for p in (EXFILTRATION, COMMAND))
_ENUM = "from_json(json_extract({}, '$.enum'), '[\"VARCHAR\"]')"
_HITS = [
    ("injection_phrase_added", 0, True, f"CASE WHEN told THEN {_FIRST.format(_listed(INJECTION))} END"),
    ("authority_claim_added", 2, True, f"CASE WHEN told THEN {_FIRST.format(_listed(AUTHORITY))} END"),
    ("annotation_downgraded", 2, True, "CASE WHEN d0 = 'true' AND d1 = 'false' THEN 'destructiveHint true -> false' WHEN r0 = 'false' AND r1 = 'true' THEN 'readOnlyHint false -> true' END"),
    ("exfiltration_param_added", 1, True, _PARAM.format(f"AND {_LEAKS}")),
    ("command_param_added", 3, True, _PARAM.format(f"AND NOT {_LEAKS} AND {_RUNS}")),
    ("network_param_added", 1, False, _PARAM.format(f"AND NOT {_LEAKS} AND NOT {_RUNS} AND regexp_matches(reach, {_words(NETWORK)})")),
    ("enum_widened", 3, False, f"CASE WHEN kind = 'param_schema_changed' THEN nullif(array_to_string(list_sort(list_distinct(list_filter({_ENUM.format('aj')}, lambda x: NOT list_contains({_ENUM.format('bj')}, x)))), ', '), '') END"),
    ("endpoint_moved", 1, False, "CASE WHEN kind = 'endpoint_changed' THEN 'server/remotes' END"),
    ("tool_added", 3, False, "CASE WHEN kind = 'tool_added' THEN 'tools' END"),
]
_HIT = " UNION ALL ".join(f"SELECT change_id, '{r}' AS rule, {k} AS rank, {c} AS confident, {e} AS evidence FROM w" for r, k, c, e in _HITS)


def new_texts(spark: SparkSession, d: str) -> DataFrame:
    """The same changes, of which each text is new as a whole."""
    return changes_of_documents(spark, d).withColumn("before", F.when(F.col("kind") != "tool_description_changed", F.col("before")))


@query(f"WITH {_C}, h AS ({_HIT}) SELECT change_id, rule, {_listed(PRECEDENCE)}[rank + 1] AS label, confident, evidence FROM h WHERE evidence IS NOT NULL")
def q133_rule_hits(spark, d):
    """Every hit of the nine rules with its evidence."""
    text = F.when(F.col("kind").isin("tool_added", "tool_description_changed"), F.col("after"))
    hits = severity.rule_hits(F.col("kind"), F.col("name"), F.col("before"), F.col("after"), text)
    return new_texts(spark, d).select("change_id", F.explode(hits).alias("h")).select("change_id", "h.*")


@query(f"""WITH {_C}, h AS ({_HIT}), k AS (SELECT DISTINCT change_id // 3 AS key FROM c), r AS (SELECT DISTINCT change_id // 3 AS key, rule, rank, confident FROM h WHERE evidence IS NOT NULL),
g AS (SELECT key, min(rank) FILTER (confident) AS best, string_agg(rule, ',' ORDER BY NOT confident, rule) AS rules FROM r GROUP BY key)
SELECT k.key, coalesce({_listed(PRECEDENCE)}[best + 1], 'deferred') AS label, coalesce(rules, '') AS rules FROM k LEFT JOIN g ON k.key = g.key""")
def q134_labels_of_sets(spark, d):
    """Label and rules of change sets of three documents each: one hit a rule, confident ones first."""
    sets = new_texts(spark, d).withColumn("key", F.expr("change_id div 3"))
    found = severity.labels(sets, "key", "change_id")
    return found.select("key", "label", F.array_join("hits.rule", ",").alias("rules"))


_STAMP = "CAST(event_id AS STRING) || '.' || lpad(CAST(event_id % 1000 AS STRING), 3, '0')"
_TRACED = f"""CASE event_id % 6 WHEN 0 THEN '[pid   ' || CAST(user_id AS STRING) || '] ' || {_STAMP} || ' openat(AT_FDCWD, "/data/' || event_type || '", O_RDONLY) = 3' WHEN 1 THEN CAST(user_id AS STRING) || ' ' || {_STAMP} || ' connect(3, {{sa_family=AF_INET}}, 16) = 0'
WHEN 2 THEN {_STAMP} || ' execve("/bin/sh", ["sh"], 0x7f) = 0' WHEN 3 THEN '[pid ' || CAST(user_id AS STRING) || '] +++ exited with 0 +++' WHEN 4 THEN {_STAMP} || ' --- SIGCHLD (' || event_type || ') ---' ELSE CAST(event_id AS STRING) || ' close(4) = 0' END"""
_PARSED = r"'^(?:\[pid\s+\d+\]\s+|\d+\s+)?(\d+\.\d+)\s+(\w+)\((.*)$'"


@query(f"WITH l AS (SELECT {_TRACED} AS line FROM events) SELECT regexp_extract(line, {_PARSED}, 1)::DOUBLE AS at, regexp_extract(line, {_PARSED}, 2) AS call, regexp_extract(line, {_PARSED}, 3) AS args FROM l WHERE regexp_matches(line, {_PARSED})")
def q135_trace_lines(spark, d):
    """System calls of traces in both styles; exits, signals and lines without a time are passed over."""
    at = own_folder(spark, "traces") + "/text"
    table(spark, d, "events").selectExpr(f"{_TRACED} as value").write.text(at)
    return landed.trace_events(spark, at)


_SUNK = """'{"at":' || CAST(event_id AS STRING) || '.5,"kind":"' || CASE event_id % 4 WHEN 0 THEN 'dns' WHEN 3 THEN 'udp' ELSE 'tcp' END || '"' || CASE WHEN event_id % 5 > 0 THEN ',"query":"' || event_type || '.example"' ELSE '' END
|| CASE event_id % 7 WHEN 0 THEN ',"sni":null' WHEN 1 THEN '' ELSE ',"sni":"h' || CAST(user_id AS STRING) || '"' END || ',"dest_port":' || CAST(event_id % 1000 AS STRING) || '}'"""


@query(f"""WITH l AS (SELECT {_SUNK} AS j FROM events), e AS (SELECT json_extract(j, '$.at')::DOUBLE AS "at", CASE json_extract_string(j, '$.kind') WHEN 'dns' THEN 'DNS ' || json_extract_string(j, '$.query')
WHEN 'tcp' THEN 'TCP ' || coalesce(json_extract_string(j, '$.sni'), 'port ' || json_extract_string(j, '$.dest_port')) END AS event FROM l) SELECT "at", event FROM e WHERE event IS NOT NULL""")
def q136_sinkhole_lines(spark, d):
    """Lookups and connections of landed records; other kinds and lookups without a name are no events."""
    at = own_folder(spark, "sinkhole") + "/text"
    table(spark, d, "events").selectExpr(f"{_SUNK} as value").write.text(at)
    return landed.sinkhole_events(spark, at)


_FRAMES = """'event: message' || chr(13) || chr(10) || 'data: {"id":' || CAST(event_id AS STRING) || ',' || chr(13) || chr(10) || 'data:"t":"' || event_type || '"}' || chr(10) || chr(10) || ': kept alive' || chr(10) || chr(10)
|| CASE event_id % 3 WHEN 0 THEN 'data: no json {' WHEN 1 THEN 'data: [' || CAST(user_id AS STRING) || ']' ELSE 'id: 7' || chr(10) || 'data:' END || chr(10) || chr(10) || chr(10) || CASE WHEN event_id % 2 = 0 THEN 'data: "last"' ELSE '' END"""


@query(f"""WITH b AS (SELECT event_id, unnest(string_split_regex(replace({_FRAMES}, chr(13), ''), '\\n\\n+')) AS f FROM events),
m AS (SELECT event_id, array_to_string(list_transform(list_filter(string_split(f, chr(10)), lambda x: starts_with(x, 'data:')), lambda x: regexp_replace(x, '^data: ?', '')), chr(10)) AS message FROM b) SELECT event_id, message FROM m WHERE message <> '' AND json_valid(message)""")
def q137_event_frames(spark, d):
    """JSON messages of event streams: data over several lines, comments, frames that are no JSON, a last frame without an end."""
    return table(spark, d, "events").select("event_id", F.explode(landed.event_frames(F.expr(_FRAMES))).alias("message"))


@query("""WITH b AS (SELECT p_partkey, p_type || '|' || p_size AS body FROM part), h AS (SELECT DISTINCT body FROM b WHERE p_partkey % 2 = 0)
SELECT sha256(body) AS sha, 'damaged' AS what FROM h WHERE sha256(body) LIKE '0%' UNION ALL SELECT DISTINCT sha256(body), 'new' FROM b WHERE body NOT IN (SELECT body FROM h)""")
def q138_stored_bodies(spark, d):
    """Bodies that a store lacks, each once, and those that it holds under a name that they do not hash to."""
    bodies = table(spark, d, "part").select("p_partkey", F.concat("p_type", F.lit("|"), F.col("p_size").cast("string")).alias("body"))
    held = landed.new_blobs(bodies.limit(0).select(F.sha2("body", 256).alias("sha")), bodies.filter("p_partkey % 2 = 0"))
    held = held.withColumn("body", F.when(F.col("sha").startswith("0"), F.concat("body", F.lit("!"))).otherwise(F.col("body")))
    found = landed.damaged_blobs(held).select("sha", F.lit("damaged").alias("what"))
    return found.unionByName(landed.new_blobs(held, bodies).select("sha", F.lit("new").alias("what")))


@query("""WITH r AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'ok' WHEN 'O' THEN 'timeout' END AS status, CASE o_orderkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS latest FROM orders)
SELECT status, count(*) AS n FROM r WHERE latest IS DISTINCT FROM false AND status <> 'ok' GROUP BY status""")
def q139_current_failures(spark, d):
    """Failures among entries that do not say that they were replaced; a row without a status is none."""
    status = F.when(F.col("o_orderstatus") == "F", "ok").when(F.col("o_orderstatus") == "O", "timeout")
    latest = F.when(F.col("o_orderkey") % 3 == 0, True).when(F.col("o_orderkey") % 3 == 1, False)
    rows = table(spark, d, "orders").select("o_orderkey", status.alias("status"), latest.alias("latest"))
    return records.failures(records.current_only(rows, "latest"), "status").groupBy("status").agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT *, epoch_us(ts) / 1e6 AS sec FROM events), w AS (SELECT user_id, event_id AS call, sec AS a, coalesce(CASE WHEN event_id % 4 > 0 THEN sec + 600 * (event_id % 7) END, sec) + 0.75 AS b FROM e WHERE event_type = 'purchase')
SELECT call, event_id FROM w JOIN e ON w.user_id = e.user_id AND sec BETWEEN a AND b""")
def q140_settled_calls(spark, d):
    """Events of each call until it has settled; a failed call has no end and only settles."""
    e = table(spark, d, "events").select("user_id", "event_id", "event_type", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    calls = e.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("call"), F.col("at").alias("start"), F.when(F.col("event_id") % 4 > 0, F.col("at") + 600 * (F.col("event_id") % 7)).alias("end"))
    return divergence.in_windows(e.select("user_id", "event_id", "at"), divergence.call_windows(calls), "user_id").select("call", "event_id")


@query("""WITH s AS (SELECT event_id, epoch_us(date_trunc('second', ts)) AS us FROM events)
SELECT event_id, CASE event_id % 6 WHEN 0 THEN us WHEN 1 THEN us - 7200000000 WHEN 2 THEN us + 19800000000 + 250000 END AS micros FROM s""")
def q141_read_times(spark, d):
    """Times with their offsets as microseconds; those without one, without a text or out of range are none."""
    t = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    k = F.col("event_id") % 6
    text = F.when(k == 0, F.concat(t, F.lit("Z"))).when(k == 1, F.concat(t, F.lit("+02:00"))).when(k == 2, F.concat(t, F.lit(".25-05:30"))).when(k == 3, t).when(k == 4, F.lit("2024-13-01T00:00:00Z"))
    return table(spark, d, "events").select("event_id", F.unix_micros(records.from_iso(text)).alias("micros"))


_TWICE = """'{"tools":[{"name":"a","description":"first"},{"description":"nameless"},{"name":" a ","description":"' || {} || '"},{"name":"","description":"blank"}]}'"""


@query("SELECT p_partkey AS key, 'tool_description_changed' AS kind, 'tools/a/description' AS path FROM part WHERE CAST(p_size AS STRING) <> CAST(p_partkey % 50 AS STRING)")
def q142_repeated_members(spark, d):
    """Tools that are named twice: the last counts, and those without a name do not."""
    pairs = spread(table(spark, d, "part").select("p_partkey", "p_size"), "p_partkey").selectExpr("p_partkey as key", f"{_TWICE.replace('{}', 'CAST(p_size AS STRING)', 1)} as before", f"{_TWICE.replace('{}', 'CAST(p_partkey % 50 AS STRING)', 1)} as after")
    return changesets.manifest_changes(pairs, "key", "before", "after").select("key", "kind", "path")
