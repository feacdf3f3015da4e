"""Change sets of documents that are built from the driver's rows, with SQL over the rows themselves.

A part is a tool of the manifest of its ten parts, and a customer has a listing. Each is built as it
was and as it is; what changed follows from the row's numbers, so DuckDB needs no documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.operators import changesets, severity
from driftloom.plans.registry import query
from driftloom.session import spread, table

_TOOL = """concat('{{"annotations":{{"readOnlyHint":', {hint}, '}},"description":"word', k, ' alpha', {more}, '"', {execution}, ',"inputSchema":{{', {frame}, '"properties":{{', {callback},
'"k', k, '":{{"type":"string"}},"path":{{"format":"', {format}, '","type":"string"}},"size":{{"description":"', {said}, '","type":"', {kind}, '"}}}},"required":[', {required}, '],"type":"object"}},"name":"t', k, '"', {title}, '}}')"""
_BEFORE = _TOOL.format(
    hint="s % 2 = 0", more="''", execution="''", frame="''", callback="if(s % 3 <> 0, '\"callback\":{\"type\":\"string\"},', '')", format="'a'", said="'n'", kind="'integer'",
    required="if(s % 4 in (0, 2), '\"size\"', '')", title="''",
)
_AFTER = _TOOL.format(
    hint="(s % 2 = 0) <> (k % 7 = 0)", more="if(k % 5 = 0, ' you must', '')", execution="if(k % 11 = 0, ',\"execution\":{\"mode\":\"x\"}', '')",
    frame="if(k % 13 = 0, '\"additionalProperties\":false,', '')", callback="if(s % 3 <> 1, '\"callback\":{\"type\":\"string\"},', '')", format="if(k % 8 = 0, 'b', 'a')",
    said="if(k % 9 = 0, 'm', 'n')", kind="if(k % 6 = 0, 'number', 'integer')",
    required="concat_ws(',', if(s % 3 = 0, '\"callback\"', null), if(s % 4 in (0, 1), '\"size\"', null))", title="if(k % 12 = 0, ',\"title\":\"T\"', '')",
)
_RENAMED = """concat('{"description":"renamed tool', %s, '","inputSchema":{"properties":{"z', key, '":{"type":"string"}},"type":"object"},"name":"', %s, key, '"}')"""
_DOCUMENT = """concat('{{', {top}, '"prompts":[', {prompts}, '],"protocolVersion":"', {protocol}, '","resources":[', {resources}, '],"serverInfo":{{"version":"', {version}, '"}},"tools":[', array_join(tools, ','), ']}}')"""


def manifest_pairs(spark: SparkSession, d: str) -> DataFrame:
    """(key, before, after): manifests of up to ten parts each, so a manifest never grows with the table."""
    rows = table(spark, d, "part").selectExpr("floor(p_partkey / 10) as key", "p_partkey as k", "p_size as s")
    tools = spread(rows, "key").groupBy("key").agg(
        F.expr(f"array_sort(collect_list({_BEFORE}) filter (where k % 4 <> 1))").alias("b"), F.expr(f"array_sort(collect_list({_AFTER}) filter (where k % 4 <> 2))").alias("a")
    )
    both = tools.selectExpr(
        "key", f"if(key % 2 = 0, array_append(b, {_RENAMED % (repr(''), repr('old'))}), b) as b", f"if(key % 2 = 0, array_append(a, {_RENAMED % (repr(' again'), repr('new'))}), a) as a"
    )
    before = _DOCUMENT.format(top="''", prompts="if(key % 3 <> 0, '{\"description\":\"d\",\"name\":\"main\"}', '')", protocol="'p'", resources="if(key % 4 < 2, '{\"uri\":\"u1\"}', '')", version="'1'")
    after = _DOCUMENT.format(
        top="if(key % 7 = 0, '\"capabilities\":{\"x\":1},', '')", prompts="if(key % 3 <> 1, concat('{\"description\":\"', if(key % 5 = 0, 'e', 'd'), '\",\"name\":\"main\"}'), '')",
        protocol="if(key % 8 = 0, 'q', 'p')", resources="if(key % 4 in (1, 2), '{\"uri\":\"u1\"}', '')", version="if(key % 6 = 0, '2', '1')",
    )
    return both.selectExpr("key", before.replace("tools,", "b,") + " as before", after.replace("tools,", "a,") + " as after")


def manifest_rows(spark: SparkSession, d: str) -> DataFrame:
    return changesets.manifest_changes(manifest_pairs(spark, d), "key", "before", "after")


_PART = "r AS (SELECT p_partkey // 10 AS key, p_partkey AS k, p_size AS s, p_partkey % 4 NOT IN (1, 2) AS stays FROM part), g AS (SELECT DISTINCT key FROM r)"
_P = "concat('tools/t', k, '/inputSchema/properties/{}')"
_MANIFEST = f"""{_PART}, c AS (
SELECT key, 'tool_renamed' AS kind, concat('tools/old', key) AS path, NULL AS detail FROM g WHERE key % 2 = 0
UNION ALL SELECT key, 'tool_description_changed', concat('tools/new', key, '/description'), NULL FROM g WHERE key % 2 = 0
UNION ALL SELECT key, 'tool_added', concat('tools/t', k), concat('word', k, ' alpha', CASE WHEN k % 5 = 0 THEN ' you must' ELSE '' END) FROM r WHERE k % 4 = 1
UNION ALL SELECT key, 'tool_removed', concat('tools/t', k), NULL FROM r WHERE k % 4 = 2
UNION ALL SELECT key, 'tool_description_changed', concat('tools/t', k, '/description'), NULL FROM r WHERE stays AND k % 5 = 0
UNION ALL SELECT key, 'annotation_changed', concat('tools/t', k, '/annotations'), NULL FROM r WHERE stays AND k % 7 = 0
UNION ALL SELECT key, 'execution_changed', concat('tools/t', k, '/execution'), NULL FROM r WHERE stays AND k % 11 = 0
UNION ALL SELECT key, 'schema_param_added', {_P.format('callback')}, 'required' FROM r WHERE stays AND s % 3 = 0
UNION ALL SELECT key, 'schema_param_removed', {_P.format('callback')}, NULL FROM r WHERE stays AND s % 3 = 1
UNION ALL SELECT key, 'param_type_changed', {_P.format('size')}, NULL FROM r WHERE stays AND k % 6 = 0
UNION ALL SELECT key, 'param_description_changed', {_P.format('size')}, NULL FROM r WHERE stays AND k % 9 = 0
UNION ALL SELECT key, 'param_schema_changed', {_P.format('path')}, NULL FROM r WHERE stays AND k % 8 = 0
UNION ALL SELECT key, 'param_became_required', {_P.format('callback')}, NULL FROM r WHERE stays AND s % 3 = 0
UNION ALL SELECT key, 'param_became_required', {_P.format('size')}, NULL FROM r WHERE stays AND s % 4 = 1
UNION ALL SELECT key, 'param_became_optional', {_P.format('size')}, NULL FROM r WHERE stays AND s % 4 = 2
UNION ALL SELECT key, 'tool_field_changed', concat('tools/t', k, '/inputSchema'), NULL FROM r WHERE stays AND k % 13 = 0
UNION ALL SELECT key, 'tool_field_changed', concat('tools/t', k, '/title'), NULL FROM r WHERE stays AND k % 12 = 0
UNION ALL SELECT key, CASE key % 3 WHEN 0 THEN 'prompt_added' WHEN 1 THEN 'prompt_removed' ELSE 'prompt_changed' END, 'prompts/main', NULL FROM g WHERE key % 3 < 2 OR key % 5 = 0
UNION ALL SELECT key, CASE key % 4 WHEN 0 THEN 'resource_removed' ELSE 'resource_added' END, 'resources/u1', NULL FROM g WHERE key % 4 IN (0, 2)
UNION ALL SELECT key, 'server_info_changed', 'serverInfo', NULL FROM g WHERE key % 6 = 0
UNION ALL SELECT key, 'capabilities_changed', 'capabilities', NULL FROM g WHERE key % 7 = 0
UNION ALL SELECT key, 'manifest_field_changed', 'protocolVersion', NULL FROM g WHERE key % 8 = 0)"""


@query(f"WITH {_MANIFEST} SELECT key, kind, path, detail FROM c")
def q33_manifest_changes(spark, d):
    return manifest_rows(spark, d).select("key", "kind", "path", "detail")


@query(f"WITH {_MANIFEST} SELECT key, kind, path, ' you must' AS gained FROM c WHERE kind = 'tool_description_changed' AND path LIKE 'tools/t%' UNION ALL SELECT key, kind, path, ' again' FROM c WHERE kind = 'tool_description_changed' AND path LIKE 'tools/new%' "
       "UNION ALL SELECT key, kind, path, ' m' FROM c WHERE kind = 'param_description_changed' UNION ALL SELECT key, kind, path, ' e' FROM c WHERE kind = 'prompt_changed'")
def q57_text_changes(spark, d):
    told = manifest_rows(spark, d).filter("diff is not null")
    return told.select("key", "kind", "path", F.concat(F.lit(" "), F.array_join("diff.added", " ")).alias("gained"))


@query(f"""WITH {_MANIFEST}, n AS (SELECT key, kind, path, CASE kind WHEN 'tool_added' THEN 0 ELSE 1 END AS x FROM c)
SELECT kind, count(DISTINCT key) AS n FROM n GROUP BY kind""")
def q58_kind_tallies(spark, d):
    pairs = manifest_pairs(spark, d).select("key", "before", "after")
    sets = changesets.change_sets(pairs, changesets.manifest_changes(pairs, "key", "before", "after"), "key")
    return sets.select("key", F.explode("kinds").alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


_FLAGGED = f"""WITH {_PART}, f AS (SELECT key,
 bool_or((stays AND s % 3 = 0) OR (k % 4 = 1 AND s % 3 <> 1)) AS network, bool_or(k % 4 = 1) AS files, bool_or(k % 5 = 0 AND k % 4 <> 2) AS orders, bool_or(k % 4 = 1) AS grew,
 bool_or(stays AND k % 7 = 0 AND s % 2 <> 0) AS readonly FROM r GROUP BY key)"""


def change_names(rows: DataFrame) -> DataFrame:
    """Change rows as the flags and rules read them: ``name`` is the parameter, else the tool or path."""
    return rows.withColumn("name", F.coalesce("at.part", "tool", "path"))


@query(f"""{_FLAGGED} SELECT key, concat_ws(',', CASE WHEN network THEN 'network_param_added' END, CASE WHEN files THEN 'filesystem_param_added' END, CASE WHEN orders THEN 'imperative_language_added' END,
CASE WHEN grew THEN 'tool_count_grew' END, CASE WHEN readonly THEN 'readonly_hint_set' END) AS flags FROM f JOIN (SELECT DISTINCT key FROM (WITH {_MANIFEST} SELECT key FROM c)) USING (key)""")
def q59_manifest_flags(spark, d):
    return severity.flags(change_names(manifest_rows(spark, d)), "key").select("key", F.array_join("flags", ",").alias("flags"))


@query(f"""{_FLAGGED}, e AS (SELECT key, bool_or(stays AND s % 3 = 0) AS leaks FROM r GROUP BY key) SELECT key, CASE WHEN leaks THEN 'exfiltration_addition' WHEN readonly THEN 'authority_escalation' ELSE 'deferred' END AS label
FROM f JOIN e USING (key) JOIN (SELECT DISTINCT key FROM (WITH {_MANIFEST} SELECT key FROM c)) USING (key)""")
def q60_rule_labels(spark, d):
    return severity.labels(change_names(manifest_rows(spark, d)), "key").select("key", "label")


@query("SELECT p_partkey // 10 AS key, string_agg('t' || p_partkey, '|' ORDER BY 't' || p_partkey) AS fingerprint FROM part WHERE p_partkey % 4 <> 1 AND (p_partkey // 10) % 2 = 1 GROUP BY 1")
def q61_fingerprints(spark, d):
    return manifest_pairs(spark, d).filter("key % 2 = 1").select("key", changesets.tool_fingerprint(F.col("before")).alias("fingerprint")).filter("fingerprint <> ''")


_LISTING = """concat('{"_meta":{"io.modelcontextprotocol.registry/official":{"status":"', %(status)s, '"}},"server":{"description":"d', %(more)s, '","name":"s","packages":[{"environmentVariables":[{"isSecret":', %(secret)s,
',"name":"K"}],"identifier":"', %(package)s, '","registryType":"npm"}],"remotes":[{"type":"sse","url":"https://a"}', %(remote)s, '],"repository":{"url":"r', %(moved)s, '"}', %(title)s, ',"version":"', %(version)s, '"}}')"""


def listing_pairs(spark: SparkSession, d: str) -> DataFrame:
    """(key, before, after): a listing of each customer."""
    was = {"status": "'active'", "more": "''", "secret": "'false'", "package": "'p'", "remote": "''", "moved": "''", "title": "''", "version": "'1'"}
    now = {
        "status": "if(k % 9 = 0, 'deprecated', 'active')", "more": "if(k % 2 = 0, ' more', '')", "secret": "if(k % 7 = 0, 'true', 'false')", "package": "if(k % 6 = 0, 'q', 'p')",
        "remote": "if(k % 4 = 0, ',{\"type\":\"sse\",\"url\":\"https://b\"}', '')", "moved": "if(k % 5 = 0, 'x', '')", "title": "if(k % 8 = 0, ',\"title\":\"T\"', '')", "version": "if(k % 3 = 0, '2', '1')",
    }
    return spread(table(spark, d, "customer").selectExpr("c_custkey as k"), "k").selectExpr("k as key", _LISTING % was + " as before", _LISTING % now + " as after")


@query("""WITH r AS (SELECT c_custkey AS key FROM customer) SELECT key, 'server_description_changed' AS kind, NULL AS detail FROM r WHERE key % 2 = 0 UNION ALL SELECT key, 'endpoint_changed', '+https://b' FROM r WHERE key % 4 = 0
UNION ALL SELECT key, 'repository_changed', NULL FROM r WHERE key % 5 = 0 UNION ALL SELECT key, 'package_identity_changed', '+npm:q; -npm:p' FROM r WHERE key % 6 = 0 UNION ALL SELECT key, 'package_changed', NULL FROM r WHERE key % 7 = 0 AND key % 6 <> 0
UNION ALL SELECT key, 'auth_requirement_changed', '+env:K' FROM r WHERE key % 7 = 0 UNION ALL SELECT key, 'version_bumped', NULL FROM r WHERE key % 3 = 0 UNION ALL SELECT key, 'registry_status_changed', NULL FROM r WHERE key % 9 = 0
UNION ALL SELECT key, 'server_field_changed', NULL FROM r WHERE key % 8 = 0""")
def q32_listing_changes(spark, d):
    return changesets.listing_rows(listing_pairs(spark, d), "key", "before", "after").select("key", "kind", "detail")


@query("SELECT c_custkey AS key, (c_custkey % 4 = 0)::INT + 1 AS ends, c_custkey % 7 = 0 AS secret, CASE WHEN c_custkey % 6 = 0 THEN 'npm:q' ELSE 'npm:p' END AS package, concat('r', CASE WHEN c_custkey % 5 = 0 THEN 'x' ELSE '' END) AS repo, 'https://a' AS first, c_custkey % 5 = 0 AS replaced FROM customer")
def q62_listing_fields(spark, d):
    from driftloom.operators import listings as L

    a = F.col("after")
    return listing_pairs(spark, d).select(
        "key", F.size(L.endpoints(a)).alias("ends"), (F.size(L.secret_inputs(a)) > 0).alias("secret"), F.array_join(L.packages(a), ",").alias("package"), L.repository(a).alias("repo"),
        L.primary_endpoint(a).alias("first"), L.replaced(F.col("before"), a).alias("replaced"),
    )
