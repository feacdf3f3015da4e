import pytest
from pyspark.sql import functions as F

from driftloom.operators import changesets
from driftloom.plans import evidence, manifests, release, wordings
from driftloom.session import SPREAD, spread


def cores(spark):
    return spark.sparkContext.defaultParallelism


def test_short_rows_of_one_task_are_dealt_over_all_cores(spark):
    rows = spread(spark.range(1000).coalesce(1), "id")
    assert rows.rdd.getNumPartitions() == SPREAD * cores(spark) and rows.agg(F.sum("id")).first()[0] == 499500


@pytest.mark.parametrize("pairs", [manifests.listing_pairs, manifests.manifest_pairs, evidence.listing_pairs])
def test_documents_are_built_on_all_cores(spark, sf, pairs):
    assert pairs(spark, sf).rdd.getNumPartitions() == SPREAD * cores(spark)


@pytest.mark.parametrize("query", [release.q95_arguments, release.q96_schema_profiles, manifests.q32_listing_changes, manifests.q62_listing_fields])
def test_their_work_is_dealt_too(spark, sf, query):
    assert query(spark, sf).rdd.getNumPartitions() == SPREAD * cores(spark)


@pytest.mark.parametrize("query", [release.q94_exercise_reasons, evidence.q107_typed_manifest_fields, wordings.q142_repeated_members])
def test_queries_deal_their_rows_before_they_read_them(spark, sf, query):
    assert "RepartitionByExpression [p_partkey" in query(spark, sf)._jdf.queryExecution().optimizedPlan().toString()


def test_a_listing_is_read_once_a_side(spark):
    pairs = spark.createDataFrame([(1, "{}", "{}")], "key long, before string, after string")
    plan = changesets.listing_rows(pairs, "key", "before", "after")._jdf.queryExecution().optimizedPlan().toString()
    generate = next(line for line in plan.splitlines() if "Generate explode" in line)
    assert "get_json_object" not in generate and "from_json" not in generate


def test_manifests_are_read_once_and_tools_compared_on_all_cores(spark):
    tool = '{"description":"%s","inputSchema":{"properties":{"p":{"type":"%s"}}},"name":"t"}'
    pairs = spark.createDataFrame([(1, '{"tools":[%s]}' % (tool % ("a", "string")), '{"tools":[%s]}' % (tool % ("b", "number")))], "key long, before string, after string")
    found = changesets.manifest_changes(pairs, "key", "before", "after")
    assert sorted(r.kind for r in found.collect()) == ["param_type_changed", "tool_description_changed"]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [key" in plan and "$.inputSchema" not in next(line for line in plan.splitlines() if "Generate explode" in line and "tool_renamed" in line)


def test_parts_of_tools_are_read_from_schemas_that_differ(spark):
    tool = '{"description":%s,"inputSchema":%s,"name":"t"}'
    schemas = ['{"properties":{"p":{"default":%s}},"required":[%s]}' % x for x in (("1", ""), ('"1"', ""), ("1", '"p"'))]
    rows = [(1, tool % ('"1"', schemas[0]), tool % ("1", schemas[0])), (2, tool % ('"a"', schemas[0]), tool % ('"a"', schemas[1])), (3, tool % ('"a"', schemas[0]), tool % ('"a"', schemas[2])),
            (4, tool % ("null", "null"), tool % ('"a"', schemas[2])), (5, tool % ("null", "{}"), tool % ("null", "{}"))]
    pairs = spark.createDataFrame([(k, '{"capabilities":%s,"tools":[%s]}' % ("1", b), '{"capabilities":%s,"tools":[%s]}' % ('"1"' if k == 5 else "1", a)) for k, b, a in rows], "key long, before string, after string")
    found = changesets.manifest_changes(pairs, "key", "before", "after")
    assert sorted((r.key, r.kind) for r in found.collect()) == [
        (1, "tool_description_changed"), (2, "param_schema_changed"), (3, "param_became_required"), (4, "param_became_required"), (4, "schema_param_added"), (4, "tool_description_changed"), (5, "capabilities_changed"),
    ]
    assert "$.inputSchema.properties" not in found._jdf.queryExecution().optimizedPlan().toString()
