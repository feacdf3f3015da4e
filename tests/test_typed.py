import json

from pyspark.sql import functions as F

from driftloom.functions import typed
from driftloom.operators import changesets, exercise, severity

VALUES = ['"1"', "1", "1.0", "true", '"true"', "null", '{"a":1}', '{"a":"1"}', "[1,true]", "[1.0,1]", '"q\\"uo\\nte é"', "-0", "0.0", "false", "1e2", "100", "0.10", "0.1", '"[1]"', "9007199254740993", "9007199254740992.0"]


def test_both_equalities_of_all_pairs(spark):
    pairs = [(a, b, f'{{"x":{a}}}', f'{{"x":{b}}}' if k % 2 or b != "null" else "{}") for k, a in enumerate(VALUES) for b in VALUES]
    df = spark.createDataFrame(pairs, "a string, b string, da string, db string")
    for equality, canon in (("json", lambda v: json.dumps(v, sort_keys=True)), ("python", lambda v: v)):
        got = df.select("a", "b", typed.changed_members(F.col("da"), F.col("db"), equality).alias("c")).collect()
        for r in got:
            a, b = json.loads(r.a), json.loads(r.b)
            if "-0" in (r.a, r.b) and equality == "json" or "e" in r.a + r.b and equality == "json" and {r.a, r.b} & {"1e2", "0.10", "-0"}:
                continue  # not canonical text
            if {r.a, r.b} == {"0.10", "0.1"} and equality == "json":
                continue
            assert bool(r.c) == (canon(a) != canon(b)), (equality, r)


def test_members_that_are_no_objects(spark):
    df = spark.createDataFrame([(None,), ("[1]",), ('"x"',), ("{broken",), ("{}",), ('{"a":null,"b":"t"}',)], "d string")
    assert [r[0] for r in df.select(typed.typed_members(F.col("d"))).collect()] == [{}, {}, {}, {}, {}, {"a": None, "b": '"t"'}]
    assert [r[0] for r in df.select(typed.string_at(F.col("d"), "$.b")).collect()] == [None] * 5 + ["t"]


def test_a_change_of_type_alone_is_a_change(spark):
    tool = '{"annotations":{"x":%s},"description":%s,"inputSchema":{"extra":%s,"properties":{"p":{"type":%s}}},"name":"t","title":%s}'
    doc = '{"capabilities":%s,"protocolVersion":%s,"tools":[' + tool + "]}"
    before, after = doc % (1, 1, 1, 1, 1, 1, 1), doc % (('"1"',) * 7)
    rows = changesets.manifest_changes(spark.createDataFrame([(1, before, after), (2, before, before)], "key long, before string, after string"), "key", "before", "after")
    assert sorted((r.key, r.kind, r.path) for r in rows.collect()) == [
        (1, "annotation_changed", "tools/t/annotations"), (1, "capabilities_changed", "capabilities"), (1, "manifest_field_changed", "protocolVersion"),
        (1, "param_type_changed", "tools/t/inputSchema/properties/p"), (1, "tool_description_changed", "tools/t/description"),
        (1, "tool_field_changed", "tools/t/inputSchema"), (1, "tool_field_changed", "tools/t/title"),
    ]


def test_parameters_that_are_no_objects(spark):
    doc = '{"tools":[{"inputSchema":{"properties":{"p":%s,"q":{"default":%s}}},"name":"t"}]}'
    rows = [(k, doc % b, doc % a) for k, (b, a) in enumerate([(("true", "1"), ('"true"', "1")), (("true", "1"), ("true", '"1"')), (('"1"', "null"), ("1", "null")), (("1", "1"), ("1", "1"))])]
    got = changesets.manifest_changes(spark.createDataFrame(rows, "key long, before string, after string"), "key", "before", "after")
    assert sorted((r.key, r.kind, r.path[-1]) for r in got.collect()) == [(0, "param_schema_changed", "p"), (1, "param_schema_changed", "q"), (2, "param_schema_changed", "p")]


def test_hints_are_booleans(spark):
    flags = lambda b, a: severity.change_flags(F.lit("annotation_changed"), F.lit("t"), F.lit(b), F.lit(a))
    row = spark.range(1).select(
        flags('{"destructiveHint":true}', '{"destructiveHint":false}').alias("a"), flags('{"destructiveHint":"true"}', '{"destructiveHint":"false"}').alias("b"),
        exercise.decision(F.lit('{"annotations":{"destructiveHint":"true"},"name":"get"}'))["allowed"].alias("c"), exercise.decision(F.lit('{"annotations":{"destructiveHint":true},"name":"get"}'))["allowed"].alias("d"),
    ).first()
    assert row.a == ["destructive_hint_cleared"] and row.b == [] and row.c and not row.d


def nest(depth, leaf, how):
    for _ in range(depth):
        leaf = {"object": {"type": "object", "properties": {"k": leaf}, "required": ["k"]}, "items": {"type": "array", "minItems": 1, "items": leaf}, "anyOf": {"anyOf": [leaf]}}[how]
    return leaf


def test_schemas_are_walked_to_their_depth(spark):
    rows = []
    for how in ("object", "items", "anyOf"):
        for depth in range(8):
            schema = {"type": "object", "properties": {"p": nest(depth, {"type": "string", "format": "uri"}, how)}, "required": ["p"]}
            rows.append((how, depth, json.dumps(schema, sort_keys=True)))
    df = spark.createDataFrame(rows, "how string, depth int, s string")
    got = df.select("how", "depth", exercise.schema_capabilities(F.col("s")).alias("c"), exercise.arguments(F.col("s")).alias("a")).collect()
    for r in got:
        assert (("network" in {c.capability for c in r.c}) == (r.depth <= exercise.SCHEMA_DEPTH - 1)), r
        if r.how == "anyOf":
            assert r.a.problem is None
        elif r.depth <= exercise.ARGUMENT_DEPTH:
            value = json.loads(r.a.arguments)["p"]
            for _ in range(r.depth):
                value = value["k"] if r.how == "object" else value[0]
            assert value == "https://driftloom-synthetic.invalid/driftloom-probe"
        else:
            assert r.a.arguments is None and "nests deeper than 4" in r.a.problem


def test_values_of_arguments(spark):
    props = {
        "a": {"enum": ["x", 1]}, "b": {"const": None}, "c": {"default": 2.5}, "d": {"default": [1]}, "e": {"type": ["null", "integer"], "minimum": 7}, "f": {"type": "number"},
        "g": {"type": "boolean"}, "h": {"type": "array"}, "i": {"type": "object"}, "j": True, "k": {"type": "null"}, "l": {"enum": []}, 'q"': {"const": 'é"'},
    }
    schema = json.dumps({"properties": props, "required": [*props, "gone", 3, "a"]}, sort_keys=True)
    got = json.loads(spark.createDataFrame([(schema,)], "s string").select(exercise.arguments(F.col("s"))["arguments"]).first()[0])
    text = "driftloom-probe-value"
    assert got == {"a": "x", "b": None, "c": 2.5, "d": text, "e": 7, "f": 1.0, "g": False, "h": [], "i": {}, "j": text, "k": None, "l": text, 'q"': 'é"', "gone": text}
