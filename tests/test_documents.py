"""Typed changes between two manifests."""

import json

from driftloom.operators import documents as D


def tool(name, text, **params):
    props = {k: v for k, (v, _) in params.items()}
    return {"name": name, "description": text, "inputSchema": {"properties": props, "required": [k for k, (_, r) in params.items() if r]}}


def test_manifest_changes(spark):
    s, n = {"type": "string"}, {"type": "number"}
    before = {"tools": [tool("a", "first", p=(s, True), q=(s, False)), tool("b", "reads a file from the disk", x=(s, True)), tool("c", "gone now")]}
    after = {"tools": [tool("a", "changed", p=(n, False), r=(s, True)), tool("b2", "reads a file from the disk", x=(s, True)), tool("a2", "something new entirely", z=(s, False))]}
    df = lambda d: spark.createDataFrame([(1, json.dumps(d))], "t int, doc string")
    b, a = D.members(df(before), ["t"], "doc", "tools", "name"), D.members(df(after), ["t"], "doc", "tools", "name")
    assert {(r.tool, r.kind) for r in D.tool_changes(b, a, ["t"]).collect()} == {
        ("a", "tool_description_changed"), ("b", "tool_removed"), ("b2", "tool_added"), ("c", "tool_removed"), ("a2", "tool_added")}
    got = {(r.name, r.kind) for r in D.parameter_changes(D.parameters(b, ["t"]), D.parameters(a, ["t"]), ["t"]).collect()}
    assert got == {("p", "param_type_changed"), ("p", "param_became_optional"), ("q", "schema_param_removed"), ("r", "schema_param_added"), ("r", "param_became_required")}
    assert [(r.old, r.new) for r in D.renames(b, a, "t").collect()] == [("b", "b2")]


def test_prompt_and_resource_changes(spark):
    before = {"prompts": [{"name": "a", "description": "same", "arguments": [1]}, {"name": "b"}], "resources": [{"uri": "u:1", "name": "x"}, {"uri": "u:2"}]}
    after = {"prompts": [{"name": "a", "description": "same", "arguments": [2]}, {"name": "c", "description": "new"}], "resources": [{"uri": "u:1", "name": "y"}]}
    df = lambda d: spark.createDataFrame([(1, json.dumps(d))], "t int, doc string")
    both = lambda path, name: [D.members(df(d), ["t"], "doc", path, name) for d in (before, after)]
    assert {(r.name, r.before, r.after, r.kind) for r in D.prompt_changes(*both("prompts", "name"), ["t"]).collect()} == {
        ("a", "same", "same", "prompt_changed"), ("b", None, None, "prompt_removed"), ("c", None, "new", "prompt_added")}
    assert {(r.name, r.kind) for r in D.resource_changes(*both("resources", "uri"), ["t"]).collect()} == {("u:2", "resource_removed")}
