"""Changes between listing documents."""

import json

from pyspark.sql import functions as F

from driftloom.operators import listings as L


def doc(**server):
    status = server.pop("status", "active")
    return json.dumps({"server": {"name": "a/b", **server}, "_meta": {"io.modelcontextprotocol.registry/official": {"status": status}}})


BASE = dict(description="one", version="1", repository={"url": "https://r/x"}, remotes=[{"type": "sse", "url": "https://e/1", "headers": [{"name": "K", "isSecret": True}]}], packages=[{"registryType": "npm", "identifier": "p", "version": "1"}])


def test_kinds(spark):
    cases = [
        ({"description": "two", "version": "2"}, ["server_description_changed", "version_bumped"]),
        ({"repository": "https://r/y"}, ["repository_changed"]),
        ({"repository": "https://r/x "}, []),
        ({"remotes": [{"type": "sse", "url": "https://e/2"}]}, ["endpoint_changed", "auth_requirement_changed"]),
        ({"packages": [{"registryType": "npm", "identifier": "p", "version": "2"}]}, ["package_changed"]),
        ({"packages": [{"registryType": "pypi", "name": "q"}]}, ["package_identity_changed"]),
        ({"status": "deleted", "title": "T"}, ["registry_status_changed", "server_field_changed:title"]),
        ({}, []),
    ]
    rows = [(k, doc(**BASE), doc(**{**BASE, **change})) for k, (change, _) in enumerate(cases)]
    got = {r.k: r.kinds for r in L.listing_changes(spark.createDataFrame(rows, "k int, b string, a string"), "b", "a").collect()}
    assert [got[k] for k in range(len(cases))] == [want for _, want in cases]


def test_accessors_and_replacement(spark):
    remotes = [{"type": "sse", "url": "u1"}, {"type": "streamable-http", "url": "u2"}, {"type": "x", "url": " "}]
    df = spark.createDataFrame([(doc(remotes=remotes), doc(**BASE))], "d string, e string")
    r = df.select(L.primary_endpoint(F.col("d")), L.endpoints(F.col("d")), L.secret_inputs(F.col("e")), L.replaced(F.col("e"), F.col("d")), L.replaced(F.col("e"), F.col("e"))).first()
    assert tuple(r) == ("u2", ["u1", "u2"], ["header:K"], True, False)
