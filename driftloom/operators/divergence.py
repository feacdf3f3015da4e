"""Declared against observed capabilities: traces, call windows, profiles, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftloom.functions.typed import string_at, typed_at
from driftloom.operators.stats import wilson

# Capability patterns of declared texts, in output order.
DECLARED = {
    "network": (
        r"(?U)\b(http|https|url|uri|endpoint|api|apis|web|website|internet|online|fetch|download|upload|request|requests|query|"
        r"queries|search|searches|remote|server|webhook|callback|rest|graphql|scrape|crawl|proxy|dns|host|domain)\b"
    ),
    "filesystem_read": (
        r"(?U)\b(file|files|filesystem|directory|directories|folder|folders|path|paths|read|reads|load|loads|open|opens|parse|"
        r"parses|import|imports|scan|scans|disk|local)\b"
    ),
    "filesystem_write": (
        r"(?U)\b(write|writes|save|saves|store|stores|persist|persists|create|creates|export|exports|output|outputs|generate|"
        r"generates|delete|deletes|remove|removes|modify|modifies|update|updates)\b"
    ),
    "subprocess": (
        r"(?U)\b(command|commands|shell|bash|sh|exec|execute|executes|run|runs|spawn|spawns|process|processes|subprocess|cli|"
        r"binary|script|scripts|invoke|invokes|compile|compiles|build|builds|install|installs)\b"
    ),
    "credential_access": (
        r"(?U)\b(credential|credentials|token|tokens|api[_ -]?key|apikey|secret|secrets|password|passwords|auth|authenticate|"
        r"authentication|authorization|oauth|login|signin|bearer|session)\b"
    ),
}
# The same of parameter names, and of formats of parameters.
PARAMETERS = {
    "network": r"(url|uri|endpoint|host|hostname|domain|webhook|callback|address|link|server|proxy|port|api_base|base_url)",
    "filesystem_read": r"(path|file|filename|filepath|dir|directory|folder|source|input_file|location|document)",
    "filesystem_write": r"(output|output_path|destination|dest|target|save_to|write_to|out_file)",
    "subprocess": r"(command|cmd|shell|exec|script|args|argv|program|binary|executable)",
    "credential_access": r"(token|api_?key|apikey|secret|password|passwd|credential|auth|bearer|access_token|client_secret)",
}
NETWORK_FORMATS = ["uri", "url", "iri", "hostname", "idn-hostname", "ipv4", "ipv6"]
# Reads that tell nothing (a runtime that loads itself, name lookup and trust stores), and paths of secrets.
NOISE = (
    r"^(/usr/|/lib/|/lib64/|/proc/|/sys/|/dev/|/etc/ld\.so|/etc/localtime|/etc/nsswitch\.conf|/etc/host\.conf|/etc/gai\.conf|/srv/server/node_modules/"
    r"|/srv/server/venv/|/srv/probe/|/home/prober/\.npm/|/home/prober/\.cache/|/etc/ssl/|/etc/pki/|/etc/ca-certificates|/usr/share/ca-)"
    r"|^/etc/(hosts|resolv\.conf|services|protocols|networks|hostname)\z"
)
SECRETS = (
    r"(/\.aws/|/\.ssh/|/\.netrc|/\.npmrc|/\.docker/config|/\.git-credentials|/\.config/gcloud|/\.kube/config|/\.gnupg/|/\.pypirc|(^|/)\.env(\.|$)"
    r"|/proc/self/environ|/proc/\d+/environ|id_rsa|id_ed25519|credentials\.json|service[_-]account.*\.json)"
)


def declared(text: Column, patterns: dict[str, str] = DECLARED) -> Column:
    """array<struct<capability, evidence>>: the first match of each pattern in lower case."""
    low = F.lower(F.coalesce(text, F.lit("")))
    hits = [F.when(low.rlike(p), F.struct(F.lit(c).alias("capability"), F.regexp_extract(low, p, 0).alias("evidence"))) for c, p in patterns.items()]
    return F.array_compact(F.array(*hits))


def declared_parameter(name: Column, schema: Column) -> Column:
    """array<struct<capability, evidence>> of one parameter: its name, its format, its description.

    ``schema`` is the parameter's JSON; schemas inside it are not walked.
    """
    low, form = F.lower(name), F.lower(F.get_json_object(schema, "$.format"))
    hit = lambda c: F.struct(F.lit(c).alias("capability"), name.alias("evidence"))
    named = [F.when(low.rlike(p), hit(c)) for c, p in PARAMETERS.items()]
    named.append(F.when(form.isin(*NETWORK_FORMATS), hit("network")))
    return F.concat(F.array_compact(F.array(*named)), declared(string_at(schema, "$.description")))


def declared_tool(tool: Column) -> Column:
    """array<struct<capability, evidence>> of a tool's JSON: name, description, parameters, readOnlyHint."""
    get = lambda path: F.get_json_object(tool, path)
    text = F.concat_ws(" ", F.regexp_replace(get("$.name"), "[_-]", " "), get("$.description"))
    props = F.from_json(F.coalesce(get("$.inputSchema.properties"), get("$.input_schema.properties")), "map<string,string>")
    params = F.flatten(F.transform(F.map_entries(props), lambda e: declared_parameter(e["key"], e["value"])))
    writes = F.when(typed_at(tool, "$.annotations.readOnlyHint") == "false", F.struct(F.lit("filesystem_write").alias("capability"), F.lit("annotations.readOnlyHint is false").alias("evidence")))
    none = F.array().cast("array<struct<capability:string,evidence:string>>")
    return F.concat(declared(text), F.coalesce(params, none), F.array_compact(F.array(writes)))


def observed_all(call: Column, args: Column) -> Column:
    """Array of the capabilities of one traced call: a secret that is opened is also read or written."""
    path = F.when(args.rlike(r'"((?:[^"\\]|\\.)*)"'), F.regexp_extract(args, r'"((?:[^"\\]|\\.)*)"', 1))
    opened = call.isin("open", "openat", "openat2", "creat") & path.isNotNull()
    written = args.rlike("O_(WRONLY|RDWR|CREAT|TRUNC|APPEND)")
    tests = [
        (call.isin("connect", "sendto", "sendmsg") & F.regexp_extract(args, "sa_family=(AF_[A-Z0-9]+)", 1).isin("AF_INET", "AF_INET6"), "network"),
        (call.isin("execve", "execveat"), "subprocess"),
        (opened & path.rlike(SECRETS), "credential_access"),
        (opened & written | call.isin("unlink", "unlinkat", "rename", "renameat", "renameat2", "mkdir"), "filesystem_write"),
        (opened & ~written & ~path.rlike(NOISE), "filesystem_read"),
    ]
    return F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(c)) for t, c in tests]))


def observed(call: Column, args: Column) -> Column:
    """First capability of one traced call in the order of ``observed_all``; null where it tells nothing."""
    return F.get(observed_all(call, args), 0)


def counts_in_windows(windows: DataFrame, events: DataFrame, session: str, call: str, part: str = "day") -> DataFrame:
    """(call, n): events (session, at) inside each closed window (session, call, start, end); windows without one are left out.

    No pairs are made: events, starts and ends of a session are one sequence, and a window's count
    is the running count at its end less that before its start. A ``part`` of the time of a session
    is one sequence; parts before it come as their totals.
    """
    none = F.lit(None)
    rows = events.select(session, F.col("at"), F.lit(1).alias("turn"), none.cast(windows.schema[call].dataType).alias(call))
    for col, turn in (("start", 0), ("end", 2)):
        rows = rows.unionByName(windows.select(session, F.col(col).alias("at"), F.lit(turn).alias("turn"), call))
    rows = rows.withColumn("part", F.date_trunc(part, F.col("at").cast("timestamp")))
    own = F.when(F.col("turn") == 1, 1).otherwise(0)
    running = F.sum(own).over(Window.partitionBy(session, "part").orderBy("at", "turn").rowsBetween(Window.unboundedPreceding, 0))
    totals = rows.groupBy(session, "part").agg(F.sum(own).alias("own"))
    earlier = Window.partitionBy(session).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(session, "part", F.coalesce(F.sum("own").over(earlier), F.lit(0)).alias("before"))
    marks = rows.withColumn("n", running).join(before, [session, "part"]).filter("turn <> 1")
    sign = F.when(F.col("turn") == 2, 1).otherwise(-1)
    return marks.groupBy(call).agg(F.sum(sign * (F.col("n") + F.col("before"))).alias("n")).filter("n > 0")


def call_windows(calls: DataFrame, settle: float = 0.75) -> DataFrame:
    """Closed windows (.., start, end) of calls (.., start, end as seconds): the end comes ``settle`` seconds later.

    A failed call without an end has a window of the settle time.
    """
    return calls.withColumn("end", F.coalesce("end", "start") + F.lit(settle))


def in_windows(events: DataFrame, windows: DataFrame, session: str, width: float | None = None) -> DataFrame:
    """Events (session, at) inside the closed windows (start, end, ..) of their session, in each that they are in.

    Times are seconds or timestamps. The time of a session is cut into buckets of ``width`` seconds (by
    default twice the mean length of a window), a window stands in every bucket that it touches and an
    event in one, so rows meet by (session, bucket): a session with a third of all events is spread over
    its buckets, and pairs are made only of what is near in time.
    """
    seconds = lambda df, c: F.unix_micros(c) / 1e6 if df.schema[c].dataType.typeName() == "timestamp" else F.col(c).cast("double")
    for c in ("start", "end"):
        if windows.schema[c].dataType.typeName() == "timestamp_ntz":
            windows = windows.withColumn(c, F.col(c).cast("timestamp"))
    if events.schema["at"].dataType.typeName() == "timestamp_ntz":
        events = events.withColumn("at", F.col("at").cast("timestamp"))
    if width is None:
        mean = windows.agg(F.avg(seconds(windows, "end") - seconds(windows, "start"))).first()[0]
        width = max(2 * (mean or 0), 1e-3)
    bucket = lambda x: F.floor(x / F.lit(float(width)))
    spread = windows.filter(F.col("start") <= F.col("end")).withColumn("bucket", F.explode(F.sequence(bucket(seconds(windows, "start")), bucket(seconds(windows, "end")))))
    met = spread.join(events.withColumn("bucket", bucket(seconds(events, "at"))), [session, "bucket"])
    return met.filter((F.col("at") >= F.col("start")) & (F.col("at") <= F.col("end"))).drop("bucket")


def undeclared(seen: DataFrame, said: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, capability, evidence): observed but not declared, with the least three pieces of evidence.

    Distinct texts are ranked in parts before they are ranked as a whole, so no row or task gathers them all.
    """
    rest = seen.join(said.select(*keys, "capability").distinct(), [*keys, "capability"], "left_anti")
    distinct = rest.select(*keys, "capability", "evidence").distinct().withColumn("part", F.pmod(F.xxhash64("evidence"), F.lit(64)))
    for by in (["part"], []):
        order = Window.partitionBy(*keys, "capability", *by).orderBy(F.asc_nulls_last("evidence"))
        distinct = distinct.withColumn("n", F.row_number().over(order)).filter("n <= 3")
    return distinct.groupBy(*keys, "capability").agg(F.array_sort(F.collect_list("evidence")).alias("evidence"))


def report(exercised: DataFrame, seen: DataFrame, said: DataFrame, classes: Column, keys: list[str]) -> DataFrame:
    """(class, tools, exercised, rate, low, high): distinct tools that diverge, as a whole (class ``all``) and by class.

    ``exercised`` has the tools (``keys``) that gave a result, ``seen`` and ``said`` their capabilities;
    ``classes`` is the class of the column ``capability``. Rates have Wilson bounds; without exercised
    tools they are 0.
    """
    found = undeclared(seen, said, keys).join(exercised.select(*keys).distinct(), keys, "left_semi").select(*keys, classes.alias("class"))
    each = found.select(*keys, F.explode(F.array(F.lit("all"), F.col("class"))).alias("class")).distinct()
    tools = each.groupBy("class").agg(F.count("*").alias("tools"))
    whole = exercised.select(*keys).distinct().agg(F.count("*").alias("exercised"))
    base = whole.select(F.lit("all").alias("class"), "exercised")
    rows = base.join(tools, "class", "full_outer").drop("exercised").join(F.broadcast(whole)).withColumn("tools", F.coalesce("tools", F.lit(0)).cast("long"))  # one row
    low, high = wilson(F.col("tools"), F.col("exercised"))
    rate = F.when(F.col("exercised") > 0, F.col("tools") / F.col("exercised")).otherwise(0.0)
    return rows.select("class", "tools", "exercised", rate.alias("rate"), low.alias("low"), high.alias("high"))
