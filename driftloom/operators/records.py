"""Rows that are appended and read back: runs, failures, ingest in groups, withdrawals, launches, health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftloom.functions.fixed import AUTH_CODES, AUTH_HINTS, AUTH_STATUSES, CAPABILITY_CLASSES, CREDENTIAL_HINTS, DEPENDENCY_HINTS, LAUNCH_STATUS
from driftloom.functions.typed import typed_at


def to_iso(at: Column) -> Column:
    """A UTC stamp as text with microseconds and ``+00:00``."""
    return F.date_format(at.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def from_iso(text: Column) -> Column:
    """The time of a text in ISO 8601 with its offset from UTC; null for all else, a time without offset too."""
    told = F.trim(text).rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9:.]+(Z|[+-][0-9]{2}:?[0-9]{2})$")
    return F.when(told, F.try_to_timestamp(F.trim(text)))


def is_digest(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^[0-9a-f]{64}\z"), F.lit(False))


def run_view(started: DataFrame, finished: DataFrame) -> DataFrame:
    """(run_id, started_at, finished_at, open): a run without a finish row stays open."""
    both = started.select("run_id", "started_at", F.lit(None).cast("timestamp_ntz").alias("finished_at")).unionByName(
        finished.select("run_id", F.lit(None).cast("timestamp_ntz").alias("started_at"), "finished_at")
    )
    seen = both.groupBy("run_id").agg(F.min("started_at").alias("started_at"), F.max("finished_at").alias("finished_at"))
    return seen.withColumn("open", F.col("finished_at").isNull())


def failures(rows: DataFrame, status: str) -> DataFrame:
    """Rows that may be recorded as failures: any status but ``ok``."""
    return rows.filter(F.col(status).isNotNull() & (F.col(status) != "ok"))


def steps_of(rows: DataFrame, status: str, error_class: str) -> DataFrame:
    """Rows of a chain with ``absent``: what was ok, and the marks ``absent`` and ``withdrawn``.

    Any other failure is passed over; it says nothing about what was there.
    """
    gone = F.coalesce(F.col(error_class).isin("absent", "withdrawn"), F.lit(False)) & (F.col(status) != "ok")
    return rows.filter((F.col(status) == "ok") | gone).withColumn("absent", gone)


def representatives(rows: DataFrame, key: str, stamp: str, seq: str, latest: str, columns: list[str]) -> DataFrame:
    """The row of each key that stands for it: one marked latest, else the last; rows without a stamp come last."""
    order = F.struct(F.coalesce(F.col(latest), F.lit(False)).alias("l"), F.col(stamp).isNull().alias("u"), F.col(stamp).alias("s"), F.col(seq).alias("q"))
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("_r"), F.count("*").alias("versions")).select(key, "_r.*", "versions")


def current_only(rows: DataFrame, latest: str) -> DataFrame:
    """Rows but those that say they are not the latest; a missing mark is kept."""
    return rows.filter(F.coalesce(F.col(latest), F.lit(True)))


def withdrawals(held: DataFrame, rows: DataFrame, key: str, status: str, stamp: str) -> DataFrame:
    """New dated marks of deleted entries (key, stamp); deprecated ones are not withdrawn."""
    marks = rows.filter(F.col(status) == "deleted").select(key, stamp).distinct().alias("m")
    same = (F.col(f"m.{key}") == F.col(f"h.{key}")) & F.col(f"m.{stamp}").eqNullSafe(F.col(f"h.{stamp}"))
    return marks.join(held.select(key, stamp).alias("h"), same, "left_anti")


def upserted(rows: DataFrame, keys: list[str], folded: list[str], seq: str, columns: list[str]) -> DataFrame:
    """The last row of each key, of which null parts equal empty ones."""
    null_as_empty = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in folded]
    return rows.groupBy(*keys, *null_as_empty).agg(F.max_by(F.struct(*columns), F.col(seq)).alias("_r")).select(*keys, *folded, "_r.*")


def inserted(held: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not held yet, each key once: a sample that is fixed is not drawn again."""
    return rows.join(held.select(*keys), keys, "left_anti").dropDuplicates(keys)


def wants_credentials(http_status: Column, code: Column, message: Column) -> Column:
    low = F.lower(F.coalesce(message, F.lit("")))
    said = F.exists(F.array(*map(F.lit, AUTH_HINTS)), lambda h: F.contains(low, h))
    return F.coalesce(http_status.isin(*AUTH_STATUSES), F.lit(False)) | F.coalesce(code.isin(*AUTH_CODES), F.lit(False)) | said


def launch_failure(kind: Column, detail: Column, declared: Column) -> Column:
    """struct(class, undeclared): a crash told more precisely by what it says, dependencies first."""
    low = F.lower(F.coalesce(detail, F.lit("")))
    says = lambda hints: F.exists(F.array(*map(F.lit, hints)), lambda h: F.contains(low, h))
    crashed = kind == "crashed"
    secret = crashed & ~says(DEPENDENCY_HINTS) & says(CREDENTIAL_HINTS)
    name = F.when(crashed & says(DEPENDENCY_HINTS), "dependency_broken").when(secret, "requires_credentials").otherwise(kind)
    return F.struct(name.alias("class"), (secret & ~F.coalesce(declared, F.lit(False))).alias("undeclared"))


def launch_status(name: Column) -> Column:
    """Status of an observation for the class of a failure; of an unknown class, a protocol error."""
    pairs = [F.lit(x) for kv in LAUNCH_STATUS.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), name), F.lit("protocol_error"))


def divergence_class(capability: Column) -> Column:
    pairs = [F.lit(x) for kv in CAPABILITY_CLASSES.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), capability)


def version_bucket(n: Column) -> Column:
    return F.when(n <= 1, "1").when(n <= 4, "2-4").otherwise("5+")


def namespace(key: Column) -> Column:
    return F.substring_index(key, "/", 1)


def candidates(listings: DataFrame, key: str, document: str, versions: str) -> DataFrame:
    """(key, registry_type, identifier, stratum) of listings that can be launched locally.

    No remotes, and a package of npm or pypi over standard input with an identifier; the first one.
    """
    get = F.get_json_object
    packages = F.coalesce(F.from_json(get(document, "$.server.packages"), "array<string>"), F.array().cast("array<string>"))
    fits = lambda p: get(p, "$.registryType").isin("npm", "pypi") & (get(p, "$.transport.type") == "stdio") & (F.coalesce(get(p, "$.identifier"), F.lit("")) != "")
    first = F.get(F.filter(packages, lambda p: F.coalesce(fits(p), F.lit(False))), 0)
    remotes = F.coalesce(F.from_json(get(document, "$.server.remotes"), "array<string>"), F.array().cast("array<string>"))
    some = listings.withColumn("_p", first).filter(F.col("_p").isNotNull() & (F.size(remotes) == 0))
    secret = F.exists(F.coalesce(F.from_json(get("_p", "$.environmentVariables"), "array<string>"), F.array().cast("array<string>")), lambda v: F.coalesce(typed_at(v, "$.isSecret") == "true", F.lit(False)))
    stratum = F.concat_ws("/", get("_p", "$.registryType"), version_bucket(F.col(versions)), F.when(secret, "secret").otherwise("nosecret"))
    return some.select(key, get("_p", "$.registryType").alias("registry_type"), get("_p", "$.identifier").alias("identifier"), stratum.alias("stratum"))


def changed_fields(before: dict[str, Column], after: dict[str, Column]) -> Column:
    """Names of fields that differ, in the order given; null equals null."""
    return F.array_compact(F.array(*[F.when(~before[n].eqNullSafe(after[n]), F.lit(n)) for n in before]))


def field_frequency(transitions: DataFrame, fields: str) -> DataFrame:
    """(field, n, share) of transitions in which each field changed."""
    total = transitions.agg(F.count("*").alias("total"))
    n = transitions.select(F.explode(fields).alias("field")).groupBy("field").agg(F.count("*").alias("n"))
    return n.join(F.broadcast(total)).select("field", "n", (F.col("n") / F.col("total")).alias("share"))  # one row


def died_runs(runs: DataFrame, now: Column) -> DataFrame:
    """Runs that began from 7 days to 12 hours ago and never finished."""
    return runs.filter((F.col("started_at") >= now - F.expr("interval 7 days")) & (F.col("started_at") < now - F.expr("interval 12 hours")) & F.col("finished_at").isNull())


def coverage_ratio(runs: DataFrame, size: str) -> DataFrame:
    """One row: size of the newest full run over the one before; null without two."""
    w = Window.orderBy(F.desc("started_at"))
    last = runs.orderBy(F.desc("started_at")).limit(2).withColumn("_k", F.row_number().over(w))
    at = lambda k: F.max(F.when(F.col("_k") == k, F.col(size)))
    return last.agg((at(1) / F.nullif(at(2), F.lit(0))).alias("ratio"))


def health_report(checks: DataFrame) -> DataFrame:
    """One row: ``ok`` is whether all checks are, ``failed`` names those that are not."""
    return checks.agg(F.bool_and("ok").alias("ok"), F.array_join(F.array_sort(F.collect_list(F.when(~F.col("ok"), F.col("name")))), ",").alias("failed"))


def after_key(rows: DataFrame, key: str, last: DataFrame) -> DataFrame:
    """Rows whose key is above the last one that was done (one row ``last``; null: none was)."""
    return rows.join(F.broadcast(last)).filter(F.col("last").isNull() | (F.col(key) > F.col("last"))).drop("last")


def gate(expected: DataFrame, seen: DataFrame) -> DataFrame:
    """Rows that are missing or spurious, each as often as it is; none means that both sides agree."""
    return expected.exceptAll(seen).withColumn("fault", F.lit("missing")).unionByName(seen.exceptAll(expected).withColumn("fault", F.lit("spurious")))


def augmented(rules: Column, model: Column) -> Column:
    """Capabilities of the rules, and those that a model adds; no model, or none of its, takes any away."""
    return F.array_union(rules, F.coalesce(model, F.array().cast("array<string>")))


def resolved(items: DataFrame, labels: DataFrame, item: str, layer: str, fallback: str) -> DataFrame:
    """Items with the rows of the layer they were drawn from; an item without a layer takes the fallback."""
    own = items.withColumn(layer, F.coalesce(F.col(layer), F.lit(fallback)))
    return own.join(labels, [item, layer])


def response_of(body: Column, wanted: Column) -> Column:
    """The message that answers request ``wanted`` in a body of one message or a list of them.

    Without one of that id a lone reply (a result or an error) stands for it; else null.
    """
    listed = F.coalesce(F.from_json(F.when(F.ltrim(body).startswith("["), body), "array<string>"), F.when(F.ltrim(body).startswith("{"), F.array(body)))
    get = lambda m, n: F.get_json_object(m, f"$.{n}")
    replies = F.filter(listed, lambda m: get(m, "result").isNotNull() | get(m, "error").isNotNull())
    own = F.filter(replies, lambda m: get(m, "id") == wanted.cast("string"))
    return F.coalesce(F.get(own, 0), F.when(F.size(replies) == 1, F.get(replies, 0)))


def trimmed(values: Column, longest: int = 1500, most: int = 40) -> Column:
    """The first ``most`` texts for a prompt, each cut after ``longest`` characters with a mark."""
    return F.transform(F.slice(values, 1, most), lambda v: F.when(F.length(v) > longest, F.concat(F.substring(v, 1, longest), F.lit("..."))).otherwise(v))


def json_lines(rows: DataFrame) -> DataFrame:
    """(value): each row as a line of JSON with its names sorted and its nulls kept."""
    return rows.select(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}).alias("value"))


def write_lines(rows: DataFrame, path: str) -> None:
    json_lines(rows).write.mode("overwrite").text(path)


def probe_failure(kind: Column, name: Column, detail: Column) -> Column:
    """struct(status, class, detail) of a failed probe: ``kind`` tells where it failed, ``name`` is the error's own.

    A failure to connect whose text speaks of certificates is one of TLS. Details keep 500 characters.
    """
    secure = (kind == "connect") & F.coalesce(F.lower(detail).rlike("ssl|certificate|tls"), F.lit(False))
    status = F.when(kind == "auth_required", "auth_required").when(kind == "timeout", "timeout").when(kind.isin("tls", "connect", "transport"), "unreachable").otherwise("protocol_error")
    told = (
        F.when(kind == "auth_required", "auth_required").when(kind == "protocol", "mcp_protocol_error").when((kind == "tls") | secure, "tls_error")
        .when(kind == "connect", "connect_error").when(kind == "too_many_redirects", "too_many_redirects").otherwise(name)
    )
    return F.struct(status.alias("status"), told.alias("class"), F.substring(detail, 1, 500).alias("detail"))


def run_totals(runs: DataFrame, by: str, stats: str, counters: list[str]) -> DataFrame:
    """(by, runs, counters): sums of counters that stand in a run's JSON; those that are not there, or no numbers, count 0."""
    value = lambda c: F.coalesce(F.get_json_object(stats, f"$.{c}").try_cast("long"), F.lit(0).cast("long"))
    return runs.groupBy(by).agg(F.count("*").alias("runs"), *[F.sum(value(c)).alias(c) for c in counters])


def latest_stats(runs: DataFrame, by: str, started: str, finished: str, stats: str, values: dict[str, str]) -> DataFrame:
    """(by, values): members of the JSON of the newest finished run of each ``by``, as Spark types by name.

    A run whose JSON is no object has no values; without a finished run there is no row. Of runs
    that began at once the one with the greatest text stands.
    """
    done = runs.filter(F.col(finished).isNotNull()).groupBy(by).agg(F.max_by(stats, F.struct(F.col(started), F.col(stats))).alias("_s"))
    own = F.when(F.col("_s").rlike(r"^\s*\{"), F.col("_s"))
    return done.select(by, *[F.get_json_object(own, f"$.{name}").try_cast(kind).alias(name) for name, kind in values.items()])


#: Hours after which a backup is no longer fresh.
BACKUP_HOURS = 36


def backup_checks(backups: DataFrame, now: Column) -> DataFrame:
    """(name, ok) of three checks over all backups (created_at as text, verified): present, freshness, verified.

    The newest backup counts; one without a time that can be read is older than all others. A backup that was
    not verified, and none at all, is no healthy one.
    """
    at = from_iso(F.col("created_at"))
    last = backups.agg(F.count("*").alias("n"), F.max_by("verified", F.struct(at, F.col("verified"))).alias("verified"), F.max(at).alias("at"))
    fresh = F.unix_micros(now) - F.unix_micros("at") <= BACKUP_HOURS * 3_600_000_000
    told = {"backup.present": F.col("n") > 0, "backup.freshness": fresh, "backup.verified": F.col("verified")}
    return last.select(F.inline(F.array(*[F.struct(F.lit(n).alias("name"), F.coalesce(ok, F.lit(False)).alias("ok")) for n, ok in told.items()])))


def launch_observation(failure: Column, failure_detail: Column, first_hash: Column, second_hash: Column, destinations: Column) -> Column:
    """struct(status, error_class, error_detail) of a server that was launched twice.

    A failure stands as it is. Two launches whose documents differ are nondeterministic. What was reached
    (``destinations``, an array of texts, each once and sorted) is told in the detail, and is
    the class where there is no other.
    """
    failed, differs = failure.isNotNull(), ~first_hash.eqNullSafe(second_hash)
    reached = F.array_sort(F.array_distinct(F.array_compact(destinations)))
    some = F.coalesce(F.size(destinations) > 0, F.lit(False))
    status = F.when(failed, launch_status(failure)).when(differs, "nondeterministic").otherwise("ok")
    name = F.when(failed, failure).when(differs, "hash_disagreement").when(some, "attempted_egress")
    listed = F.concat(F.lit("attempted egress to ['"), F.array_join(reached, "', '"), F.lit("']"))
    other = F.when(differs, "the two launches produced different normalized manifests")
    detail = F.when(failed, failure_detail).otherwise(F.when(some, F.concat_ws(" ", other, listed)).otherwise(other))
    return F.struct(status.alias("status"), name.alias("error_class"), detail.alias("error_detail"))
