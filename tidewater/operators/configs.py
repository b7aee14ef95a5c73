"""Configuration tables: control-document expansion, validation, port and
receiver joins, change detection and poll back-off (JON-*, VAL-04/05,
SET-01, WIN-05/06/08, AGG-07/16/18).

Configuration data is small (one row per configured dataset), but every
operator is still a DataFrame join / aggregate / window, so it runs next to
the data it steers and broadcasts only behind a size check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ident
from ..plans.prefix import last_non_null, previous_value, running_sums

# Default listen host, input types that need a port, poll
# statuses that count as auth failures, back-off cap (minutes), failures
# that open the circuit, and the batch size assumed when none is set.
DEFAULT_HOST = "0.0.0.0"
DATAGRAM_TYPES = ("udp", "syslog", "netflow", "sflow", "ipfix", "ebpf")
AUTH_FAILURES = (401, 403, 404)
MAX_BACKOFF_MIN = 30
CIRCUIT_OPEN_AFTER = 5
DEFAULT_BATCH_BYTES = 1_048_576


def expand_control_doc(doc: DataFrame, bearer_token: str = "") -> DataFrame:
    """JON-01: tenants x datasets -> one input config per active dataset
    with a source type. ``config`` = base keys overlaid by the dataset's
    custom map (custom wins), ``host`` defaulted. The name joins the display
    names of dataset and tenant. Tenant ``active`` is not consulted (only the
    dataset's)."""
    t = doc.select(F.col("tenant_id"), F.col("tenant_name"), F.explode("datasets").alias("d"))
    d = t.where(F.col("d.active") & (F.coalesce(F.col("d.config.source.type"), F.lit("")) != ""))
    base = F.create_map(F.lit("tenant_id"), F.col("tenant_id"), F.lit("dataset_id"), F.col("d.dataset_id"),
                        F.lit("bearer_token"), F.lit(bearer_token))
    custom = F.coalesce(F.col("d.config.source.custom"), F.create_map().cast("map<string,string>"))
    merged = F.map_concat(base, custom)
    with_host = F.when(F.map_contains_key(merged, "host"), merged) \
        .otherwise(F.map_concat(merged, F.create_map(F.lit("host"), F.lit(DEFAULT_HOST))))
    return d.select(
        F.col("d.config.source.type").alias("type"),
        F.concat_ws("-", F.coalesce("d.name", F.lit("")), F.coalesce("tenant_name", F.lit(""))).alias("name"),
        F.col("tenant_id").alias("doc_tenant"),
        F.col("d.pos").alias("pos"),
        with_host.alias("config"),
    )


def apply_globals(configs: DataFrame, tenant_id: str = "", bearer_token: str = "") -> DataFrame:
    """JON-02: add the global tenant / token only where the key is absent."""
    c = F.col("config")
    if tenant_id:
        c = F.when(F.map_contains_key(c, "tenant_id"), c).otherwise(
            F.map_concat(c, F.create_map(F.lit("tenant_id"), F.lit(tenant_id))))
    if bearer_token:
        c = F.when(F.map_contains_key(c, "bearer_token"), c).otherwise(
            F.map_concat(c, F.create_map(F.lit("bearer_token"), F.lit(bearer_token))))
    return configs.withColumn("config", c)


def port_of(config: Column) -> Column:
    """Numeric coercion of the ``port`` entry (NULL when not a number)."""
    return F.element_at(config, F.lit("port")).try_cast("int")


def last_by_port(ports: DataFrame, *columns: str) -> DataFrame:
    """One row per port: of several rows (in order of ``pos``) the last."""
    last = ports.groupBy("port").agg(F.max_by(F.struct(*columns), F.struct("pos", *columns)).alias("_last"))
    return last.select("port", *[F.col(f"_last.{c}") for c in columns])


def config_ports(configs: DataFrame) -> DataFrame:
    """Port extraction: (pos, port, plugin) of every config with a positive
    port; ``plugin`` is ``type[name]``."""
    plugin = F.concat(F.col("type"), F.lit("["), F.col("name"), F.lit("]"))
    return configs.select("pos", port_of(F.col("config")).alias("port"), plugin.alias("plugin")).where("port > 0")


def port_datasets(configs: DataFrame) -> DataFrame:
    """JON-03 build side: port -> tenant and dataset id, for the ports of
    datagram inputs; the last config of a port wins."""
    d = configs.where(F.col("type").isin(*DATAGRAM_TYPES)).select(
        "pos", port_of(F.col("config")).alias("port"),
        F.element_at("config", F.lit("tenant_id")).alias("tenant_id"),
        F.element_at("config", F.lit("dataset_id")).alias("dataset_id"))
    return last_by_port(d.where("port > 0"), "tenant_id", "dataset_id")


def attribute_ports(counters: DataFrame, port_map: DataFrame) -> DataFrame:
    """JON-03: left lookup of the tenant and dataset owning each counter's
    port (``unknown`` dataset when unmapped)."""
    j = counters.join(port_map, "port", "left")
    return j.withColumn("dataset_id", F.coalesce("dataset_id", F.lit("unknown")))


def port_conflicts(local: DataFrame, remote: DataFrame) -> DataFrame:
    """JON-04: remote configs whose port a local input uses as well; the
    remote side takes precedence. Of several local inputs the last counts."""
    l = last_by_port(local.where("port > 0"), "plugin").withColumnRenamed("plugin", "local_plugin")
    r = remote.select(F.col("port"), F.col("plugin").alias("remote_plugin")).where("port > 0")
    return l.join(r, "port", "inner").select(
        "port", "local_plugin", "remote_plugin",
        F.format_string("port %d is claimed by local input %s and remote config %s; the remote one is used",
                        "port", "local_plugin", "remote_plugin").alias("message"))


def port_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """JON-05: removed / added / reassigned ports (full outer join); of
    several rows of a port the last one counts."""
    o = last_by_port(old, "plugin").withColumnRenamed("plugin", "old_plugin")
    n = last_by_port(new, "plugin").withColumnRenamed("plugin", "new_plugin")
    j = o.join(n, "port", "full_outer")
    kind = (F.when(F.col("new_plugin").isNull(), F.lit("removed"))
            .when(F.col("old_plugin").isNull(), F.lit("added"))
            .when(F.col("old_plugin") != F.col("new_plugin"), F.lit("reassigned")))
    msg = (F.when(kind == "removed", F.format_string("port %d: %s is gone", "port", "old_plugin"))
           .when(kind == "added", F.format_string("port %d: %s is new", "port", "new_plugin"))
           .when(kind == "reassigned", F.format_string("port %d: %s gave way to %s", "port", "old_plugin", "new_plugin")))
    return j.select("port", kind.alias("change"), msg.alias("message")).where(F.col("change").isNotNull())


def _fragments(s: Column) -> Column:
    """Every substring of ``s`` (the empty one included), de-duplicated.

    Quadratic in the length, which is that of a ``host:port`` address; it
    turns "contains" into an equality, so matching is an equi-join.
    """
    n = F.greatest(F.length(s), F.lit(1))
    subs = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(
        F.sequence(i, n), lambda j: F.substring(s, i, j - i + 1))))
    return F.array_union(F.array(F.lit("")), subs)


def receiver_limits(instances: DataFrame, receivers: DataFrame) -> DataFrame:
    """JON-06: effective batch byte limit per instance from receiver limits.

    The receiver URL (scheme and trailing ``/`` removed) matches the first
    receiver (by position) whose ``instance_api`` contains it or is
    contained in it, or that ends with ``:<port>`` of the URL. Unmatched
    instances use the smallest positive receiver limit. When the current
    limit (1 MiB if unset) is at least 95 % of the receiver's, it becomes
    90 % of it (float arithmetic truncated, as the original).

    The three match rules are equi-joins: "contains" is equality with one
    of the other side's substrings, the port rule is equality with the
    part after the last ``:``. No pair of rows is compared blindly.
    """
    url = F.regexp_replace(F.regexp_replace(F.col("receiver_url"), r"^https?://", ""), r"/$", "")
    p = instances.withColumn("url", url).withColumn(
        "url_port", F.when(F.instr("url", ":") > 0, F.substring_index("url", ":", -1)).otherwise(F.lit("")))
    every = receivers.select(F.col("pos").alias("r_pos"), "instance_api", "max_payload_size")
    won = F.struct("r_pos", "instance_api", "max_payload_size")
    # Of the receivers that a rule cannot tell apart the first one wins, so
    # each join meets one receiver a key.
    by_name = every.groupBy("instance_api").agg(F.min(won).alias("m"))
    in_url = p.select("instance", F.explode(_fragments(F.col("url"))).alias("frag")).join(
        by_name.withColumnRenamed("instance_api", "frag"), "frag").select("instance", "m")
    r = by_name.select("m.*")
    # A receiver has a hundred parts or more; only those that are some
    # instance's URL are grouped.
    parts = r.select(won.alias("m"), F.explode(_fragments(F.col("instance_api"))).alias("url")) \
        .join(p.select("url").distinct(), "url", "left_semi").groupBy("url").agg(F.min("m").alias("m"))
    in_api = p.select("instance", "url").join(parts, "url").select("instance", "m")
    ports = r.withColumn("url_port", F.when(F.instr("instance_api", ":") > 0, F.substring_index("instance_api", ":", -1))) \
        .groupBy("url_port").agg(F.min(won).alias("m"))
    by_port = p.where(F.col("url_port") != "").select("instance", "url_port").join(ports, "url_port").select("instance", "m")
    matched = in_url.unionByName(in_api).unionByName(by_port).groupBy("instance").agg(F.min("m").alias("m"))
    # One row: the smallest positive receiver limit (fallback for unmatched instances).
    least = every.where("max_payload_size > 0").agg(F.min("max_payload_size").alias("least")).withColumn("_k", F.lit(1))
    cur = F.when(F.col("max_bytes") <= 0, F.lit(DEFAULT_BATCH_BYTES)).otherwise(F.col("max_bytes"))
    j = p.join(matched, "instance", "left").withColumn("_k", F.lit(1)).join(F.broadcast(least), "_k")
    limit = F.coalesce(F.col("m.max_payload_size"), F.col("least").cast("long"))
    thresh = (limit.cast("double") * F.lit(0.95).cast("double")).cast("long")
    eff = (limit.cast("double") * F.lit(0.90).cast("double")).cast("long")
    new = F.when((limit > 0) & (cur >= thresh), eff).otherwise(F.col("max_bytes"))
    return j.select("instance", F.col("m.instance_api").alias("matched_receiver"), limit.alias("receiver_limit"),
                    new.alias("effective_max_bytes"))


def union_configs(local: DataFrame, remote: DataFrame) -> DataFrame:
    """SET-01: local then remote configs (UNION ALL), rows without a type
    or name dropped."""
    u = local.withColumn("origin", F.lit("local")).unionByName(remote.withColumn("origin", F.lit("remote")),
                                                             allowMissingColumns=True)
    return u.where((F.coalesce(F.col("type"), F.lit("")) != "") & (F.coalesce(F.col("name"), F.lit("")) != ""))


def input_errors(inputs: DataFrame, global_tenant: str = "") -> DataFrame:
    """VAL-04: per input its first validation error (NULL when valid), in
    the order the original applies them; duplicates are judged against
    earlier positions."""
    cfg = F.col("config")
    tenant = F.coalesce(F.nullif(F.element_at(cfg, F.lit("tenant_id")), F.lit("")), F.lit(global_tenant or None))
    dataset = F.nullif(F.element_at(cfg, F.lit("dataset_id")), F.lit(""))
    has_port = F.map_contains_key(cfg, "port")
    port = port_of(cfg)
    d = inputs.select("pos", "type", "name", tenant.alias("tenant"), dataset.alias("dataset"),
                      has_port.alias("has_port"), port.alias("port"))
    ok_port = F.col("has_port") & F.col("port").isNotNull() & F.col("port").between(1, 65535)
    wp = Window.partitionBy(F.when(ok_port, F.col("port"))).orderBy("pos")
    wd = Window.partitionBy("tenant", "dataset").orderBy("pos")
    d = d.withColumn("port_rank", F.when(ok_port, F.row_number().over(wp))) \
        .withColumn("ds_rank", F.row_number().over(wd))
    te, de = ident.identifier_error(F.col("tenant")), ident.identifier_error(F.col("dataset"))
    err = (
        F.when(F.col("dataset").isNull(), F.lit("dataset_required"))
        .when(F.col("tenant").isNull(), F.lit("tenant_required"))
        .when(te.isNotNull(), F.concat(F.lit("tenant:"), te))
        .when(de.isNotNull(), F.concat(F.lit("dataset:"), de))
        .when(F.lower("tenant") == F.lower("dataset"), F.lit("same"))
        .when(F.col("has_port") & F.col("port").isNull(), F.lit("port_not_number"))
        .when(F.col("has_port") & ~F.col("port").between(1, 65535), F.lit("port_range"))
        .when(F.col("port_rank") > 1, F.lit("port_in_use"))
        .when(F.col("ds_rank") > 1, F.lit("dataset_duplicate"))
    )
    return d.select("pos", "type", "name", "tenant", "dataset", err.alias("error"))


def first_input_error(inputs: DataFrame, global_tenant: str = "") -> DataFrame:
    """VAL-04: the error the whole configuration is rejected with (the
    first offending input by position), or no row when valid."""
    e = input_errors(inputs, global_tenant).where(F.col("error").isNotNull())
    return e.agg(F.min_by(F.struct("pos", "type", "error"), F.col("pos")).alias("f")).where(
        F.col("f").isNotNull()).select("f.*")


def reload_errors(configs: DataFrame) -> DataFrame:
    """VAL-05: every reload-validation error of each config, collected."""
    cfg = F.col("config")
    who = F.concat(F.col("type"), F.lit("["), F.col("name"), F.lit("]"))
    port = F.coalesce(port_of(cfg), F.lit(0))
    checks = [
        F.when(F.map_contains_key(cfg, "port") & ((port < 1) | (port > 65535)),
               F.format_string("%s: port %d is outside 1-65535", who, port)),
    ]
    for field in ("buffer_size", "read_buffer_size"):
        b = F.coalesce(F.element_at(cfg, F.lit(field)).try_cast("long"), F.lit(0))
        checks.append(F.when(F.map_contains_key(cfg, field) & ((b < 1024) | (b > 1073741824)),
                             F.format_string(f"%s: {field} %d is outside 1 KiB-1 GiB", who, b)))
    checks.append(F.when(F.col("type").isin(*DATAGRAM_TYPES) & ~F.map_contains_key(cfg, "port"),
                         F.format_string("%s: a port is needed", who)))
    errs = F.array_compact(F.array(*checks))
    return configs.select("pos", "type", "name", errs.alias("errors"))


def _normalised_json(s: Column) -> Column:
    return F.to_json(F.try_parse_json(s))


def config_changes(polls: DataFrame, key: str = "instance", order=("ts", "event_id")) -> DataFrame:
    """WIN-06: for each successful poll, did the (key-sorted, compact)
    config differ from the previously applied one? The first applied config
    is a change. Hash = SHA-256 of the normalised JSON; the previous hash is
    a two-level lag."""
    ok = polls.where(F.col("status") == 200).withColumn("hash", F.sha2(_normalised_json(F.col("config")), 256))
    d = previous_value(ok, F.col("hash"), [key], list(order), "_prev")
    return d.select(key, *[c for c in order if c != "ts"], "hash",
                    F.coalesce(F.col("_prev") != F.col("hash"), F.lit(True)).alias("changed"))


def effective_config(polls: DataFrame, key: str = "instance", order=("ts", "event_id")) -> DataFrame:
    """WIN-08: the config in force after each poll — the last successfully
    applied one (failed polls keep it; NULL before the first success)."""
    d = last_non_null(polls, F.when(F.col("status") == 200, F.col("config")), [key], list(order),
                      "effective_config")
    return d.select(key, *[c for c in order if c != "ts"], "status", "effective_config")


def auth_backoff(polls: DataFrame, key: str = "instance", order=("ts", "event_id"),
                 poll_interval_s: int = 60) -> DataFrame:
    """WIN-05: consecutive auth failures (401/403/404; a 200 resets, other
    codes are ignored), back-off 1, 2, 4 … 30 minutes, circuit open from 5
    failures, effective interval.

    The failures of a row are the running failure count minus its value at
    the last success.
    """
    d = polls.withColumn("_ok", F.when(F.col("status") == 200, 1).otherwise(0)) \
        .withColumn("_fail", F.when(F.col("status").isin(*AUTH_FAILURES), 1).otherwise(0))
    d = running_sums(d, {"_fails": F.col("_fail")}, [key], list(order))
    # The running failure count never falls, so the last success's is known.
    d = last_non_null(d, F.when(F.col("_ok") == 1, F.col("_fails")), [key], list(order), "_start")
    n = (F.col("_fails") - F.coalesce(F.col("_start"), F.lit(0)))
    backoff = F.when(n > 0, F.least(F.pow(F.lit(2), n - 1).cast("long"), F.lit(MAX_BACKOFF_MIN))).otherwise(0)
    open_ = n >= CIRCUIT_OPEN_AFTER
    return d.select(key, *[c for c in order if c != "ts"], "status", n.cast("int").alias("failures"),
                    backoff.cast("int").alias("backoff_min"), open_.alias("circuit_open"),
                    F.when(open_, backoff * 60).otherwise(F.lit(poll_interval_s)).cast("int").alias("interval_s"))


def datasets_per_doc(doc: DataFrame) -> DataFrame:
    """AGG-16: datasets in the control document (all tenants and pages)."""
    return doc.agg(F.sum(F.size("datasets")).cast("long").alias("datasets"),
                   F.count_distinct("tenant_id").alias("tenants"))


def tenant_config_slice(tenants: DataFrame, configs: DataFrame) -> DataFrame:
    """AGG-18: per tenant, the configs whose nested tenant_id is that
    tenant, as rows (tenant_id, name, type); a tenant without configs keeps
    one row with NULL name (its empty list). Collect per tenant only when a
    bounded report is wanted."""
    c = configs.select(F.element_at("config", F.lit("tenant_id")).alias("tenant_id"), "name", "type")
    return tenants.select("tenant_id").join(c, "tenant_id", "left")


def input_inventory(configs: DataFrame, active: str = "active") -> DataFrame:
    """AGG-07: inputs in total, active, and per type."""
    return configs.groupBy("type").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col(active)).alias("active"))
