"""Queries over configuration tables (JON-*, VAL-*, SET-01, WIN-05/06/08, AGG-07/16/18)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ident
from ..operators import configs as C
from ..sources import fixtures as fx
from .catalog import register
from .oracle_fixtures import with_fixtures

TOKEN = "global-token"
GLOBAL_TENANT = "globaltenant"


def _configs(spark, sf):
    return C.expand_control_doc(fx.control_doc(spark, sf), bearer_token=TOKEN)


def _flat(df):
    cfg = F.col("config")
    return df.select("type", "name", "pos", *[F.element_at(cfg, F.lit(k)).alias(k) for k in
                                              ("tenant_id", "dataset_id", "bearer_token", "port", "host")])


@register("jon01_control_expand", with_fixtures("SELECT * FROM configs_flat"))
def q_control_expand(spark, sf):
    """SRC-13 + JON-01: control document -> input configs."""
    return _flat(_configs(spark, sf))


@register("jon02_globals", with_fixtures(f"""
SELECT pos, coalesce(tenant_id, '{GLOBAL_TENANT}') AS tenant_id, coalesce(bearer_token, '{TOKEN}') AS bearer_token
FROM local_inputs"""))
def q_globals(spark, sf):
    """JON-02: global tenant / token added where absent."""
    g = C.apply_globals(fx.local_inputs(spark, sf), GLOBAL_TENANT, TOKEN)
    return g.select("pos", F.element_at("config", F.lit("tenant_id")).alias("tenant_id"),
                    F.element_at("config", F.lit("bearer_token")).alias("bearer_token"))


@register("jon03_port_attribution", with_fixtures("""
WITH pc AS (
  SELECT event_id, CAST(1000 + user_id % 6 AS INT) AS port,
    CASE WHEN CAST(ts AS DATE) = DATE '2024-01-15' THEN 0
         ELSE sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY 1000 + user_id % 6 ORDER BY ts, event_id
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS drops
  FROM events)
SELECT m.tenant_id, coalesce(m.dataset_id, 'unknown') AS dataset_id, count(*) AS readings, CAST(max(pc.drops) AS BIGINT) AS max_drops
FROM pc LEFT JOIN (SELECT CAST(port AS INT) AS port, arg_max(dataset_id, pos) AS dataset_id, arg_max(tenant_id, pos) AS tenant_id
                   FROM configs_flat WHERE type IN ('udp', 'syslog', 'netflow', 'sflow', 'ipfix', 'ebpf') GROUP BY 1) m
  ON m.port = pc.port + 24 GROUP BY 1, 2"""))
def q_port_attribution(spark, sf):
    """JON-03: drop counters attributed to datasets via the port map
    (counter ports 1000..1005 map to config ports 1024..1029)."""
    pc = fx.port_counters(spark, sf).withColumn("port", F.col("port") + 24)
    j = C.attribute_ports(pc, C.port_datasets(_configs(spark, sf)))
    return j.groupBy("tenant_id", "dataset_id").agg(F.count(F.lit(1)).alias("readings"), F.max("drops").cast("long").alias("max_drops"))


@register("jon04_port_conflicts", with_fixtures("""
SELECT o.port, o.plugin AS local_plugin, n.plugin AS remote_plugin,
  'port ' || o.port || ' is claimed by local input ' || o.plugin || ' and remote config ' || n.plugin || '; the remote one is used' AS message
FROM (SELECT port, arg_max(plugin, pos) AS plugin FROM old_ports GROUP BY port) o JOIN new_ports n USING (port) WHERE o.port > 0"""))
def q_port_conflicts(spark, sf):
    """JON-04: local vs remote port conflicts."""
    old, new = fx.port_maps(spark, sf)
    return C.port_conflicts(old, new)


@register("jon05_port_changes", with_fixtures("""
SELECT port, change, CASE change WHEN 'removed' THEN 'port ' || port || ': ' || old_plugin || ' is gone'
  WHEN 'added' THEN 'port ' || port || ': ' || new_plugin || ' is new'
  ELSE 'port ' || port || ': ' || old_plugin || ' gave way to ' || new_plugin END AS message
FROM (SELECT coalesce(o.port, n.port) AS port, o.plugin AS old_plugin, n.plugin AS new_plugin,
        CASE WHEN n.plugin IS NULL THEN 'removed' WHEN o.plugin IS NULL THEN 'added'
             WHEN o.plugin <> n.plugin THEN 'reassigned' END AS change
      FROM (SELECT port, arg_max(plugin, pos) AS plugin FROM old_ports GROUP BY port) o
        FULL OUTER JOIN (SELECT port, arg_max(plugin, (pos, plugin)) AS plugin FROM new_ports GROUP BY port) n USING (port))
WHERE change IS NOT NULL"""))
def q_port_changes(spark, sf):
    """JON-05: port diff between old and new assignments."""
    old, new = fx.port_maps(spark, sf)
    return C.port_changes(old, new)


@register("jon06_receiver_limits", with_fixtures("""
WITH p AS (SELECT *, regexp_replace(regexp_replace(receiver_url, '^https?://', ''), '/$', '') AS url FROM instances),
p2 AS (SELECT *, CASE WHEN instr(url, ':') > 0 THEN split_part(url, ':', -1) ELSE '' END AS url_port FROM p),
m AS (SELECT instance, arg_min(instance_api, r.pos) AS api, arg_min(max_payload_size, r.pos) AS lim
      FROM p2 JOIN receivers r ON contains(url, instance_api) OR contains(instance_api, url)
        OR (url_port <> '' AND suffix(instance_api, ':' || url_port))
      GROUP BY instance),
j AS (SELECT p2.instance, p2.max_bytes, m.api,
        coalesce(m.lim, (SELECT min(max_payload_size) FROM receivers WHERE max_payload_size > 0)) AS lim
      FROM p2 LEFT JOIN m USING (instance))
SELECT instance, api AS matched_receiver, lim AS receiver_limit,
  CASE WHEN lim > 0 AND (CASE WHEN max_bytes <= 0 THEN 1048576 ELSE max_bytes END) >= CAST(trunc(CAST(lim AS DOUBLE) * CAST(0.95 AS DOUBLE)) AS BIGINT)
       THEN CAST(trunc(CAST(lim AS DOUBLE) * CAST(0.90 AS DOUBLE)) AS BIGINT) ELSE max_bytes END AS effective_max_bytes
FROM j"""))
def q_receiver_limits(spark, sf):
    """JON-06: receiver match (theta join) and batch-size clamp."""
    return C.receiver_limits(fx.instances(spark, sf), fx.receivers(spark, sf))


@register("set01_config_union", with_fixtures("""
SELECT origin, type, count(*) AS configs FROM (
  SELECT 'local' AS origin, type, name FROM local_inputs UNION ALL SELECT 'remote', type, name FROM configs_flat)
WHERE coalesce(type, '') <> '' AND coalesce(name, '') <> '' GROUP BY ALL"""))
def q_config_union(spark, sf):
    """SET-01: local + remote configs, typeless rows dropped."""
    local = fx.local_inputs(spark, sf).select("type", "name", "config")
    remote = _configs(spark, sf).select("type", "name", "config")
    return C.union_configs(local, remote).groupBy("origin", "type").agg(F.count(F.lit(1)).alias("configs"))


_ID_RX = r"^[a-zA-Z0-9][a-zA-Z0-9_-]*[a-zA-Z0-9]$|^[a-zA-Z0-9]$"
_RESERVED = ", ".join(f"'{w}'" for w in ident.RESERVED_NAMES)


def _id_err_sql(x: str) -> str:
    return (f"(CASE WHEN {x} IS NULL OR {x} = '' THEN 'empty' WHEN strlen({x}) > 64 THEN 'too_long' "
            f"WHEN NOT regexp_matches({x}, '{_ID_RX}') THEN 'pattern' WHEN lower({x}) IN ({_RESERVED}) THEN 'reserved' END)")


@register("val01_identifiers", with_fixtures(f"""
SELECT id, {_id_err_sql('id')} AS error FROM (
  SELECT DISTINCT CASE WHEN dataset_id = '' THEN NULL ELSE dataset_id END AS id FROM local_inputs
  UNION SELECT DISTINCT lower(p_type) FROM part
  UNION SELECT DISTINCT replace(lower(p_brand), '#', '') FROM part
  UNION SELECT DISTINCT lower(n_name) FROM nation
  UNION SELECT DISTINCT lower(r_name) FROM region
  UNION SELECT DISTINCT CASE WHEN c_custkey % 50 = 0 THEN '-' || c_name WHEN c_custkey % 50 = 1 THEN c_name || '_'
       WHEN c_custkey % 50 = 2 THEN repeat('a', 60 + c_custkey % 10) ELSE lower(c_mktsegment) END FROM customer
  UNION SELECT DISTINCT CASE WHEN s_suppkey % 3 = 0 THEN 'ROOT' WHEN s_suppkey % 3 = 1 THEN 'Com' || (s_suppkey % 10) ELSE 'x' END FROM supplier)"""))
def q_identifiers(spark, sf):
    """VAL-01/02: identifier errors over id candidates taken from the tables."""
    li = fx.local_inputs(spark, sf).select(F.nullif(F.element_at("config", F.lit("dataset_id")), F.lit("")).alias("id"))
    part = spark.read.parquet(f"{sf}/part.parquet")
    ids = (li.union(part.select(F.lower("p_type")))
           .union(part.select(F.replace(F.lower("p_brand"), F.lit("#"), F.lit(""))))
           .union(spark.read.parquet(f"{sf}/nation.parquet").select(F.lower("n_name")))
           .union(spark.read.parquet(f"{sf}/region.parquet").select(F.lower("r_name")))
           .union(spark.read.parquet(f"{sf}/customer.parquet").select(F.expr(
               "CASE WHEN c_custkey % 50 = 0 THEN concat('-', c_name) WHEN c_custkey % 50 = 1 THEN concat(c_name, '_') "
               "WHEN c_custkey % 50 = 2 THEN repeat('a', cast(60 + c_custkey % 10 as int)) ELSE lower(c_mktsegment) END")))
           .union(spark.read.parquet(f"{sf}/supplier.parquet").select(F.expr(
               "CASE WHEN s_suppkey % 3 = 0 THEN 'ROOT' WHEN s_suppkey % 3 = 1 THEN concat('Com', s_suppkey % 10) ELSE 'x' END")))
           ).distinct()
    return ids.select("id", ident.identifier_error("id").alias("error"))


@register("val03_pairs", with_fixtures(f"""
SELECT tenant_id, dataset_id,
  CASE WHEN {_id_err_sql('tenant_id')} IS NOT NULL THEN 'tenant:' || {_id_err_sql('tenant_id')}
       WHEN {_id_err_sql('dataset_id')} IS NOT NULL THEN 'dataset:' || {_id_err_sql('dataset_id')}
       WHEN lower(tenant_id) = lower(dataset_id) THEN 'same' END AS error
FROM (SELECT DISTINCT lower(n_name) AS tenant_id,
        CASE WHEN c_custkey % 7 = 0 THEN upper(n_name) WHEN c_custkey % 7 = 1 THEN 'tmp' ELSE lower(c_mktsegment) END AS dataset_id
      FROM customer JOIN nation ON c_nationkey = n_nationkey)"""))
def q_pairs(spark, sf):
    """VAL-03: tenant/dataset pair validation."""
    c = spark.read.parquet(f"{sf}/customer.parquet")
    n = spark.read.parquet(f"{sf}/nation.parquet")
    p = c.join(n, c.c_nationkey == n.n_nationkey).select(
        F.lower("n_name").alias("tenant_id"),
        F.expr("CASE WHEN c_custkey % 7 = 0 THEN upper(n_name) WHEN c_custkey % 7 = 1 THEN 'tmp' "
               "ELSE lower(c_mktsegment) END").alias("dataset_id")).distinct()
    return p.select("tenant_id", "dataset_id", ident.pair_error("tenant_id", "dataset_id").alias("error"))


_VAL04_SQL = f"""
WITH d AS (SELECT pos, type, name, coalesce(nullif(tenant_id, ''), '{GLOBAL_TENANT}') AS tenant,
    nullif(dataset_id, '') AS dataset, port IS NOT NULL AS has_port, TRY_CAST(port AS INT) AS p FROM local_inputs),
r AS (SELECT *, CASE WHEN has_port AND p BETWEEN 1 AND 65535 THEN row_number() OVER (PARTITION BY CASE WHEN has_port AND p BETWEEN 1 AND 65535 THEN p END ORDER BY pos) END AS port_rank,
        row_number() OVER (PARTITION BY tenant, dataset ORDER BY pos) AS ds_rank FROM d)
SELECT pos, type, name, tenant, dataset,
  CASE WHEN dataset IS NULL THEN 'dataset_required' WHEN tenant IS NULL THEN 'tenant_required'
       WHEN {_id_err_sql('tenant')} IS NOT NULL THEN 'tenant:' || {_id_err_sql('tenant')}
       WHEN {_id_err_sql('dataset')} IS NOT NULL THEN 'dataset:' || {_id_err_sql('dataset')}
       WHEN lower(tenant) = lower(dataset) THEN 'same'
       WHEN has_port AND p IS NULL THEN 'port_not_number'
       WHEN has_port AND NOT (p BETWEEN 1 AND 65535) THEN 'port_range'
       WHEN port_rank > 1 THEN 'port_in_use' WHEN ds_rank > 1 THEN 'dataset_duplicate' END AS error
FROM r"""


@register("val04_input_errors", with_fixtures(_VAL04_SQL))
def q_input_errors(spark, sf):
    """VAL-04: per-input validation error (first applicable check)."""
    return C.input_errors(fx.local_inputs(spark, sf), GLOBAL_TENANT)


@register("val04_first_offender", with_fixtures(f"""
SELECT pos, type, error FROM ({_VAL04_SQL}) WHERE error IS NOT NULL ORDER BY pos LIMIT 1"""))
def q_first_offender(spark, sf):
    """VAL-04: the configuration's rejection reason (first offender)."""
    return C.first_input_error(fx.local_inputs(spark, sf), GLOBAL_TENANT)


@register("val05_reload_errors", with_fixtures("""
SELECT pos, type, name, array_to_string(list_filter([
    CASE WHEN port IS NOT NULL AND (coalesce(TRY_CAST(port AS INT), 0) < 1 OR coalesce(TRY_CAST(port AS INT), 0) > 65535)
         THEN type || '[' || name || ']: port ' || coalesce(TRY_CAST(port AS INT), 0) || ' is outside 1-65535' END,
    CASE WHEN buffer_size IS NOT NULL AND (CAST(buffer_size AS BIGINT) < 1024 OR CAST(buffer_size AS BIGINT) > 1073741824)
         THEN type || '[' || name || ']: buffer_size ' || buffer_size || ' is outside 1 KiB-1 GiB' END,
    CASE WHEN type IN ('udp', 'syslog', 'netflow', 'sflow', 'ipfix', 'ebpf') AND port IS NULL
         THEN type || '[' || name || ']: a port is needed' END], lambda x: x IS NOT NULL), '; ') AS errors
FROM local_inputs"""))
def q_reload_errors(spark, sf):
    """VAL-05: all reload-validation errors per input, joined."""
    e = C.reload_errors(fx.local_inputs(spark, sf))
    return e.select("pos", "type", "name", F.array_join("errors", "; ").alias("errors"))


@register("win05_auth_backoff", with_fixtures("""
WITH i AS (SELECT *, sum(CASE WHEN status = 200 THEN 1 ELSE 0 END) OVER (PARTITION BY instance ORDER BY ts, event_id
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM poll_log),
f AS (SELECT *, sum(CASE WHEN status IN (401, 403, 404) THEN 1 ELSE 0 END) OVER (PARTITION BY instance, island ORDER BY ts, event_id
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM i)
SELECT instance, event_id, status, CAST(n AS INT) AS failures,
  CAST(CASE WHEN n > 0 THEN least(CAST(pow(2, n - 1) AS BIGINT), 30) ELSE 0 END AS INT) AS backoff_min,
  n >= 5 AS circuit_open,
  CAST(CASE WHEN n >= 5 THEN least(CAST(pow(2, n - 1) AS BIGINT), 30) * 60 ELSE 60 END AS INT) AS interval_s
FROM f"""))
def q_auth_backoff(spark, sf):
    """WIN-05: consecutive auth failures, back-off and circuit state."""
    return C.auth_backoff(fx.poll_log(spark, sf))


@register("win06_config_change", with_fixtures("""
SELECT instance, event_id, changed FROM (
  SELECT instance, event_id, coalesce(lag(CAST(json(config) AS VARCHAR)) OVER (PARTITION BY instance ORDER BY ts, event_id)
         <> CAST(json(config) AS VARCHAR), true) AS changed
  FROM poll_log WHERE status = 200)"""))
def q_config_change(spark, sf):
    """WIN-06: applied-config change detection by hash."""
    return C.config_changes(fx.poll_log(spark, sf)).select("instance", "event_id", "changed")


@register("win08_effective_config", with_fixtures("""
SELECT instance, event_id, status,
  last_value(CASE WHEN status = 200 THEN config END IGNORE NULLS) OVER (PARTITION BY instance ORDER BY ts, event_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS effective_config
FROM poll_log"""))
def q_effective_config(spark, sf):
    """WIN-08: config in force after each poll (last successful one)."""
    return C.effective_config(fx.poll_log(spark, sf))


@register("agg16_datasets_per_doc", """
SELECT CAST(count(c_custkey) AS BIGINT) AS datasets, (SELECT count(*) FROM nation) AS tenants
FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey""")
def q_datasets_per_doc(spark, sf):
    """AGG-16: datasets in the control document."""
    return C.datasets_per_doc(fx.control_doc(spark, sf))


@register("agg18_tenant_config_slice", with_fixtures("""
SELECT 'tenant' || n_nationkey AS tenant_id, count(c.name) AS configs, min(c.name) AS first_name, max(c.name) AS last_name
FROM nation LEFT JOIN configs_flat c ON c.tenant_id = 'tenant' || n_nationkey GROUP BY 1"""))
def q_tenant_config_slice(spark, sf):
    """AGG-18: per-tenant slice of the config list (nested tenant match)."""
    tenants = fx.control_doc(spark, sf).select("tenant_id").distinct()
    s = C.tenant_config_slice(tenants, _configs(spark, sf))
    return s.groupBy("tenant_id").agg(F.count("name").alias("configs"), F.min("name").alias("first_name"),
                                      F.max("name").alias("last_name"))


@register("agg07_input_inventory", f"""
SELECT {C.__name__ and "CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'udp' WHEN 'BUILDING' THEN 'syslog' WHEN 'FURNITURE' THEN 'http' WHEN 'MACHINERY' THEN 'kafka' ELSE '' END"} AS type,
  count(*) AS total, count(*) FILTER (WHERE c_custkey % 4 <> 0) AS active
FROM customer GROUP BY 1""")
def q_input_inventory(spark, sf):
    """AGG-07: inputs in total / active per type (all datasets of the doc)."""
    d = fx.control_doc(spark, sf).select(F.explode("datasets").alias("d")).select(
        F.col("d.config.source.type").alias("type"), F.col("d.active").alias("active"))
    return C.input_inventory(d)
