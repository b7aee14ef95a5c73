"""Sinks: raw landing, layout presets, batch files, queue ids, delivery
manifests and the source archive (SNK-01..06).

Writers use Spark's partitioned file writers (one task writes each file;
the committer makes the write atomic and retry-safe), so a lost executor
re-runs its tasks without duplicating output. Batch objects, which are many
and small, are written by ``objects`` where tasks can open the folder.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import naming as N
from ..functions import text as TX
from . import objects

# SNK-02 layout presets: partition columns of the landing table.
LAYOUT_COLUMNS = {
    "flat": [],
    "tenant_dataset": ["tenant_id", "dataset_id"],
    "date_tenant": ["year", "month", "day", "tenant_id", "dataset_id"],
    "protocol_tenant": ["protocol", "tenant_id", "dataset_id"],
}


def layout_columns(layout: str) -> list[str]:
    """SNK-02: partition columns of a layout; unknown layouts are an error
    (an empty layout means the default)."""
    layout = layout or "tenant_dataset"
    if layout not in LAYOUT_COLUMNS:
        raise ValueError(f"unsupported spooling organization: '{layout}' "
                         "(supported: flat, tenant_dataset, date_tenant, protocol_tenant)")
    return LAYOUT_COLUMNS[layout]


def with_layout(df: DataFrame, layout: str, ts: str = "ts", protocol: str = "data") -> DataFrame:
    """Add the partition columns a layout needs (date parts, protocol)."""
    cols = layout_columns(layout)
    if "year" in cols:
        df = df.withColumn("year", F.date_format(ts, "yyyy")).withColumn("month", F.date_format(ts, "MM")) \
            .withColumn("day", F.date_format(ts, "dd"))
    if "protocol" in cols:
        df = df.withColumn("protocol", F.lit(protocol))
    return df


def raw_name_parts(df: DataFrame, data: str = "data", hint: str = "data_hint", ts: str = "ts",
                   seq: str = "seq") -> DataFrame:
    """SNK-01: the raw-file name parts ``{nanos}_{bytes}_{lines}.{ext}`` as
    columns (nanos = ingest micros x 1000 + seq mod 1000 keeps them unique)."""
    nanos = F.unix_micros(F.col(ts).cast("timestamp")) * 1000 + (F.col(seq) % 1000)
    return (df.withColumn("nanos", nanos)
            .withColumn("bytes", F.octet_length(data).cast("long"))
            .withColumn("lines", TX.non_blank_line_count(data))
            .withColumn("ext", N.hint_to_extension(hint))
            .withColumn("raw_name", F.format_string("%d_%d_%d.%s", "nanos", "bytes", "lines", "ext")))


def write_raw(df: DataFrame, path: str, layout: str = "tenant_dataset", mode: str = "append") -> None:
    """SNK-01/02: land raw rows as Parquet under the layout's partitions."""
    d = with_layout(df, layout)
    w = d.write.mode(mode).format("parquet")
    cols = layout_columns(layout)
    (w.partitionBy(*cols) if cols else w).save(path)


def write_batches(lines: DataFrame, path: str, keys: Sequence[str] = ("tenant_id", "dataset_id", "data_hint"),
                  batch: str = "batch_no", order: Sequence[str] = ("seq", "line_no"), line: str = "line",
                  mode: str = "append") -> None:
    """SNK-03: one gzip text object per batch (lines in order).

    ``repartition`` on (keys, batch) routes each batch to one task and
    ``sortWithinPartitions`` restores line order; gzip is of level 6 (the
    codec default) and the partition directories carry the batch identity.
    An object costs more than its bytes, so the number of tasks is explicit:
    runtime coalescing goes by bytes.
    """
    cols = list(keys) + [batch]
    n = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = lines.repartition(n, *cols).sortWithinPartitions(*cols, *order).select(*cols, F.col(line).alias("value"))
    folder = objects.shared_folder(lines.sparkSession, path)
    if folder is not None and mode == "append":
        objects.write_objects(d.withColumns({c: F.col(c).cast("string") for c in cols}), folder, cols)
        return
    d.write.mode(mode).option("compression", "gzip").partitionBy(*cols).text(path)


def read_batches(spark: SparkSession, path: str, keys: Sequence[str] = ("tenant_id", "dataset_id", "data_hint"),
                 batch: str = "batch_no") -> DataFrame:
    """The objects of ``write_batches``: whole text (``value``), keys (as
    written: no type is guessed from the folders' names) and batch number."""
    folder = objects.shared_folder(spark, path)
    if folder is not None:
        return objects.read_objects(spark, folder, [*keys, batch]).withColumn(batch, F.col(batch).cast("long"))
    kinds = [f"`{c}` string" for c in keys] + [f"`{batch}` long"]
    return spark.read.schema(", ".join(["value string", *kinds])).text(path, wholetext=True)


def queue_filename(batch_id: Column, tenant: Column, dataset: Column, nanos: Column, hint: Column) -> Column:
    """SNK-04: queue file name: ids containing ``--`` become ``id.gz``;
    anything else gets a generated ``tenant--dataset--nanos--hint.gz``."""
    return F.when(batch_id.contains("--"), F.concat(batch_id, F.lit(".gz"))).otherwise(
        N.batch_filename(tenant, dataset, nanos, hint))


# Starts the names of the batch headers; receivers may expect another one.
HEADER_PREFIX = "X-Batch-"


def delivery_manifest(files: DataFrame, base_url: str, global_token: str = "", app: str = "tidewater/0.1.0",
                      prefix: str = HEADER_PREFIX) -> DataFrame:
    """SNK-05: one row per upload request: URL and headers.

    URL = base (``{tenantid}`` / ``{datasetid}`` placeholders substituted
    when present, else ``/tenant/dataset`` appended). The batch token falls
    back to the global one; the file name falls back to a generated name.
    """
    b = base_url.rstrip("/")
    if "{tenantid}" in b or "{datasetid}" in b:
        url = F.replace(F.replace(F.lit(b), F.lit("{tenantid}"), F.col("tenant_id")), F.lit("{datasetid}"), F.col("dataset_id"))
    else:
        url = F.concat(F.lit(b + "/"), F.col("tenant_id"), F.lit("/"), F.col("dataset_id"))
    token = F.coalesce(F.nullif(F.col("bearer_token"), F.lit("")), F.lit(global_token or None))
    fname = F.coalesce(F.nullif(N.basename("path"), F.lit("")),
                       N.batch_filename("tenant_id", "dataset_id", F.unix_micros(F.col("created_at").cast("timestamp")) * 1000,
                                        "data_hint"))
    headers = F.map_concat(
        F.create_map(
            F.lit("User-Agent"), F.lit(app), F.lit("Content-Encoding"), F.lit("gzip"),
            F.lit("Content-Type"), F.lit("application/octet-stream"),
            F.lit(prefix + "ID"), F.col("id"),
            F.lit(prefix + "Line-Count"), F.col("line_count").cast("string"),
            F.lit(prefix + "Original-Bytes"), F.col("size").cast("string"),
            F.lit(prefix + "Created-At"), TX.rfc3339("created_at"),
            F.lit(prefix + "Data-Hint"), F.col("data_hint"),
            F.lit(prefix + "Filename"), fname),
        F.when(token.isNotNull(), F.create_map(F.lit("Authorization"), F.concat(F.lit("Bearer "), token)))
        .otherwise(F.create_map().cast("map<string,string>")))
    return files.select("id", "tenant_id", "dataset_id", url.alias("url"), headers.alias("headers"))


def header_text(headers: Column) -> Column:
    """SNK-06: ``Key: value`` lines, sorted, newline-terminated."""
    lines = F.transform(F.map_entries(headers), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return F.concat(F.array_join(F.array_sort(lines), "\n"), F.lit("\n"))


def source_archive(manifest: DataFrame, outcome: DataFrame, enabled: bool = True,
                   prefix: str = HEADER_PREFIX) -> DataFrame:
    """SNK-06: for successfully delivered batches (when enabled), the
    archive row: ``src/<file>`` and its ``.headers`` text."""
    if not enabled:
        return manifest.limit(0)
    ok = outcome.where(F.col("new_state") == "delivered").select("id")
    m = manifest.join(ok, "id", "left_semi")
    fname = F.element_at("headers", F.lit(prefix + "Filename"))
    return m.select("id", "tenant_id", "dataset_id",
                    F.concat_ws("/", "tenant_id", "dataset_id", F.lit("src"), fname).alias("archive_path"),
                    header_text(F.col("headers")).alias("headers_text"))
