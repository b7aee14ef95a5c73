"""Spool tables: path parsing, statistics, listings and pairings.

Inputs are a *listing* ``(path, length, modificationTime)`` — the shape of a
``binaryFile`` scan with content pruned — and the spool-file metadata table
(one row per batch file: id, tenant_id, dataset_id, state, status, size,
created_at, …). Everything here is a projection, a partial/final hash
aggregate or a join; no operator sorts a whole table into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import naming as N

STATES = ("raw", "queue", "retry", "dlq", "meta")

# Layout presets: number of path segments and the positions (1-based) of
# tenant, dataset, state and file; ``date_tenant`` also checks its date part.
LAYOUT_SEGMENTS = {
    "tenant_dataset": (4, 1, 2, 3, 4),
    "date_tenant": (7, 4, 5, 6, 7),
    "protocol_tenant": (5, 2, 3, 4, 5),
    "flat": (2, None, None, 1, 2),
}


def spool_path_columns(path: Column, layout: str = "tenant_dataset", root: str = "") -> list[Column]:
    """SRC-10: tenant_id, dataset_id, state, file and a validity flag from a
    spool path (string split, no regex). For ``flat`` tenant and dataset
    come from the ``tenant--dataset--nanos--hint`` file name. Unknown
    layouts are an error."""
    if layout not in LAYOUT_SEGMENTS:
        raise ValueError(f"unsupported spooling organization: {layout!r}")
    rel = path
    if root:
        prefix = root.rstrip("/") + "/"
        rel = F.when(path.startswith(prefix), F.substring(path, len(prefix) + 1, 1 << 30)).otherwise(path)
    parts = F.split(rel, "/", -1)
    n, ti, di, si, fi = LAYOUT_SEGMENTS[layout]
    f = F.element_at(parts, fi)
    if layout == "flat":
        name = F.split(f, "--", -1)
        tenant, dataset = F.element_at(name, 1), F.element_at(name, 2)
    else:
        tenant, dataset = F.element_at(parts, ti), F.element_at(parts, di)
    # Segments of a file listing are never empty, so the segment count (and
    # the date prefix for ``date_tenant``) is the whole validity test.
    ok = F.size(parts) == n
    if layout == "date_tenant":
        ok = ok & rel.rlike(r"^\d{4}/\d{2}/\d{2}/")
    return [tenant.alias("tenant_id"), dataset.alias("dataset_id"), F.element_at(parts, si).alias("state"),
            f.alias("file"), ok.alias("_ok")]


def parse_spool_path(path: Column, layout: str = "tenant_dataset", root: str = "") -> Column:
    """SRC-10 as one struct (NULL when the path does not fit the layout)."""
    cols = spool_path_columns(path, layout, root)
    return F.when(cols[-1], F.struct(*cols[:-1]))


def with_path_parts(listing: DataFrame, layout: str = "tenant_dataset", root: str = "") -> DataFrame:
    """SRC-10: add tenant_id, dataset_id, state, file, is_meta columns.

    Directories named ``meta`` and ``dlq`` are never datasets; rows whose
    path does not fit the layout are dropped.
    """
    cols = spool_path_columns(F.col("path"), layout, root)
    return (
        listing.select("*", *cols).where(F.col("_ok")).drop("_ok")
        .where(~F.col("dataset_id").isin("meta", "dlq"))
        .withColumn("is_meta", F.col("file").endswith(".meta"))
    )


def data_files(listing: DataFrame) -> DataFrame:
    """Listing rows that are data files (``.meta`` excluded)."""
    return listing.where(~F.col("is_meta"))


def _oldest(id_col: str, ts_col: str, cond: Column | None = None) -> Column:
    key = F.struct(F.col(ts_col), F.col(id_col))
    val = F.col(id_col) if cond is None else F.when(cond, F.col(id_col))
    k = key if cond is None else F.when(cond, key)
    return F.min_by(val, k)


def dlq_stats(listing: DataFrame) -> DataFrame:
    """AGG-01: queue / DLQ files and bytes per dataset, tenant and in total.

    Retry files are not counted. ``level`` is 0 for datasets, 1 for tenants,
    3 for the grand total (ROLLUP grouping id). Oldest files are by
    modification time (name breaks ties). Rows are aggregated per dataset
    first (partial/final hash aggregate); the rollup then runs over that
    small table, so raw rows are never expanded per grouping set.
    """
    d = data_files(listing).where(F.col("state").isin("queue", "dlq"))
    q, dl = F.col("state") == "queue", F.col("state") == "dlq"
    oldest = F.struct(F.col("modificationTime"), F.col("file"))
    per = d.groupBy("tenant_id", "dataset_id").agg(
        F.count_if(q).alias("qf"), F.sum(F.when(q, F.col("length"))).alias("qb"),
        F.count_if(dl).alias("df"), F.sum(F.when(dl, F.col("length"))).alias("db"),
        F.min(F.when(q, oldest)).alias("oq"), F.min(F.when(dl, oldest)).alias("od"))
    r = per.rollup("tenant_id", "dataset_id").agg(
        F.grouping_id().cast("int").alias("level"),
        F.sum("qf").cast("long").alias("queue_files"),
        F.coalesce(F.sum("qb"), F.lit(0)).cast("long").alias("queue_bytes"),
        F.sum("df").cast("long").alias("dlq_files"),
        F.coalesce(F.sum("db"), F.lit(0)).cast("long").alias("dlq_bytes"),
        F.min("oq").alias("oq"), F.min("od").alias("od"))
    return r.select("tenant_id", "dataset_id", "level", "queue_files", "queue_bytes", "dlq_files", "dlq_bytes",
                    F.col("oq.file").alias("oldest_queue_file"), F.col("od.file").alias("oldest_dlq_file"))


def directory_counts(listing: DataFrame, suffix: str = "") -> DataFrame:
    """AGG-02: per directory (tenant, dataset, state): files, bytes, oldest.

    ``.meta`` files never count; a non-empty ``suffix`` keeps only names
    ending with it.
    """
    d = data_files(listing)
    if suffix:
        d = d.where(F.col("file").endswith(suffix))
    return d.groupBy("tenant_id", "dataset_id", "state").agg(
        F.count(F.lit(1)).alias("files"),
        F.sum("length").cast("long").alias("bytes"),
        _oldest("file", "modificationTime").alias("oldest_file"),
    )


def detailed_stats(files: DataFrame) -> DataFrame:
    """AGG-03: per (tenant, dataset) and rolled up: count, size, oldest and
    newest creation, and ``statuses``, the number of files of every status
    that occurs. Rows are reduced per dataset and status first; the rollups
    run over those partials."""
    per = files.groupBy("tenant_id", "dataset_id", "status").agg(
        F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"),
        F.min("created_at").alias("oldest"), F.max("created_at").alias("newest"))
    per = per.withColumn("status", F.coalesce("status", F.lit("")))
    # Levels 0, 1 and 3: dataset, tenant, all.
    level = F.explode(F.array(F.lit(0), F.lit(1), F.lit(3))).alias("level")
    sets = per.select("*", level).select(
        F.when(F.col("level") < 3, F.col("tenant_id")).alias("tenant_id"),
        F.when(F.col("level") == 0, F.col("dataset_id")).alias("dataset_id"),
        "level", "status", "files", "bytes", "oldest", "newest")
    by_status = sets.groupBy("tenant_id", "dataset_id", "level", "status").agg(
        F.sum("files").alias("files"), F.sum("bytes").alias("bytes"),
        F.min("oldest").alias("oldest"), F.max("newest").alias("newest"))
    return by_status.groupBy("tenant_id", "dataset_id", "level").agg(
        F.sum("files").cast("long").alias("files"),
        F.sum("bytes").cast("long").alias("bytes"),
        F.min("oldest").alias("oldest"),
        F.max("newest").alias("newest"),
        F.map_from_entries(F.collect_list(F.struct("status", "files"))).alias("statuses"),
    )


def stats_lookup(stats: DataFrame, requested: DataFrame, keys=("tenant_id",)) -> DataFrame:
    """AGG-04: stats for requested keys, zero when the key has no files."""
    s = stats
    j = requested.join(s, list(keys), "left")
    zero = [c for c in s.columns if c not in keys and c.startswith(("files", "bytes", "n_"))]
    return j.select(*keys, *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in zero])


def tenant_sizes(listing: DataFrame) -> DataFrame:
    """AGG-13: bytes of all data files per tenant, plus the total (level 1);
    per-tenant partials first, then the rollup over them."""
    per = data_files(listing).groupBy("tenant_id").agg(F.sum("length").alias("b"))
    return per.rollup("tenant_id").agg(
        F.grouping_id().cast("int").alias("level"),
        F.sum("b").cast("long").alias("bytes"),
    )


def latest_token(files: DataFrame) -> DataFrame:
    """AGG-14: the bearer token of each tenant's newest file (id breaks ties)."""
    return files.groupBy("tenant_id").agg(
        F.max_by("bearer_token", F.struct("created_at", "id")).alias("bearer_token"))


def ineligible_per_dataset(files: DataFrame) -> DataFrame:
    """AGG-15: files per dataset that cleanup may not delete (not success)."""
    return files.where(F.col("status") != "success").groupBy("tenant_id", "dataset_id") \
        .agg(F.count(F.lit(1)).alias("files"))


# File names that are never served by the DLQ listing.
_UNSAFE_NAME = r"\.\.|/|\\"


def list_dlq(files: DataFrame, listing: DataFrame, tenant: str = "", dataset: str = "", limit: int = 100) -> DataFrame:
    """SRT-01 + JON-08 + VAL-08: first ``limit`` DLQ files in name order.

    Metadata rows in the DLQ are kept only when their data file still exists
    (left-semi join on the listing) and the name is safe. The limit is the
    feature (TakeOrderedAndProject); ``count_label`` shows ``100+`` when
    more rows exist.
    """
    d = files.where(F.col("state") == "dlq")
    if tenant not in ("", "*"):
        d = d.where(F.col("tenant_id") == tenant)
    if dataset not in ("", "*"):
        d = d.where(F.col("dataset_id") == dataset)
    d = d.withColumn("file", N.basename("path")).where(~F.col("file").rlike(_UNSAFE_NAME))
    exists = data_files(listing).select("path")
    d = d.join(exists, "path", "left_semi")
    top = d.orderBy("tenant_id", "dataset_id", "id").limit(limit + 1)
    w = Window.orderBy("tenant_id", "dataset_id", "id")  # at most limit+1 rows
    ranked = top.withColumn("rank", F.row_number().over(w)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy()))
    return ranked.where(F.col("rank") <= limit).select(
        F.col("rank").cast("long").alias("rank"), "tenant_id", "dataset_id", "id", "file", "size",
        F.when(F.col("n") > limit, F.lit(f"{limit}+")).otherwise(F.col("n").cast("string")).alias("count_label"),
    )


def oldest_first(files: DataFrame, partition=("tenant_id",)) -> DataFrame:
    """SRT-02: rank files oldest-first per partition (id breaks ties); the
    rank is a two-level running count, so a large tenant is not sorted in
    one task."""
    from ..plans.prefix import exclusive_running_sum
    r = exclusive_running_sum(files.withColumn("_one", F.lit(1)), "_one", list(partition), ["created_at", "id"], "_before")
    return r.withColumn("age_rank", (F.col("_before") + 1).cast("int")).drop("_one", "_before")


def pair_data_and_meta(listing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """JON-07: pair retry metadata with its data file by (tenant, dataset, id).

    Returns ``(jobs, orphans)``: paired jobs (inner join) and metadata rows
    whose data file is gone (left-anti join), which are skipped.
    """
    retry = listing.where(F.col("state") == "retry")
    stem = F.regexp_replace(F.col("file"), r"\.(gz|meta)\z", "")
    meta = retry.where(F.col("is_meta")).select("tenant_id", "dataset_id", stem.alias("batch_id"),
                                                F.col("path").alias("meta_path"))
    data = retry.where(~F.col("is_meta")).select("tenant_id", "dataset_id", stem.alias("batch_id"),
                                                 F.col("path").alias("file_path"))
    keys = ["tenant_id", "dataset_id", "batch_id"]
    return meta.join(data, keys, "inner"), meta.join(data, keys, "left_anti")


def delivery_jobs(listing: DataFrame) -> DataFrame:
    """SET-02: queue jobs (no metadata) then paired retry jobs, as one table
    with a ``stage`` order column (0 = queue first)."""
    stem = F.regexp_replace(F.col("file"), r"\.gz\z", "")
    queue = data_files(listing).where(F.col("state") == "queue").select(
        F.lit(0).alias("stage"), "tenant_id", "dataset_id", stem.alias("batch_id"),
        F.col("path").alias("file_path"), F.lit(None).cast("string").alias("meta_path"))
    jobs, _ = pair_data_and_meta(listing)
    retry = jobs.select(F.lit(1).alias("stage"), "tenant_id", "dataset_id", "batch_id", "file_path", "meta_path")
    return queue.unionByName(retry)
