"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source asks for the same real number of copies, the
source's target over its size. The whole part is certain; the fractional
parts are rounded dependently: two documents are paired and mass (in words)
moves between them at random until one of them is at 0 or 1, the other carries
on. The expected copies of each document stay what they were, and the words a
source gives miss its target by less than one document.

The pairing runs in a reduction tree: rows meet in buckets of about
``FAN_IN``, each bucket folds to one residual document, residuals meet in
buckets again until each source has one, which a last draw decides. A source
with a third of all rows is just more buckets. Everything is DataFrame
operations; draws are hashes, so reruns agree.

Defined results: NULL and word-less texts have size 0 and are not taken; the
NULL source is a source, last in order; rows repeated with the same doc_id,
source and size share their copies evenly; an empty table gives an empty
result; columns besides doc_id, text and source are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.prefix import running_sums
from .common import cut, word_count

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
FAN_IN = 64
SEED = 11


def ranked(df: DataFrame, *order, out: str) -> DataFrame:
    """``df`` with its position from 0 in ``order``, without one task that
    sees all rows: a range sort numbers the rows within each task, and the
    tasks' row counts, one a task, give the offsets."""
    at = cut(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    task = F.shiftright("_at", 33)
    counts = at.groupBy(task.alias("_task")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_task", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return at.withColumn("_task", task).join(offsets, "_task") \
        .withColumn(out, F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_task", "_at", "_before")


def targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """``sizes`` (source, source_size) with ``target``.

    Targets share all words by weight; what lies above ``most`` times a
    source's size is shared again by the others until none is above. Only
    sums come to the driver.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    table = cut(ranked(sizes, F.col("source").asc_nulls_last(), out="_rank").withColumn("_w", w).drop("_rank"))
    limit = F.col("source_size") * float(most)
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:
        over = F.col("_w") * level > limit
        row = table.agg(F.sum(F.when(over, limit).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("_w"))),
                        F.sum(over.cast("long"))).first()
        if row[2] is None or row[2] == capped or not row[1]:
            break
        capped, level = row[2], (total - row[0]) / row[1]
    return table.withColumn("target", F.least(F.col("_w") * level, limit)).drop("_w")


def _fold(level: int) -> str:
    """SQL: fold the sorted ``items`` (s: words a copy, f: fraction) of a
    bucket pairwise. State: i, s, f of the document that is still fractional
    (i < 0: none), n items seen, positions of the ones."""
    draw = f"pmod(xxhash64({SEED}, {level}, source, node, a.i, a.n), 4503599627370496) / 4503599627370496D"
    state = "named_struct('i', {i}, 's', {s}, 'f', {f}, 'n', a.n + 1, 'ones', {ones})"
    take = "named_struct('i', {i}, 's', {s}, 'f', {f}, 'n', a.n + 1, 'ones', {ones})"
    none = dict(i="-1", s="0D", f="0D")
    one_a, one_d = "array_append(a.ones, a.i)", "array_append(a.ones, a.n)"
    fresh = state.format(i="a.n", s="d.s", f="d.f", ones="a.ones")
    # Up: the held document gains. It reaches 1 first, or the new one reaches 0.
    up = (f"CASE WHEN 1 - a.f <= p.give THEN CASE WHEN p.rest_up <= 1e-12 THEN {take.format(**none, ones=one_a)} "
          f"ELSE {take.format(i='a.n', s='d.s', f='p.rest_up', ones=one_a)} END "
          f"ELSE {take.format(i='a.i', s='a.s', f='a.f + p.up', ones='a.ones')} END")
    # Down: the held document loses. It reaches 0 first, or the new one reaches 1.
    down = (f"CASE WHEN a.f <= p.room THEN CASE WHEN p.rest_down >= 1 - 1e-12 THEN {take.format(**none, ones=one_d)} "
            f"ELSE {take.format(i='a.n', s='d.s', f='p.rest_down', ones='a.ones')} END "
            f"ELSE {take.format(i='a.i', s='a.s', f='a.f - p.down', ones=one_d)} END")
    pair = ("named_struct('give', d.f * d.s / a.s, 'room', (1 - d.f) * d.s / a.s, "
            "'up', least(1 - a.f, d.f * d.s / a.s), 'down', least(a.f, (1 - d.f) * d.s / a.s), "
            f"'rest_up', d.f - (1 - a.f) * a.s / d.s, 'rest_down', d.f + a.f * a.s / d.s, 'u', {draw})")
    step = (f"CASE WHEN a.i < 0 THEN {fresh} ELSE transform(array({pair}), "
            f"p -> CASE WHEN p.u * (p.up + p.down) < p.down THEN {up} ELSE {down} END)[0] END")
    start = "named_struct('i', -1, 's', 0D, 'f', 0D, 'n', 0, 'ones', cast(array() as array<int>))"
    return f"aggregate(items, {start}, (a, d) -> {step})"


def _bit(nth: str) -> str:
    """1, 0, or NULL for the document that goes on to the next level."""
    return f"CASE WHEN array_contains(done.ones, {nth}) THEN 1 WHEN {nth} = done.i THEN NULL ELSE 0 END"


def round_fractions(items: DataFrame, payload: list[str]) -> DataFrame:
    """``items`` (source, s, f, and ``payload``) with ``bit``, 0 or 1: each
    fraction f rounded dependently within its source."""
    counts = items.groupBy("source").agg(F.count(F.lit(1)).alias("_n"))
    at = F.xxhash64(F.lit(SEED), *payload)
    nodes = counts.select(F.col("source").alias("_s"), F.ceil(F.col("_n") / FAN_IN).cast("long").alias("_nodes"))
    spread = items.join(nodes, F.col("source").eqNullSafe(F.col("_s"))).drop("_s") \
        .withColumn("_at", at).withColumn("node", F.pmod("_at", "_nodes"))
    cols = [F.col("_at").alias("at"), *[F.col(c) for c in payload], "s", "f"]
    base = cut(spread.groupBy("source", "node").agg(F.sort_array(F.collect_list(F.struct(*cols))).alias("items"))
               .withColumn("done", F.expr(_fold(0))))
    levels = []
    rest = base.where("done.i >= 0").select("source", F.col("node").alias("child"), "done.s", "done.f")
    most = (counts.agg(F.max("_n")).first()[0] or 0) / FAN_IN
    level = 0
    while True:
        level += 1
        last = most <= FAN_IN
        # The children of a node are at most FAN_IN by number.
        grouped = rest.withColumn("node", F.expr(f"child div {FAN_IN}")).groupBy("source", "node") \
            .agg(F.sort_array(F.collect_list(F.struct("child", "s", "f"))).alias("items"))
        done = cut(grouped.withColumn("done", F.expr(_fold(level))))
        levels.append(done)
        rest = done.where("done.i >= 0").select("source", F.col("node").alias("child"), "done.s", "done.f")
        most /= FAN_IN
        if last:
            break
    draw = F.pmod(F.xxhash64(F.lit(SEED), F.lit(-1), "source"), F.lit(1 << 52)) / float(1 << 52)
    decided = rest.select("source", F.col("child").alias("node"), (draw < F.col("f")).cast("int").alias("bit"))
    for done in reversed(levels):
        decided = _resolve(done, decided, ["child"]).select("source", F.col("child").alias("node"), "bit")
    return _resolve(base, decided, [*payload, "s", "f"])


def _resolve(done: DataFrame, decided: DataFrame, payload: list[str]) -> DataFrame:
    """Bits of the items of ``done``; ``decided`` has the residuals' bits."""
    up = decided.select(F.col("source").alias("_s"), F.col("node").alias("_node"), F.col("bit").alias("_up"))
    rows = done.join(up, F.col("source").eqNullSafe(F.col("_s")) & (F.col("node") == F.col("_node")), "left")
    rows = rows.select("source", "done", "_up", F.posexplode("items").alias("nth", "item"))
    return rows.select("source", *[F.col(f"item.{c}") for c in payload],
                       F.coalesce(F.expr(_bit("nth")), F.col("_up")).alias("bit"))


def mix(docs: DataFrame, weights=WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, and
    its source and number of copies."""
    sized = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", word_count(F.col("text")).alias("size"))
                .groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("rows")))
    sizes = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"))
    goal = cut(targets(sizes, weights, most)).withColumnRenamed("source", "_src")
    asked = sized.join(goal, F.col("source").eqNullSafe(F.col("_src"))).drop("_src")
    asked = cut(asked.withColumn("_x", F.when(F.col("size") > 0, F.col("rows") * F.col("target") / F.col("source_size"))
                                 .otherwise(0.0))
                .withColumn("_whole", F.floor("_x")).withColumn("f", F.col("_x") - F.col("_whole"))
                .withColumn("s", F.col("size").cast("double")).drop("_x"))
    payload = ["doc_id", "size", "rows", "source_size", "target", "_whole"]
    rounded = round_fractions(asked.where("f > 0").select("source", "s", "f", *payload), payload)
    certain = asked.where("f = 0").select("source", *payload, F.lit(0).alias("bit"))
    both = rounded.select("source", *payload, "bit").unionByName(certain) \
        .withColumn("_copies", F.col("_whole") + F.col("bit"))
    each = both.select("*", F.explode(F.sequence(F.lit(1), F.col("rows"))).alias("nth"))
    copies = F.expr("_copies div rows") + (F.col("nth") <= F.col("_copies") % F.col("rows")).cast("long")
    return each.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), "source",
                       copies.alias("copies"))


KEYS = ["_id", "_src", "_words"]


def _shares(rows: DataFrame, copies: DataFrame) -> DataFrame:
    """``KEYS``, _told (hash of the text), n, c: the copies of the n rows of
    each text among the rows that share ``KEYS``. The copies of those go
    round by hash; ``copies`` has a row for each."""
    texts = rows.groupBy(*KEYS, "_told").agg(F.count(F.lit(1)).alias("n"))
    placed = running_sums(texts, {"before": F.col("n")}, KEYS, ["_told"], inclusive=False)
    side = copies.groupBy(F.col("doc_id").alias("_i"), F.col("source").alias("_s"), F.col("size").alias("_z")) \
        .agg(F.sum("copies").alias("_c"), F.count(F.lit(1)).alias("_r"))
    on = F.col("_id").eqNullSafe(F.col("_i")) & F.col("_src").eqNullSafe(F.col("_s")) & (F.col("_words") == F.col("_z"))
    # The first c % r rows take one more than the others.
    more = F.greatest(F.lit(0), F.least(F.col("n"), F.expr("_c % _r") - F.col("before")))
    return placed.join(side, on).select(*KEYS, "_told", "n", (F.col("n") * F.expr("_c div _r") + more).alias("c")).where("c > 0")


def mixed_rows(docs: DataFrame, weights=WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them; all columns stay.

    A row takes the copies decided for its doc_id, source and size; rows that
    agree in these (those without an id, say) are told apart by their texts,
    and rows of one text too are numbered.
    """
    keyed = docs.withColumns({"_id": F.col("doc_id").cast("long"), "_src": F.col("source"),
                              "_words": word_count(F.col("text")), "_told": F.xxhash64("text")})
    shares = cut(_shares(keyed.select(*KEYS, "_told"), mix(docs, weights, most)))
    side = shares.withColumnsRenamed({k: f"{k}_" for k in [*KEYS, "_told"]})
    on = F.col("_told") == F.col("_told_")
    for k in KEYS:
        on = on & F.col(k).eqNullSafe(F.col(f"{k}_"))
    alone = keyed.join(side.where("n = 1").hint("shuffle_hash"), on).withColumn("_copies", F.col("c"))
    # Usually no row: only rows that agree in everything so far are numbered.
    several = keyed.join(side.where("n > 1"), on)
    several = running_sums(several, {"_at": F.lit(1)}, [*KEYS, "_told"], [F.xxhash64(*docs.columns)], inclusive=False) \
        .withColumn("_copies", F.expr("c div n") + (F.col("_at") < F.expr("c % n")).cast("long"))
    both = alone.select(*docs.columns, "_copies").unionByName(several.select(*docs.columns, "_copies")).where("_copies > 0")
    return both.withColumn("_nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select(*docs.columns)
