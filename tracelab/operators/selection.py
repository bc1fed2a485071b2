"""Exact order statistics without a group in one task: the rows with the smallest digests of each group, and quantiles.

Both refine histograms. A pass counts rows by group and bucket, combined within tasks before they are shuffled, so that it moves a row for each group, bucket and task, whatever the
size of a group. It then looks on only into the buckets that hold a boundary. What is put in order at the end is a bucket of at most ``LEAF`` rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelab.sources.staging import staged

#: Rows that may be put in order in one task; hex digits of a digest, and bins of a range, in one pass.
LEAF, DIGITS, BINS = 4096, 3, 4096
#: Rows of a small side that are sent to all tasks.
SENT = 10_000
_ORDER = "_order"


def cuts(rows: DataFrame, groups: Sequence[str], wanted: DataFrame, leaf: int = LEAF) -> DataFrame:
    """rows: groups and ``_order``, a hex digest; wanted: a row for each group with _k, how many, and _n, how many there are. Adds ``_cut``, a prefix of digests, and ``_rest``: rows whose
    digest is below it are among the k smallest, and of those that begin with it the ``_rest`` smallest, which at most ``leaf`` rows do unless their digests are equal."""
    k = F.least(F.greatest(F.col("_k").cast("long"), F.lit(0)), F.col("_n").cast("long"))
    now = staged(wanted.select(*groups, F.lit("").alias("_cut"), k.alias("_rest"), F.col("_n").cast("long").alias("_n")), "cuts")
    wide = (F.col("_rest") > 0) & (F.col("_rest") < F.col("_n")) & (F.col("_n") > leaf) & (F.length("_cut") < 64)
    while not now.where(wide).isEmpty():
        open_ = now.where(wide).select(*groups, "_cut", "_rest")
        digit = F.substring(_ORDER, F.length("_cut") + 1, F.lit(DIGITS))
        own = _with(rows, open_, groups).where(F.col(_ORDER).startswith(F.col("_cut")))
        seen = own.groupBy(*groups, "_cut", "_rest", digit.alias("_d")).agg(F.count("*").alias("_m"))
        by = Window.partitionBy(*groups).orderBy("_d").rowsBetween(Window.unboundedPreceding, -1)  # at most 16 ** DIGITS rows
        before = seen.withColumn("_before", F.coalesce(F.sum("_m").over(by), F.lit(0)))
        at = before.where((F.col("_before") < F.col("_rest")) & (F.col("_rest") <= F.col("_before") + F.col("_m")))
        finer = at.select(*groups, F.concat("_cut", "_d").alias("_cut"), (F.col("_rest") - F.col("_before")).alias("_rest"), F.col("_m").alias("_n"))
        now = staged(now.where(~wide).unionByName(finer), "cuts")
    return now


def _with(rows: DataFrame, few: DataFrame, groups: Sequence[str]) -> DataFrame:
    """rows with the columns of few, a written table with some rows for each group; null is a group. It is sent to all tasks if it has at most ``SENT`` rows."""
    named = few.withColumnsRenamed({g: f"_of_{g}" for g in groups})
    same = [rows[g].eqNullSafe(named[f"_of_{g}"]) for g in groups]
    return rows.join(F.broadcast(named) if few.limit(SENT + 1).count() <= SENT else named, same).drop(*(f"_of_{g}" for g in groups))


def k_smallest(rows: DataFrame, groups: Sequence[str], wanted: DataFrame, order: Column, tie: str) -> DataFrame:
    """rows that are among the k smallest of their group by (order, tie); order: a hex digest; wanted: a row for each group with _k and _n, the group's size. Groups that it lacks have none.

    rows are read once for each pass and twice at the end: a written table, or a scan. A group may hold all rows: it is never in one task. Rows whose digests are equal, as those that repeat an id, are."""
    own = rows.withColumn(_ORDER, order)
    found = cuts(own.select(*groups, _ORDER), groups, wanted)
    joined = _with(own, found, groups)
    below = (F.col(_ORDER) < F.col("_cut")) | (F.col(_ORDER).startswith(F.col("_cut")) & (F.col("_rest") >= F.col("_n")))
    edge = F.col(_ORDER).startswith(F.col("_cut")) & (F.col("_rest") > 0) & (F.col("_rest") < F.col("_n"))
    within = Window.partitionBy(*groups).orderBy(_ORDER, tie)
    last = joined.where(edge).withColumn("_at", F.row_number().over(within)).where(F.col("_at") <= F.col("_rest"))
    return joined.where(below).select(*rows.columns).unionByName(last.select(*rows.columns))


def quantiles(df: DataFrame, value: Column, shares: Sequence[float], *groups: str, leaf: int = LEAF) -> DataFrame:
    """Of each group: ``n`` (values that aren't null), ``min``, ``max``, ``sum`` and ``quantiles``, an array with one for each share, between neighbours in proportion.

    Values are doubles, NaN the largest of all. Buckets of one value or of at most ``leaf`` rows are read off; others are cut into ``BINS`` bins between their least and largest value and
    counted again, where an order statistic lies in them. Without values n is 0 and the rest null."""
    keys = list(groups) or ["_all"]
    own = staged(df.select(*(groups or [F.lit(0).alias("_all")]), value.cast("double").alias("_v")), "quantiles-values")  # read in every pass
    size = own.groupBy(*groups).agg(F.count("_v").alias("n"), F.min("_v").alias("min"), F.max("_v").alias("max"), F.sum("_v").alias("sum"), *_range())
    size = staged(size if groups else size.withColumn("_all", F.lit(0)), "quantiles-groups")
    place = lambda s: (F.col("n") - 1) * F.lit(float(s))
    ranks = F.array_distinct(F.flatten(F.array(*(F.array(F.floor(place(s)), F.ceil(place(s))) for s in shares))))
    # a target: which place (from 0) is wanted, and the bucket that it lies in: its range, rows before it and rows in it
    now = size.where("n > 0").select(*keys, F.explode(ranks).alias("_rank"), F.col("_low"), F.col("_high"), F.lit(0).cast("long").alias("_before"), F.col("n").alias("_n"), F.col("_finite"))
    found: DataFrame | None = None
    while True:
        now = staged(now, "quantiles-targets")
        done = now.where("_low <=> _high").select(*keys, "_rank", F.col("_low").alias("_x"))
        small = now.where(f"NOT _low <=> _high AND _n <= {leaf}")
        ready = done.unionByName(_read_off(own, small, keys)) if not small.isEmpty() else done
        found = ready if found is None else found.unionByName(ready)
        now = now.where(f"NOT _low <=> _high AND _n > {leaf}")
        if now.isEmpty():
            break
        now = _refined(own, now, keys)
    held = found.groupBy(*keys).agg(F.map_from_entries(F.collect_set(F.struct("_rank", "_x"))).alias("_m")).withColumnsRenamed({g: f"_of_{g}" for g in keys})  # two entries for each share
    at = size.select(*keys, "n", "min", "max", "sum").join(held, [F.col(g).eqNullSafe(F.col(f"_of_{g}")) for g in keys], "left")
    between = [F.try_element_at("_m", F.floor(place(s))) for s in shares], [F.try_element_at("_m", F.ceil(place(s))) for s in shares]
    mixed = [F.when(a == b, a).otherwise((F.ceil(place(s)) - place(s)) * a + (place(s) - F.floor(place(s))) * b) for s, a, b in zip(shares, *between, strict=True)]
    out = at.select(*groups, "n", "min", "max", "sum", F.array(*mixed).alias("quantiles"))
    return out


def _range() -> list[Column]:
    """The least and largest value, and whether all are finite."""
    v = F.col("_v")
    return [F.min(v).alias("_low"), F.max(v).alias("_high"), F.min(F.coalesce(F.abs(v) < float("inf"), F.lit(True))).alias("_finite")]


def _in_bucket(own: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    buckets = targets.select(*keys, "_low", "_high", "_finite").distinct()
    return _with(own, staged(buckets, "buckets"), keys).where((F.col("_v") >= F.col("_low")) & (F.col("_v") <= F.col("_high")))


def _read_off(own: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """The values at targets whose buckets are small."""
    held = staged(_in_bucket(own, targets, keys).groupBy(*keys, "_low", "_high").agg(F.array_sort(F.collect_list("_v")).alias("_values")), "quantiles-small")
    return _with(targets, held, [*keys, "_low", "_high"]).select(*keys, "_rank", F.get("_values", (F.col("_rank") - F.col("_before")).cast("int")).alias("_x"))


def _refined(own: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """The targets' buckets a pass later. Infinite values and NaN have bins of their own, so that what lies between has a width."""
    v, low, high = F.col("_v"), F.col("_low"), F.col("_high")
    wide = F.try_divide(v / 2 - low / 2, high / 2 - low / 2)  # halves, as a difference may be beyond doubles
    bin_ = F.when(F.col("_finite"), F.coalesce(F.floor(wide * (BINS - 1)), (v > low).cast("long"))).when(F.isnan(v), 2).when(v == float("inf"), 1).when(v == -float("inf"), -1).otherwise(0)
    seen = _in_bucket(own, targets, keys).groupBy(*keys, "_low", "_high", bin_.cast("long").alias("_bin")).agg(F.count("*").alias("_m"), F.min(v).alias("_a"), F.max(v).alias("_b"), F.min(F.coalesce(F.abs(v) < float("inf"), F.lit(True))).alias("_f"))
    by = Window.partitionBy(*keys, "_low", "_high").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)  # at most BINS rows
    before = staged(seen.withColumn("_sum", F.coalesce(F.sum("_m").over(by), F.lit(0))), "quantiles-bins")
    at = _with(targets.drop("_finite", "_n"), before, [*keys, "_low", "_high"])
    offset = F.col("_rank") - F.col("_before")
    mine = at.where((offset >= F.col("_sum")) & (offset < F.col("_sum") + F.col("_m")))
    return mine.select(*keys, "_rank", F.col("_a").alias("_low"), F.col("_b").alias("_high"), (F.col("_before") + F.col("_sum")).alias("_before"), F.col("_m").alias("_n"), F.col("_f").alias("_finite"))


def smallest_share(rows: DataFrame, groups: Sequence[str], share: float, order: Column, tie: str) -> DataFrame:
    """Of each group the share of rows with the smallest digests, rounded half to even, one at least."""
    sizes = rows.groupBy(*groups).agg(F.count("*").alias("_n"))
    return k_smallest(rows, groups, sizes.withColumn("_k", F.greatest(F.lit(1), F.rint(F.col("_n") * F.lit(share)))), order, tie)
