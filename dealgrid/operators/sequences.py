"""Ordered histories and as-of joins that stay balanced when one key holds much of the data.

A plain `lag` over a key puts the whole key into one task. Here a key with very many rows is cut into buckets along its order: the
window runs inside (key, bucket), and the rows at a bucket's borders are handed to its neighbours.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Begins every stand-in for a null key.
NO_KEY = "\u0001"

# A key with more rows is cut along its order; at most so many keys are.
HOT_ROWS = 1 << 17
MOST_HOT = 1_000


def spread_nulls(key: Column, *by: str) -> Column:
    """A join key whose nulls spread over the partitions by other columns instead of meeting in one.

    The stand-ins start with a control character, so they match nothing.
    """
    part = F.pmod(F.xxhash64(*by), F.lit(997)).cast("string")
    return F.coalesce(key.cast("string"), F.concat(F.lit(NO_KEY), part))


def ordered_history(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    prev: Mapping[str, str | tuple[str, int]] | None = None,
    following: Mapping[str, str] | None = None,
    number: str | None = None,
) -> DataFrame:
    """Add values of rows before (`prev`, a column or a column and how many rows back), of the row after, and the row number within each key.

    `order` must be unique within a key and without nulls, and `bucket` must grow with it (a prefix
    of the order does); dates are taken by month. Keys of more than HOT_ROWS rows, the MOST_HOT largest of them, are cut into their buckets, all
    other keys are one window each; what is cut changes the balance and not the result. A null key is a key like others. A bucket of a hot key gets its neighbours' border rows as rows of its own, so
    one exchange by key and bucket does and nothing is joined back. No job runs before the action.
    """
    back = {new: (c, 1) if isinstance(c, str) else c for new, c in (prev or {}).items()}
    following = dict(following or {})
    if df.select(bucket.alias("_b")).schema["_b"].dataType.typeName() == "date":
        bucket = F.trunc(bucket, "month")
    # A border row also tells a bucket how many rows lie before it.
    depth = max([k for _, k in back.values()] + [1] * bool(number), default=0)

    # Frequent keys from one sketch over the keys' hashes; a key that only shares a hot key's hash is cut too, which does no harm.
    often = df.select(F.xxhash64(*keys).alias("_hist_key")).agg(F.expr(f"approx_top_k(_hist_key, {MOST_HOT}, {10 * MOST_HOT})").alias("_hist_top"))
    hot = often.select(F.transform(F.filter("_hist_top", lambda x: x["count"] > HOT_ROWS), lambda x: x["item"]).alias("_hist_hot")).scalar()
    cut = df.withColumn("_hist_bucket", F.when(F.array_contains(hot, F.xxhash64(*keys)), bucket))

    needed = list(dict.fromkeys([*order, *(c for c, _ in back.values()), *following.values()]))
    parts = [*keys, "_hist_bucket"]
    rows = cut.filter(F.col("_hist_bucket").isNotNull())
    last = Window.partitionBy(*parts).orderBy(*[F.col(c).desc() for c in order])
    near_end = rows.select(*parts, F.struct(*needed).alias("_hist_row"), F.row_number().over(last).alias("_hist_at"))
    marks = near_end.groupBy(*parts).agg(
        F.count(F.lit(1)).alias("_hist_n"), F.min("_hist_row").alias("_hist_first"),
        F.array_sort(F.collect_list(F.when(F.col("_hist_at") <= depth, F.col("_hist_row")))).alias("_hist_last"),
    )
    outer = Window.partitionBy(*keys).orderBy("_hist_bucket")
    none = F.slice("_hist_last", 1, 0)
    before = F.flatten(F.array(*[F.coalesce(F.lag("_hist_last", k).over(outer), none) for k in range(depth, 0, -1)])) if depth else none
    marks = marks.withColumns({"_hist_past": before, "_hist_next": F.lead("_hist_first").over(outer), "_hist_offset": F.sum("_hist_n").over(outer) - F.col("_hist_n")})
    past = F.slice("_hist_past", -F.least(F.size("_hist_past"), F.lit(max(depth, 1))), F.lit(max(depth, 1)))
    past = F.when(F.size("_hist_past") > 0, past).otherwise(F.col("_hist_past"))
    after = F.array_compact(F.array("_hist_next")) if following else none
    ghost = lambda side: lambda r: F.struct(r.alias("r"), F.lit(side).alias("side"))
    ghosts = marks.select(*parts, "_hist_offset", F.explode(F.concat(F.transform(past, ghost(-1)), F.transform(after, ghost(1)))).alias("_hist_g"))
    ghosts = ghosts.select(*parts, "_hist_offset", F.col("_hist_g.side").alias("_hist_side"), *[F.col("_hist_g.r")[c].alias(c) for c in needed if c not in keys])
    both = cut.withColumn("_hist_side", F.lit(0)).unionByName(ghosts, allowMissingColumns=True)

    inner = Window.partitionBy(*parts).orderBy(*order)
    near = {new: F.lag(c, k).over(inner) for new, (c, k) in back.items()}
    near |= {new: F.lead(c).over(inner) for new, c in following.items()}
    if number:
        whole = Window.partitionBy(*parts)
        ahead = F.count_if(F.col("_hist_side") < 0).over(whole)
        near[number] = F.row_number().over(inner) - ahead + F.coalesce(F.max("_hist_offset").over(whole), F.lit(0))
    return both.withColumns(near).filter(F.col("_hist_side") == 0).select(*df.columns, *near)


def asof_by_day(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_day: str,
    right_day: str,
    value: Column,
    name: str,
    strict: bool = False,
    forward: bool = False,
) -> DataFrame:
    """Attach the newest `value` of the right side on or before each left day (or after it).

    Both sides shrink to one row per key and day before the window, so a key never holds more rows
    than there are days; the result joins back on key and day. `value` must order ties on one day.
    """
    pick = F.min(value) if forward else F.max(value)
    points = right.groupBy(*keys, F.col(right_day).alias("_day")).agg(pick.alias("_value"))
    asked = left.filter(F.col(left_day).isNotNull()).select(*keys, F.col(left_day).alias("_day")).distinct()
    # With strict bounds a left point must not see a value of its own day.
    left_rank = 0 if strict != forward else 1
    line = points.withColumn("_rank", F.lit(1 - left_rank)).unionByName(
        asked.withColumn("_rank", F.lit(left_rank)), allowMissingColumns=True
    )
    w = Window.partitionBy(*keys).orderBy("_day", "_rank")
    if forward:
        seen = F.first("_value", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    else:
        seen = F.last("_value", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    found = line.withColumn(name, seen).filter(F.col("_rank") == left_rank).select(*keys, "_day", name)
    return left.join(found.withColumnRenamed("_day", left_day), [*keys, left_day], "left")


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int | None, rank: str = "rank") -> DataFrame:
    """The first `k` rows of each key, all of them without a `k`. Spark cuts each task's rows to `k` per key before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn(rank, F.row_number().over(w))
    return ranked if k is None else ranked.filter(F.col(rank) <= k)
