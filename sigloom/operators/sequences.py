"""Scans over the rows of a key in time order, in two levels, for keys with any share of the rows.

Times are cut into buckets that hold about as many rows each (a count, and quantiles of all rows'
times where there are more than fit into one).  A bucket of a key is summarised to a state by a partial aggregation, the states
of a key's buckets are scanned, and each bucket starts from the state that reaches it.  So a key
with nearly all rows is the work of many tasks, and what meets in one task for a key is one
state a bucket.  A single bucket needs no states: then a scan is one window.

Rows of a key at one and the same microsecond stay together.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS = 1 << 20  # of a bucket, all keys together
SPLIT_BITS = 12  # 4096 buckets at most
FOREVER = (1 << 63) - 1


def splits(rows: DataFrame, us: str = "us", size: int | None = None) -> list[int]:
    """Ascending times between buckets of about `size` rows; none where all fit into one."""
    times = rows.select(us)
    many = min(1 << SPLIT_BITS, math.ceil(times.filter(F.col(us).isNotNull()).count() / (size or ROWS)))
    if many < 2:
        return []
    return sorted(set(times.agg(F.percentile_approx(us, [i / many for i in range(1, many)], 4 * many)).first()[0]))


def bucket(us: Column, edges: list[int]) -> Column:
    """Number of edges at or before a time, by binary search."""
    if not edges:
        return F.lit(0)
    bits = len(edges).bit_length()
    at = F.array(*[F.lit(e) for e in edges], *[F.lit(FOREVER)] * ((1 << bits) - 1 - len(edges)))
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(bits))])
    return F.aggregate(steps, F.lit(0), lambda i, step: i + F.when(F.get(at, i + step - 1) <= us, step).otherwise(0))


def bucketed(rows: DataFrame, edges: list[int]) -> DataFrame:
    return rows.withColumn("bucket", bucket(F.col("us"), edges))


def _states(rows: DataFrame, key: list[str], values: dict[str, Column], ahead: bool) -> DataFrame:
    """What reaches each bucket of a key: the largest value of earlier buckets, or the smallest of later ones."""
    best, order = (F.min, F.desc("bucket")) if ahead else (F.max, F.asc("bucket"))
    local = rows.groupBy(*key, "bucket").agg(*[best(v).alias(f"in_{name}") for name, v in values.items()])
    over = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return local.select(*key, "bucket", *[best(f"in_{name}").over(over).alias(f"in_{name}") for name in values])


def _joined(rows: DataFrame, states: DataFrame, key: list[str]) -> DataFrame:
    """States at their buckets; keys may be null."""
    own = [F.col(c).alias(f"of_{c}") for c in (*key, "bucket")]
    other = states.select(*own, *[c for c in states.columns if c.startswith("in_")])
    same = F.lit(True)
    for c in (*key, "bucket"):
        same = same & F.col(c).eqNullSafe(F.col(f"of_{c}"))
    return rows.join(other, same, "left").drop(*[f"of_{c}" for c in (*key, "bucket")])


def running(rows: DataFrame, key: list[str], values: dict[str, Column], edges: list[int], ahead: bool = False) -> DataFrame:
    """Rows with the running maximum of each value in order of (us, event_id), the row's own included; nulls do not count.

    Of values that rise with the order this is the last one.  ahead: the minimum over the rows behind a row instead,
    which is the next one.  rows: bucketed()."""
    # backwards for the rows behind: a frame that ends at unboundedFollowing is added up anew for each row
    order = (F.desc("us"), F.desc("event_id")) if ahead else ("us", "event_id")
    over = Window.partitionBy(*key, "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if ahead else 0)
    best, of_both = (F.min, F.least) if ahead else (F.max, F.greatest)
    if not edges:
        return rows.withColumns({name: best(v).over(over) for name, v in values.items()})
    made = _joined(rows, _states(rows, key, values, ahead), key)
    return made.withColumns({name: of_both(best(v).over(over), F.col(f"in_{name}")) for name, v in values.items()}).drop(*[f"in_{name}" for name in values])


def lagged(rows: DataFrame, key: list[str], many: int, edges: list[int]) -> DataFrame:
    """Rows with `place` (in their bucket), `back` (time of the row `many` rows before, or null) and `tail`:
    the last many + 1 times before the bucket, in order.  rows: bucketed()."""
    order = Window.partitionBy(*key, "bucket").orderBy("us", "event_id")
    if not edges:
        return rows.withColumns({"place": F.row_number().over(order), "back": F.lag("us", many).over(order), "tail": F.array().cast("array<bigint>")})
    last = Window.partitionBy(*key, "bucket").orderBy(F.desc("us"))
    ends = rows.select(*key, "bucket", "us").withColumn("from_end", F.row_number().over(last)).filter(F.col("from_end") <= many + 1)
    ends = ends.groupBy(*key, "bucket").agg(F.array_sort(F.collect_list("us")).alias("ends"))
    # a bucket with rows has one at least, so many + 1 buckets before have all that is needed
    before = Window.partitionBy(*key).orderBy("bucket").rowsBetween(-(many + 1), -1)
    tail = F.flatten(F.collect_list("ends").over(before))
    states = ends.select(*key, "bucket", F.slice(tail, F.greatest(F.size(tail) - many, F.lit(1)), many + 1).alias("in_tail"))
    made = _joined(rows, states, key).withColumn("tail", F.coalesce("in_tail", F.array().cast("array<bigint>"))).withColumn("place", F.row_number().over(order))
    at = F.size("tail") - many + F.col("place") - 1
    back = F.when(F.col("place") > many, F.lag("us", many).over(order)).when(at >= 0, F.get("tail", at))
    return made.withColumn("back", back).drop("in_tail")
