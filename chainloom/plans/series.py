"""Series by height or by time: deltas, grids, windows, as-of joins, gap filling.

A series by height has a row for each block, a bounded number that one ordered
window can take. What joins by time can be as long as the ledger, and goes in
two levels: within a bucket of time, and over the buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400


def last_line(curve: DataFrame, height: str = "height", line: str = "line") -> DataFrame:
    """Of several lines of a height the last."""
    own = Window.partitionBy(height).orderBy(F.col(line).desc())
    return curve.withColumn("__k", F.row_number().over(own)).where("__k = 1").drop("__k")


def deltas(curve: DataFrame, columns: list[str], height: str = "height") -> DataFrame:
    """(from_height, to_height, columns): each row less the one before, the first less zero; a fall stops the query."""
    ordered = Window.orderBy(height)
    step = lambda c: F.col(c) - F.lag(c, 1, 0).over(ordered)
    rows = curve.select(F.lag(height, 1, 0).over(ordered).alias("from_height"), F.col(height).alias("to_height"), *(step(c).alias(c) for c in columns))
    return rows.select("from_height", "to_height", *(F.when(F.col(c) >= 0, F.col(c)).otherwise(F.raise_error(F.lit(f"{c} falls"))).alias(c) for c in columns))


def grid(first: int, last: int, every: int, spark) -> DataFrame:
    """(window_no, height): ends of windows of so many heights from first; the last one ends at last."""
    rows = spark.range((first - 1) // every, (last - 1) // every + 1).withColumnRenamed("id", "window_no")
    return rows.select("window_no", F.least((F.col("window_no") + 1) * every, F.lit(last)).alias("height"))


def window_counts(events: DataFrame, kinds: list[str], every: int, last: int, height: str = "height", kind: str = "kind") -> DataFrame:
    """(height, a column of each kind, total): events of each window; windows without any are there too."""
    no = F.floor((F.col(height) - 1) / every)
    counts = events.groupBy(no.alias("window_no")).agg(*(F.count(F.when(F.col(kind) == k, 1)).alias(k) for k in kinds))
    out = grid(1, last, every, events.sparkSession).join(counts, "window_no", "left")
    zero = [F.coalesce(k, F.lit(0)).alias(k) for k in kinds]
    return out.select("height", *zero, sum((F.coalesce(k, F.lit(0)) for k in kinds[1:]), F.coalesce(kinds[0], F.lit(0))).alias("total"))


def cumulative(events: DataFrame, kinds: list[str], value: str, every: int, last: int, height: str = "height", kind: str = "kind") -> DataFrame:
    """(height, kind_hits, kind_sats ...): running totals of events at the ends of all windows."""
    no = F.floor((F.col(height) - 1) / every)
    sums = events.groupBy(no.alias("window_no")).agg(
        *(F.count(F.when(F.col(kind) == k, 1)).alias(f"{k}_hits") for k in kinds), *(F.coalesce(F.sum(F.when(F.col(kind) == k, F.col(value))), F.lit(0)).cast("long").alias(f"{k}_sats") for k in kinds)
    )
    names = [f"{k}_{x}" for k in kinds for x in ("hits", "sats")]
    up = Window.orderBy("window_no").rowsBetween(Window.unboundedPreceding, 0)
    out = grid(1, last, every, events.sparkSession).join(sums, "window_no", "left")
    return out.select("height", *(F.sum(F.coalesce(c, F.lit(0))).over(up).alias(c) for c in names))


def median_time_past(headers: DataFrame, height: str = "height", time: str = "time", span: int = 11) -> DataFrame:
    """headers with median_time: of the last span times, the upper of the middle ones.

    Heights follow one another. A bucket of them is a partition of its own,
    which is also given the span - 1 headers before it.
    """
    size, here = 1 << 14, F.expr(f"{height} div {1 << 14}")
    shared = F.when(F.pmod(F.col(height), F.lit(size)) > size - span, F.array(here, here + 1)).otherwise(F.array(here))
    own = Window.partitionBy("__bucket").orderBy(height).rowsBetween(-(span - 1), 0)
    times = F.sort_array(F.collect_list(time).over(own))
    rows = headers.withColumn("__bucket", F.explode(shared)).withColumn("median_time", F.element_at(times, (F.floor(F.size(times) / 2) + 1).cast("int")))
    return rows.where(F.col("__bucket") == here).drop("__bucket")


def asof(left: DataFrame, right: DataFrame, left_time: str, right_time: str, value: str, stale_after: int, out: str = "price", bucket: int = DAY) -> DataFrame:
    """left with out: the value of the last row of right at or before its time, if it is no older than stale_after.

    Times are integers. Of rows of right with one time the smallest value
    counts. Rows without a time, and those before any value, get null.
    """
    columns = left.columns
    points = right.where(F.col(right_time).isNotNull() & F.col(value).isNotNull()).groupBy(F.col(right_time).alias("__t")).agg(F.min(value).alias("__v"))
    found = F.struct(F.col("__t").alias("t"), F.col("__v").alias("v"))
    asked = left.select("*", F.col(left_time).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(points.schema["__v"].dataType).alias("__v"))
    given = points.select(*(F.lit(None).cast(left.schema[c].dataType).alias(c) for c in columns), "__t", F.lit(0).alias("__side"), "__v")
    rows = asked.unionByName(given).withColumn("__b", F.floor(F.col("__t") / bucket))
    within = Window.partitionBy("__b").orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__p", F.last(F.when(F.col("__side") == 0, found), ignorenulls=True).over(within))
    # what a bucket takes over from those before it: a row for each bucket of right
    last = points.groupBy(F.floor(F.col("__t") / bucket).alias("__b")).agg(F.max(found).alias("__last"))
    buckets = rows.where("__side = 1").select("__b").distinct().withColumn("__last", F.lit(None).cast(last.schema["__last"].dataType)).unionByName(last)
    carry = buckets.groupBy("__b").agg(F.max("__last").alias("__last")).withColumn("__carry", F.last("__last", ignorenulls=True).over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.where("__side = 1").join(carry.select("__b", "__carry"), "__b", "left").withColumn("__p", F.coalesce("__p", "__carry"))
    fresh = F.when(F.col("__t") - F.col("__p.t") <= stale_after, F.col("__p.v"))
    return rows.select(*columns, fresh.alias(out))


def asof_first(left: DataFrame, series: list[tuple[DataFrame, int]], left_time: str, right_time: str, value: str) -> DataFrame:
    """left with price and series: the first of several series, in order, that answers; series counts from 1, 0 for none."""
    for i, (right, stale) in enumerate(series):
        left = asof(left, right, left_time, right_time, value, stale, out=f"__p{i}")
    prices = [F.col(f"__p{i}") for i in range(len(series))]
    which = F.coalesce(*(F.when(p.isNotNull(), i + 1) for i, p in enumerate(prices)), F.lit(0))
    return left.withColumns({"price": F.coalesce(*prices), "series": which}).drop(*(f"__p{i}" for i in range(len(series))))


def daily(blocks: DataFrame, time: str = "time", price: str = "price", series: str = "series") -> DataFrame:
    """(date, blocks, price, kind, gap_days, price_min, price_max, series), a row for each day from the first to the last block.

    measured: the mean of the day's priced blocks; carried: that of the last
    measured day, gap_days ago; none: before any.
    """
    day = F.floor(F.col(time) / DAY)
    p = F.col(price).cast("decimal(20,6)")
    days = blocks.groupBy(day.alias("day")).agg(F.count("*").alias("blocks"), F.sum(p).alias("s"), F.count(p).alias("k"), F.min(p).alias("price_min"), F.max(p).alias("price_max"), F.array_join(F.sort_array(F.collect_set(F.when(p.isNotNull(), F.col(series)))), "+").alias("names"))
    ends = days.agg(F.min("day").alias("a"), F.max("day").alias("b"))
    calendar = ends.where("a is not null").select(F.explode(F.sequence("a", "b")).alias("day"))
    up = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    mean = F.when(F.col("k") > 0, (F.col("s") / F.col("k")).cast("decimal(24,10)"))
    rows = calendar.join(days, "day", "left").withColumn("mean", mean)
    held = F.last(F.when(F.col("mean").isNotNull(), F.struct("day", "mean")), ignorenulls=True).over(up)
    rows = rows.withColumn("held", held)
    kind = F.when(F.col("mean").isNotNull(), "measured").when(F.col("held").isNotNull(), "carried").otherwise("none")
    return rows.select(
        F.date_format(F.timestamp_seconds(F.col("day") * DAY), "yyyy-MM-dd").alias("date"),
        F.coalesce("blocks", F.lit(0)).alias("blocks"),
        F.col("held.mean").alias("price"),
        kind.alias("kind"),
        (F.col("day") - F.col("held.day")).alias("gap_days"),
        "price_min",
        "price_max",
        F.when(F.col("mean").isNotNull(), F.col("names")).otherwise("").alias("series"),
    )


def rewritten(old: DataFrame, new: DataFrame, columns: list[str], height: str = "height") -> DataFrame:
    """(changed_heights): heights that both have, with another value."""
    a, b = old.select(height, F.struct(*columns).alias("a")), new.select(height, F.struct(*columns).alias("b"))
    return a.join(b, height).agg(F.count(F.when(~F.col("a").eqNullSafe(F.col("b")), 1)).alias("changed_heights"))


def in_order(df: DataFrame, columns: list[str], strict: bool, block: str | None = None) -> DataFrame:
    """(violations): rows that don't follow the row before in the order of the table's column line.

    block, a column that grows with line, makes it two levels: rows within a
    block, and the first row of each block after the last of the block before.
    """
    values = F.struct(*columns)

    def count(rows: DataFrame, now: Column, before: Column) -> DataFrame:
        bad = before.isNotNull() & ((now <= before) if strict else (now < before))
        return rows.select(bad.alias("bad")).agg(F.count(F.when(F.col("bad"), 1)).alias("violations"))

    if block is None:
        return count(df, values, F.lag(values).over(Window.partitionBy().orderBy("line")))
    inside = count(df, values, F.lag(values).over(Window.partitionBy(block).orderBy("line")))
    ends = df.groupBy(block).agg(F.min_by(values, "line").alias("first"), F.max_by(values, "line").alias("last"))
    across = count(ends, F.col("first"), F.lag("last").over(Window.orderBy(block)))
    return inside.unionByName(across).agg(F.sum("violations").alias("violations"))


def lengths(offsets: DataFrame, order: str, offset: str, end: Column) -> DataFrame:
    """offsets with length: up to the next offset, or to end."""
    return offsets.withColumn("length", F.coalesce(F.lead(offset).over(Window.orderBy(order)), end) - F.col(offset))
