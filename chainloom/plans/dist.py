"""Exact order statistics of amounts, by group.

All of them read one table of distinct amounts with how many rows have each,
how many rows are smaller and what these sum to. Ranks are prefix sums in two
levels: within a bucket of near amounts, and over the few buckets of a group.
So no task sees a whole group, however many rows it has. Sums of products are
decimals; amounts are not negative.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bits of an amount that its bucket keeps: buckets of an octave.
BITS = 9
BIG = "decimal(38,0)"


def bucket_of(amount: Column, bits: int = BITS) -> Column:
    """A bucket that grows with the amount: its magnitude and leading bits."""
    shift = F.greatest(F.length(F.bin(amount)) - bits, F.lit(0))
    return shift.cast("long") * (1 << bits) + F.call_function("shiftright", amount, shift)


def ranked(df: DataFrame, keys: list[str], amount: str) -> DataFrame:
    """(keys, amount, n, before, sum_before) of each distinct amount, with count and total of its group. Nulls are left out."""
    freq = df.where(F.col(amount).isNotNull()).groupBy(*keys, F.col(amount).cast("long").alias("amount")).agg(F.count("*").alias("n"))
    freq = freq.withColumn("bucket", bucket_of(F.col("amount")))
    whole = F.col("amount").cast(BIG) * F.col("n")
    buckets = freq.groupBy(*keys, "bucket").agg(F.sum("n").alias("bn"), F.sum(whole).cast(BIG).alias("bs"))
    ordered = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*keys)
    offsets = buckets.select(
        *keys,
        "bucket",
        F.coalesce(F.sum("bn").over(ordered), F.lit(0)).alias("b_before"),
        F.coalesce(F.sum("bs").over(ordered), F.lit(0)).cast(BIG).alias("b_sum"),
        F.sum("bn").over(every).alias("count"),
        F.sum("bs").over(every).cast(BIG).alias("total"),
    )
    inner = Window.partitionBy(*keys, "bucket").orderBy("amount").rowsBetween(Window.unboundedPreceding, -1)
    local = freq.withColumns({"l_before": F.coalesce(F.sum("n").over(inner), F.lit(0)), "l_sum": F.coalesce(F.sum(whole).over(inner), F.lit(0)).cast(BIG)})
    return local.join(offsets, [*keys, "bucket"]).select(
        *keys, "amount", "n", (F.col("b_before") + F.col("l_before")).alias("before"), (F.col("b_sum") + F.col("l_sum")).cast(BIG).alias("sum_before"), "count", "total"
    )


def _rank(q: float) -> Column:
    """Nearest rank of a quantile: ceil(q * count), from 1 to count; the product is a double's."""
    return F.least(F.greatest(F.ceil(F.lit(q) * F.col("count").cast("double")), F.lit(1)), F.col("count")).cast("long")


def _at(rank: Column) -> Column:
    """The amount of a rank, among rows of one group."""
    return F.max(F.when((F.col("before") < rank) & (rank <= F.col("before") + F.col("n")), F.col("amount")))


def _lowest(k: Column) -> Column:
    """What the k smallest rows add up to."""
    return F.sum(F.col("amount").cast(BIG) * F.least(F.col("n"), F.greatest(k - F.col("before"), F.lit(0)))).cast(BIG)


def _highest(k: Column) -> Column:
    from_rank = F.col("count") - F.least(k, F.col("count"))
    return F.sum(F.col("amount").cast(BIG) * F.least(F.col("n"), F.greatest(F.col("before") + F.col("n") - from_rank, F.lit(0)))).cast(BIG)


def gini_parts(ranks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, count, total, gini_num): gini = gini_num / (count * total)."""
    return ranks.groupBy(*keys).agg(*_gini())


def _gini() -> list[Column]:
    term = F.col("amount").cast(BIG) * (F.col("n") * (2 * F.col("before") + F.col("n") - F.col("count"))).cast(BIG)
    return [F.max("count").alias("count"), F.max("total").alias("total"), F.sum(term.cast(BIG)).cast(BIG).alias("gini_num")]


def gini_of(num: Column, count: Column, total: Column) -> Column:
    """0 for fewer than two rows or no total."""
    whole = count.cast("double") * total.cast("double")
    return F.when((count < 2) | (total == 0), 0.0).otherwise(num.cast("double") / F.when(whole == 0, 1.0).otherwise(whole))


def order_stats(df: DataFrame, keys: list[str], amount: str) -> DataFrame:
    """(keys, count, total, mean, median, p90, p99, max, gini_num, gini); mean is rounded down."""
    ranks = ranked(df, keys, amount)
    quantiles = [_at(_rank(0.5)).alias("median"), _at(_rank(0.9)).alias("p90"), _at(_rank(0.99)).alias("p99"), F.max("amount").alias("max")]
    out = ranks.groupBy(*keys).agg(*_gini(), *quantiles)
    return out.select(*keys, "count", F.col("total").cast("long").alias("total"), F.expr("cast(total div count as bigint)").alias("mean"), "median", "p90", "p99", "max", "gini_num", gini_of(F.col("gini_num"), F.col("count"), F.col("total")).alias("gini"))


def top_n(df: DataFrame, keys: list[str], amount: str, sizes: list[int]) -> DataFrame:
    """(keys, k, n, top_total, total): what the k largest rows add up to; n is k or the rows there are."""
    ranks = ranked(df, keys, amount)
    ks = F.explode(F.array(*(F.lit(k).cast("long") for k in sizes))).alias("k")
    spread = ranks.select("*", ks)
    return spread.groupBy(*keys, "k").agg(F.least(F.max("count"), F.first("k")).alias("n"), _highest(F.col("k")).cast("long").alias("top_total"), F.max("total").cast("long").alias("total"))


def top_fraction(df: DataFrame, keys: list[str], amount: str, fractions: list[float]) -> DataFrame:
    """(keys, fraction, n, top_total, total): of the largest max(1, ceil(fraction * count)) rows."""
    spread = ranked(df, keys, amount).select("*", F.explode(F.array(*map(F.lit, fractions))).alias("fraction"))
    k = F.greatest(F.lit(1), F.ceil(F.col("fraction") * F.col("count").cast("double"))).cast("long")
    spread = spread.withColumn("k", k)
    return spread.groupBy(*keys, "fraction").agg(F.max("k").alias("n"), _highest(F.col("k")).cast("long").alias("top_total"), F.max("total").cast("long").alias("total"))


def tail_from(df: DataFrame, keys: list[str], amount: str, cuts: list[int]) -> DataFrame:
    """(keys, cut, tail_n, tail_total): rows of at least the cut; all cuts are there for each group."""
    cut = F.explode(F.array(*(F.lit(c).cast("long") for c in cuts))).alias("cut")
    inside = F.col("amount") >= F.col("cut")
    spread = df.select(*keys, F.col(amount).cast("long").alias("amount")).groupBy(*keys, "amount").agg(F.count("*").alias("n")).select("*", cut)
    return spread.groupBy(*keys, "cut").agg(F.sum(F.when(inside, F.col("n")).otherwise(0)).alias("tail_n"), F.sum(F.when(inside, F.col("amount") * F.col("n")).otherwise(0)).alias("tail_total"))


def lorenz(df: DataFrame, keys: list[str], amount: str, shares: list[float]) -> DataFrame:
    """(keys, share, k, low_total, total): what the k smallest rows hold, k = share * count rounded half to even, from 1 to count."""
    spread = ranked(df, keys, amount).select("*", F.explode(F.array(*map(F.lit, shares))).alias("share"))
    k = F.least(F.greatest(F.rint(F.col("share") * F.col("count").cast("double")), F.lit(1.0)).cast("long"), F.col("count"))
    spread = spread.withColumn("k", k)
    return spread.groupBy(*keys, "share").agg(F.max("k").alias("k"), _lowest(F.col("k")).cast("long").alias("low_total"), F.max("total").cast("long").alias("total"))


def level_histogram(df: DataFrame, keys: list[str], amount: str, edges: list[int]) -> DataFrame:
    """(keys, band, band_from, n, band_total): bands below, between and from the edges; all bands of each group are there."""
    lows = [0, *edges]
    x = F.col(amount)
    band = F.lit(0)
    for e in edges:
        band = band + F.when(x >= e, 1).otherwise(0)
    sums = df.groupBy(*keys).agg(*(F.struct(F.count(F.when(band == i, 1)).alias("n"), F.coalesce(F.sum(F.when(band == i, x)), F.lit(0)).cast("long").alias("s")).alias(f"b{i}") for i in range(len(lows))))
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("band"), F.lit(low).cast("long").alias("band_from"), F.col(f"b{i}.n").alias("n"), F.col(f"b{i}.s").alias("band_total")) for i, low in enumerate(lows))))
    return sums.select(*keys, each.alias("x")).select(*keys, "x.*")


def with_all(df: DataFrame, key: str, name: str = "ALL") -> DataFrame:
    """df with each row again under the group name."""
    return df.withColumn(key, F.explode(F.array(F.col(key), F.lit(name))))


def concentration(deltas: DataFrame, value: str, sizes: list[int]) -> DataFrame:
    """(count, total, gini_num, k, top_total): how unevenly the intervals share a total; k beyond the rows is left out."""
    g = gini_parts(ranked(deltas, [], value), [])
    top = top_n(deltas, [], value, sizes).where("k <= n").select("k", "top_total")
    return g.crossJoin(F.broadcast(top)).select("count", F.col("total").cast("long").alias("total"), "gini_num", "k", "top_total")
