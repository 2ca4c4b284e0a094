"""Process-control charts, fixed-size subgroups, capability and intraclass correlation over panels."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.shared import written

BASELINE = 8


def xmr_chart(series: DataFrame, key: str, order: str, value: str, baseline: int = BASELINE) -> DataFrame:
    """(key, order, value, mr, centre, lower, upper, range_limit): limits from the first `baseline` points, NULL with fewer."""
    w = Window.partitionBy(key).orderBy(order)
    moved = series.select(key, order, F.col(value).cast("double").alias("value"), F.row_number().over(w).alias("rn"), F.abs(F.col(value) - F.lag(value).over(w)).cast("double").alias("mr"))
    first = F.col("rn") <= baseline
    limits = moved.groupBy(key).agg(F.count("*").alias("n"), F.avg(F.when(first, F.col("value"))).alias("c"), F.median(F.when(first, F.col("mr"))).alias("m")).where(F.col("n") >= baseline)
    joined = moved.join(limits, key, "left")
    r = lambda c: F.round(c, 6)
    return joined.select(key, order, r(F.col("value")).alias("value"), r(F.col("mr")).alias("mr"), r(F.col("c")).alias("centre"), r(F.col("c") - 3.145 * F.col("m")).alias("lower"), r(F.col("c") + 3.145 * F.col("m")).alias("upper"), r(3.865 * F.col("m")).alias("range_limit"))


def xmr_signals(chart: DataFrame, key: str, order: str, run: int = 8) -> DataFrame:
    """The chart's points with `outside`, `range_signal` and `shift`: at least `run` points running on one side of the centre."""
    w = Window.partitionBy(key).orderBy(order)
    sided = chart.withColumn("side", F.signum(F.col("value") - F.col("centre")).cast("int"))
    sided = sided.withColumn("turn", F.sum(F.when(F.col("side") == F.lag("side").over(w), 0).otherwise(1)).over(w))
    sided = sided.withColumn("length", F.row_number().over(Window.partitionBy(key, "turn").orderBy(order)))
    return sided.select(key, order, "value", (~F.col("value").between(F.col("lower"), F.col("upper"))).alias("outside"), (F.col("mr") > F.col("range_limit")).alias("range_signal"), ((F.col("length") >= run) & (F.col("side") != 0)).alias("shift"))


def capability(chart: DataFrame, signals: DataFrame, key: str, low: float, high: float, floor: float, ceiling: float) -> DataFrame:
    """(key, in_control, in_specification, verdict); limits beyond the metric's whole range detect nothing."""
    control = signals.groupBy(key).agg((~F.bool_or(F.coalesce(F.col("outside") | F.col("range_signal") | F.col("shift"), F.lit(False)))).alias("in_control"))
    at = chart.groupBy(key).agg(F.max("centre").alias("centre"), F.max("lower").alias("lower"), F.max("upper").alias("upper"))
    joined = at.join(control, key).withColumn("in_specification", F.col("centre").between(low, high))
    blind = F.col("centre").isNull() | ((F.col("lower") <= floor) & (F.col("upper") >= ceiling))
    verdict = F.when(blind, "insufficient signal").when(F.col("in_control") & F.col("in_specification"), "ideal").when(F.col("in_control"), "threshold").when(F.col("in_specification"), "brink").otherwise("chaos")
    return joined.select(key, "in_control", "in_specification", verdict.alias("verdict"))


def subgroups(rows: DataFrame, key: list[str], order: list[str], size: int, value: str) -> DataFrame:
    """(key…, subgroup, n, mean): consecutive groups of `size` rows in a total order.

    Rows are range-sorted and numbered within their partition; what the partitions before hold of a key is added.  So a
    key of a third of all rows is the work of many tasks."""
    names = [*key, *order]
    split = written(rows.select(*dict.fromkeys([*names, value])).repartitionByRange(*names).sortWithinPartitions(*names).withColumn("_part", F.spark_partition_id()), "subgroups")
    within = F.row_number().over(Window.partitionBy("_part", *key).orderBy(*order))
    held = split.groupBy("_part", *key).agg(F.count("*").alias("_held"))
    before = held.withColumn("_before", F.sum("_held").over(Window.partitionBy(*key).orderBy("_part")) - F.col("_held")).drop("_held")
    same = F.col("a._part") == F.col("b._part")
    for k in key:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    numbered = split.withColumn("_n", within).alias("a").join(before.alias("b"), same)
    numbered = numbered.select(*(F.col(f"a.{k}").alias(k) for k in key), F.col(f"a.{value}").alias("_v"), F.floor((F.col("_n") + F.col("_before") - 1) / size).cast("long").alias("subgroup"))
    return numbered.groupBy(*key, "subgroup").agg(F.count("*").alias("n"), F.round(F.avg("_v"), 6).alias("mean"))


def icc_moment(panel: DataFrame, group: str, value: str) -> DataFrame:
    """(icc): between-variance of the groups' means over total, within by the mean population deviation of groups of two or more."""
    g = panel.groupBy(group).agg(F.avg(value).alias("m"), F.when(F.count(value) > 1, F.stddev_pop(value)).alias("s"))
    total = g.agg(F.pow(F.stddev_pop("m"), 2).alias("b"), F.pow(F.avg("s"), 2).alias("w"))
    return total.select(F.round(F.try_divide(F.col("b"), F.col("b") + F.col("w")), 6).alias("icc"))


def icc_anova(panel: DataFrame, group: str, value: str) -> DataFrame:
    """(icc, msb, msw) of the one-way random-effects analysis with the least group size as n."""
    g = panel.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v")).where("n > 0")
    grand = g.agg(F.try_divide(F.sum(F.col("n") * F.col("m")), F.sum("n")).alias("gm"))
    t = g.crossJoin(F.broadcast(grand)).agg(F.sum(F.col("n") * F.pow(F.col("m") - F.col("gm"), 2)).alias("ssb"), F.sum(F.col("n") * F.col("v")).alias("ssw"), F.count("*").alias("k"), F.sum("n").alias("total"), F.min("n").alias("least"))  # `grand` is one row
    t = t.select(F.try_divide(F.col("ssb"), F.col("k") - 1).alias("msb"), F.try_divide(F.col("ssw"), F.col("total") - F.col("k")).alias("msw"), "least")
    return t.select(F.round(F.try_divide(F.col("msb") - F.col("msw"), F.col("msb") + (F.col("least") - 1) * F.col("msw")), 6).alias("icc"), F.round(F.col("msb") / 1e6, 4).alias("msb_millions"), F.round(F.col("msw") / 1e6, 4).alias("msw_millions"))


def ranks(rows: DataFrame, key: str, value: str) -> DataFrame:
    """`rows` with `rank0`: how many values of the key are smaller."""
    return rows.withColumn("rank0", F.rank().over(Window.partitionBy(key).orderBy(value)) - 1)


def bootstrap(panel: DataFrame, group: str, value: str, draws: int = 4000, seed: int = 20260814) -> DataFrame:
    """(low, high, percentile): cluster bootstrap of the moment ICC, and the share of draws below the point estimate.

    Only the groups' means and deviations are resampled: draws times groups rows."""
    g = panel.groupBy(group).agg(F.avg(value).alias("m"), F.when(F.count(value) > 1, F.stddev_pop(value)).alias("s"))
    g = g.withColumn("i", F.row_number().over(Window.orderBy(group)) - 1)  # one row for each group of the panel
    k = g.agg(F.count("*").alias("k"))
    spark = panel.sparkSession
    picks = spark.range(draws).withColumnRenamed("id", "draw").crossJoin(k).withColumn("slot", F.explode(F.sequence(F.lit(1), F.col("k").cast("int"))))
    picks = picks.withColumn("i", F.pmod(F.xxhash64(F.lit(seed), "draw", "slot"), F.col("k")).cast("int"))
    each = picks.join(g.select("i", "m", "s"), "i").groupBy("draw").agg(F.pow(F.stddev_pop("m"), 2).alias("b"), F.pow(F.avg("s"), 2).alias("w")).select(F.try_divide(F.col("b"), F.col("b") + F.col("w")).alias("icc"))
    point = g.agg(F.pow(F.stddev_pop("m"), 2).alias("b"), F.pow(F.avg("s"), 2).alias("w")).select(F.try_divide(F.col("b"), F.col("b") + F.col("w")).alias("point"))
    return each.crossJoin(point).agg(F.round(F.percentile("icc", 0.025), 6).alias("low"), F.round(F.percentile("icc", 0.975), 6).alias("high"), F.round(100 * F.avg((F.col("icc") < F.col("point")).cast("int")), 6).alias("percentile"))


def _beta_share(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_share(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 / (1 - (a + b) * x / (a + 1))
    out = d
    for m in range(1, 10_000):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + step * d or tiny)
            c = 1 + step / c or tiny
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * out


def f_quantile(p: float, d1: float, d2: float) -> float:
    """The value that a share p of an F distribution of these degrees of freedom is below, by bisection."""
    low, high = 0.0, 1.0
    while _beta_share(d1 / 2, d2 / 2, d1 * high / (d1 * high + d2)) < p:
        low, high = high, high * 2
    for _ in range(200):
        mid = (low + high) / 2
        if _beta_share(d1 / 2, d2 / 2, d1 * mid / (d1 * mid + d2)) < p:
            low = mid
        else:
            high = mid
    return (low + high) / 2


def f_interval(panel: DataFrame, group: str, value: str, alpha: float = 0.05) -> DataFrame:
    """(low, high): the exact interval of the one-way ICC by quantiles of F; NULL with fewer than two groups or no spread.

    The driver gets five numbers and makes two quantiles of them."""
    g = panel.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v")).where("n > 0")
    grand = g.agg(F.try_divide(F.sum(F.col("n") * F.col("m")), F.sum("n")).alias("gm"))
    parts = g.crossJoin(F.broadcast(grand)).agg(F.sum(F.col("n") * F.pow(F.col("m") - F.col("gm"), 2)).alias("ssb"), F.sum(F.col("n") * F.col("v")).alias("ssw"), F.count("*").alias("k"), F.sum("n").alias("t"), F.min("n").alias("least"))  # `grand` is one row
    r = parts.first()
    low = high = None
    if r["k"] > 1 and r["t"] > r["k"] and r["ssw"] > 0:
        d1, d2 = r["k"] - 1, r["t"] - r["k"]
        ratio = (r["ssb"] / d1) / (r["ssw"] / d2)
        under, over = ratio / f_quantile(1 - alpha / 2, d1, d2), ratio * f_quantile(1 - alpha / 2, d2, d1)
        low, high = (round((x - 1) / (x + r["least"] - 1), 6) for x in (under, over))
    return panel.sparkSession.createDataFrame([(low, high)], "low double, high double")


def transformed(rows: DataFrame, value: str, how: str) -> DataFrame:
    """`rows` with `value` as it is, or the common logarithm of one more than it."""
    return rows if how == "raw" else rows.withColumn(value, F.log10(F.col(value) + 1))
