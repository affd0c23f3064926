"""Column expressions of the valuation: decay, trend, hazard, buckets, robust statistics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partlens.config import CONFIG, Config


def age_months(date: str | Column, ref: str | Column, cfg: Config = CONFIG) -> Column:
    """Months between a date and the reference date; an unknown date counts as one half-life."""
    return F.coalesce(F.greatest(F.lit(0.0), F.datediff(ref, date) / cfg.days_per_month), F.lit(cfg.half_life_months))


def decay_weight(age: str | Column, cfg: Config = CONFIG) -> Column:
    return F.exp(-cfg.decay * F.col(age) if isinstance(age, str) else -cfg.decay * age)


def decayed_mean(price: str, volume: str, weight: str) -> Column:
    w, v, p = F.col(weight), F.col(volume), F.col(price)
    return F.try_divide(F.sum(w * v * p), F.sum(w * v))


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def with_pct_rank(df: DataFrame, value: str, group: str, name: str, least: int = 3) -> DataFrame:
    """df with ``name``: the rank share of value with ties averaged, in its group if that has ``least`` known values, else over all;
    unknown values have 0.5.

    Within groups by a window. Over all, equal values are counted first and a running sum goes over the distinct values alone, whose
    ranges are summed apart, so no task sees all rows; and only rows of small groups look themselves up.
    """
    known = F.col(value).isNotNull()
    own = Window.partitionBy(group, known)
    ties = F.count("*").over(Window.partitionBy(group, value))
    share = (F.rank().over(own.orderBy(value)) + (ties - 1) / 2) / F.count("*").over(own)
    x = df.withColumns({"__n": F.count(value).over(Window.partitionBy(group)), "__own": F.when(known, share)})
    counts = df.where(known).groupBy(value).agg(F.count("*").alias("__t"))
    # a value's range by the leading digits of its rank order: the sum of a range, then of the values before it in the range
    cut = F.floor(F.log(2.0, F.abs(F.col(value)) + 1) * 8) * F.signum(F.col(value))
    ranged = counts.withColumn("__cut", cut)
    totals = ranged.groupBy("__cut").agg(F.sum("__t").alias("__all"))  # some hundred ranges, whatever the rows
    before = totals.select("__cut", (F.sum("__all").over(Window.orderBy("__cut")) - F.col("__all")).alias("__before"), F.sum("__all").over(Window.partitionBy()).alias("__total"))
    inside = F.sum("__t").over(Window.partitionBy("__cut").orderBy(value))
    over_all = ranged.withColumn("__inside", inside).join(before, "__cut").select(F.col(value).alias("__v"), ((F.col("__before") + F.col("__inside") - F.col("__t") + 1 + (F.col("__t") - 1) / 2) / F.col("__total")).alias("__share"))
    y = x.join(over_all, F.when(F.col("__n") < least, F.col(value)) == F.col("__v"), "left")
    rank = F.when(F.col("__n") >= least, F.col("__own")).otherwise(F.col("__share"))
    return y.withColumn(name, F.coalesce(rank, F.lit(0.5))).drop("__n", "__own", "__v", "__share")


def effective_window(months: Column, cfg: Config = CONFIG) -> Column:
    """Months that decayed observations of so many months stand for, one at least."""
    return F.greatest(F.lit(1.0), (1 - F.exp(-cfg.decay * months)) / cfg.decay)


def trend_adjusted(rate: Column, growth: Column, cfg: Config = CONFIG) -> Column:
    g = cfg.horizon_months * growth
    return F.when(F.abs(growth) < 1e-9, rate).otherwise(rate * (F.exp(g) - 1) / g)


def median_days(rate: Column, cfg: Config = CONFIG) -> Column:
    return F.when(rate > 0, F.least(F.lit(cfg.max_days), 30 * math.log(2) / rate)).otherwise(F.lit(cfg.max_days))


def sold_by(rate: Column, days: float) -> Column:
    return 1 - F.exp(-rate * days / 30)


def bucket_units(rate: Column, stock: Column, cfg: Config = CONFIG) -> list[tuple[str, Column]]:
    """Units expected to sell in each bucket of days; the last is open."""
    out = []
    for label, lo, hi in cfg.buckets:
        upper = F.lit(1.0) if hi is None else sold_by(rate, hi)
        out.append((label, stock * (upper - sold_by(rate, max(0, lo - 1)))))
    return out


def binomial_quantiles(n: Column, p: Column, shares: tuple[float, ...] = (0.05, 0.95)) -> Column:
    """The least k of each share for which more than that share of Binomial(n, p) is at most k: where sorted trials have it by index.

    Probabilities are exact, by logarithms from one k to the next; p of 0 and 1 stand a hair off the ends.
    """
    tiny = F.lit(1e-300)
    yes, no = F.ln(F.greatest(p, tiny)), F.ln(F.greatest(1 - p, tiny))
    start = F.struct(F.lit(0.0).alias("cdf"), F.lit(0.0).alias("ways"), *[F.lit(None).cast("int").alias(f"q{i}") for i in range(len(shares))])

    def step(s: Column, k: Column) -> Column:
        cdf = s["cdf"] + F.exp(s["ways"] + k * yes + (n - k) * no)
        ways = s["ways"] + F.ln(F.greatest((n - k) / (k + 1), tiny))
        return F.struct(cdf.alias("cdf"), ways.alias("ways"), *[F.coalesce(s[f"q{i}"], F.when(cdf > x, k)).alias(f"q{i}") for i, x in enumerate(shares)])

    done = F.aggregate(F.sequence(F.lit(0), n), start, step)
    return F.struct(*[F.coalesce(done[f"q{i}"], n).alias(f"q{i}") for i in range(len(shares))])


def robust_stats(df: DataFrame, key: str, value: str, cfg: Config = CONFIG) -> DataFrame:
    """Median, quartiles, MAD and number of outliers of each key; a median and one join back, no collected lists."""
    first = df.groupBy(key).agg(F.count(value).alias("n"), F.median(value).alias("med"), F.percentile(value, 0.25).alias("q1"), F.percentile(value, 0.75).alias("q3"))
    both = df.select(key, value).join(first, key)
    mad = both.groupBy(key).agg(F.median(F.abs(F.col(value) - F.col("med"))).alias("mad"))
    third = both.join(mad, key)
    iqr = F.col("q3") - F.col("q1")
    far = F.when(F.col("mad") > 0, F.abs(F.col(value) - F.col("med")) > cfg.mad_cut * cfg.mad_scale * F.col("mad")).when(
        iqr > 0, (F.col(value) < F.col("q1") - cfg.tukey * iqr) | (F.col(value) > F.col("q3") + cfg.tukey * iqr)
    )
    return third.groupBy(key).agg(F.first("n").alias("n"), F.first("med").alias("med"), F.first("q1").alias("q1"), F.first("q3").alias("q3"), F.first("mad").alias("mad"), F.count_if(far).alias("outliers"))
