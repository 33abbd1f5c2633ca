"""Descriptive statistics.  Non-numbers are dropped first; empty input gives 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0.0))


def _number(column: str) -> Column:
    c = F.col(column).cast("double")
    return F.when(~F.isnan(c), c)


#: Stretches that a group's range is cut into when ranks are looked up.
STRETCHES = 1024


def _counted(df: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """(keys, __v, __c): the different numbers of each group and how often they come."""
    return df.select(*keys, _number(column).alias("__v")).filter("__v is not null").groupBy(*keys, "__v").agg(F.count(F.lit(1)).alias("__c"))


def _with(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Joined on the keys; without keys ``right`` is one row."""
    return left.join(right, keys) if keys else left.crossJoin(F.broadcast(right))


def at_ranks(counted: DataFrame, keys: list[str], ranks: dict[str, Column]) -> DataFrame:
    """The value at each rank from 0, an expression of the group's size ``__n``; NULL if there is none.

    Values are counted first.  Counts of the stretches of a group's range tell
    which stretches hold the ranks, and only the values of those are sorted, a
    stretch of a group in one place.  So no group is sorted or held as a whole.
    """
    span = counted.groupBy(*keys).agg(F.min("__v").alias("__lo"), F.max("__v").alias("__hi"), F.sum("__c").alias("__n"))
    share = F.try_divide(F.col("__v") - F.col("__lo"), F.nullif(F.col("__hi") - F.col("__lo"), F.lit(0.0)))
    stretch = F.coalesce(F.least(F.floor(share * STRETCHES), F.lit(STRETCHES - 1)), F.lit(0)).cast("int")
    placed = _with(counted, span, keys).select(*keys, "__v", "__c", "__n", stretch.alias("__s"))
    before = Window.partitionBy(*keys).orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    wanted = F.array(*(F.struct(F.lit(name).alias("name"), rank.cast("bigint").alias("rank")) for name, rank in ranks.items()))
    # at most STRETCHES rows of a group, of which those that hold a rank stay
    sums = placed.groupBy(*keys, "__s").agg(F.sum("__c").alias("__c"), F.first("__n").alias("__n"))
    sums = sums.withColumn("__before", F.coalesce(F.sum("__c").over(before), F.lit(0))).withColumn("__w", wanted)
    inside = F.filter("__w", lambda w: (w["rank"] >= F.col("__before")) & (w["rank"] < F.col("__before") + F.col("__c")))
    sums = sums.select(*keys, "__s", "__before", inside.alias("__w")).filter(F.size("__w") > 0)
    held = placed.drop("__n").join(F.broadcast(sums) if not keys else sums, [*keys, "__s"])
    up_to = F.col("__before") + F.sum("__c").over(Window.partitionBy(*keys, "__s").orderBy("__v"))
    found = held.withColumn("__to", up_to).withColumn("__w", F.explode("__w"))
    found = found.filter((F.col("__w.rank") < F.col("__to")) & (F.col("__w.rank") >= F.col("__to") - F.col("__c")))
    return found.groupBy(*keys).agg(*(F.max(F.when(F.col("__w.name") == name, F.col("__v"))).alias(name) for name in ranks))


def modes(df: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """(by, mode): the most frequent value; ties to the lowest, as rows have no order; NULL if empty."""
    return _counted(df, column, by or []).groupBy(*(by or [])).agg(F.max_by("__v", F.struct("__c", -F.col("__v"))).alias("mode"))


def hinges(df: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """q1, q2, q3 as medians of the halves, without the middle value where n is odd."""
    keys = by or []
    n = F.col("__n")
    h = F.floor(n / 2)
    ranks: dict[str, Column] = {}
    for name, start, size in (("q1", F.lit(0), h), ("q2", F.lit(0), n), ("q3", F.ceil(n / 2), h)):
        some = size > 0
        ranks[f"{name}_low"] = F.when(some, start + F.floor((size - 1) / 2))
        ranks[f"{name}_high"] = F.when(some, start + F.floor(size / 2))
    middles = at_ranks(_counted(df, column, keys), keys, ranks)
    return middles.select(*keys, *(_zero((F.col(f"{q}_low") + F.col(f"{q}_high")) / 2).alias(q) for q in ("q1", "q2", "q3")))


def _percentiles(counted: DataFrame, keys: list[str], names: dict[str, float]) -> DataFrame:
    """Percentiles with interpolation between the two nearest ranks, 0 for no rows."""
    at = lambda p: (F.col("__n") - 1) * p
    ranks = {f"{k}_low": F.floor(at(p)) for k, p in names.items()} | {f"{k}_high": F.ceil(at(p)) for k, p in names.items()}
    found = at_ranks(counted, keys, ranks)
    sizes = counted.groupBy(*keys).agg(F.sum("__c").alias("__n"))

    def between(name: str, p: float) -> Column:
        low, high = F.col(f"{name}_low"), F.col(f"{name}_high")
        part = at(p) - F.floor(at(p))
        return _zero(low * (1 - part) + high * part).alias(name)

    return _with(found, sizes, keys).select(*keys, *(between(k, p) for k, p in names.items()))


def percentiles(df: DataFrame, column: str, names: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """(by, a column for each name) with the percentile, a share from 0 to 1, interpolated."""
    return _percentiles(_counted(df, column, by or []), by or [], names)


def comprehensive(df: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """Count, mean, median, mode, population spread, range and interpolated percentiles."""
    keys = by or []
    v = df.select(*keys, _number(column).alias("__v")).filter("__v is not null")
    counted = _counted(df, column, keys)
    names = {"median": 0.5} | {f"p{p}": p / 100 for p in (10, 25, 50, 75, 90, 95, 99)}
    r = lambda c: F.round(_zero(c), 4)
    plain = v.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("count"),
        r(F.sum("__v")).alias("sum"),
        r(F.avg("__v")).alias("mean"),
        r(F.stddev_pop("__v")).alias("stddev"),
        r(F.var_pop("__v")).alias("variance"),
        r(F.min("__v")).alias("min"),
        r(F.max("__v")).alias("max"),
        r(F.max("__v") - F.min("__v")).alias("range"),
    )
    most = counted.groupBy(*keys).agg(F.max_by("__v", F.struct("__c", -F.col("__v"))).alias("mode"))
    joined = _with(_with(plain, most, keys), _percentiles(counted, keys, names), keys)
    first = ["count", "sum", "mean"]
    rest = ["stddev", "variance", "min", "max", "range"]
    return joined.select(*keys, *first, r(F.col("median")).alias("median"), "mode", *rest, *(r(F.col(k)).alias(k) for k in names if k != "median"))


def multi_field(df: DataFrame, fields: list[str]) -> DataFrame:
    """``comprehensive`` of each field, in one pass over unpivoted rows."""
    tall = df.select(*(F.col(f).cast("double").alias(f) for f in fields)).unpivot([], fields, "field", "value")
    return comprehensive(tall, "value", ["field"])


def iqr_outliers(df: DataFrame, column: str, by: list[str] | None = None, k: float = 1.5) -> DataFrame:
    """Rows outside [q1 - k iqr, q3 + k iqr] of the hinges, with the bounds."""
    q = hinges(df, column, by)
    bounds = q.select(
        *(by or []),
        (F.col("q1") - (F.col("q3") - F.col("q1")) * k).alias("lower"),
        (F.col("q3") + (F.col("q3") - F.col("q1")) * k).alias("upper"),
    )
    joined = df.join(bounds, by) if by else df.crossJoin(F.broadcast(bounds))
    return joined.filter((F.col(column) < F.col("lower")) | (F.col(column) > F.col("upper")))


def z_outliers(df: DataFrame, column: str, by: list[str] | None = None, threshold: float = 3.0) -> DataFrame:
    """Rows whose population z-score is strictly beyond the threshold; none without spread."""
    spread = df.groupBy(*(by or [])).agg(F.avg(column).alias("__mean"), F.stddev_pop(column).alias("__sd"))
    joined = df.join(spread, by) if by else df.crossJoin(F.broadcast(spread))
    z = F.try_divide(F.col(column) - F.col("__mean"), F.nullif(F.col("__sd"), F.lit(0.0)))
    return joined.withColumn("z", z).filter(F.abs("z") > threshold).drop("__mean", "__sd")


def correlation(x: Column, y: Column) -> Column:
    """Pearson; 0 where either side has no spread."""
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.coalesce(F.try_divide(F.covar_pop(x, y), F.nullif(spread, F.lit(0.0))), F.lit(0.0))


def correlation_matrix(df: DataFrame, fields: list[str]) -> DataFrame:
    """(a, b, r) of every pair of fields, missing values as 0; one pass."""
    filled = df.select(*(F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in fields))
    row = filled.agg(
        F.array(
            *(
                F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(correlation(F.col(a), F.col(b)), 4).alias("r"))
                for a in fields
                for b in fields
            )
        ).alias("m")
    )
    return row.select(F.inline("m"))


def compare(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Differences b - a of mean, median and population standard deviation."""
    def side(df: DataFrame, p: str) -> DataFrame:
        plain = df.agg(_zero(F.avg(column)).alias(p + "mean"), _zero(F.stddev_pop(column)).alias(p + "sd"))
        return plain.crossJoin(F.broadcast(percentiles(df, column, {p + "median": 0.5})))

    joined = side(a, "a_").crossJoin(side(b, "b_"))
    return joined.select(
        *(F.round(F.col(f"b_{m}") - F.col(f"a_{m}"), 4).alias(f"{m}_difference") for m in ("mean", "median", "sd"))
    )
