"""Operators on projected surfaces: spread, novelty, coverage, stacks and effects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S


def logistic(intercept: float | Column, weights: dict[str, float]) -> Column:
    """Probability of a fixed linear predictor."""
    z = F.lit(intercept) if not isinstance(intercept, Column) else intercept
    for name, w in weights.items():
        z = z + F.col(name) * F.lit(w)
    return 1 / (1 + F.exp(-z))


def spread(df: DataFrame, members: list[Column], level: float = 0.9) -> DataFrame:
    """sd and interpolated quantiles over members of each row; none with fewer than two.

    Members are an array in the row: no rows are multiplied and nothing is shuffled.
    """
    if len(members) < 2:
        return df
    n = len(members)
    a = F.array_sort(F.array(*members))
    mean = F.aggregate("_m", F.lit(0.0), lambda s, x: s + x) / n
    squares = F.aggregate(F.transform("_m", lambda x: (x - F.col("_mean")) * (x - F.col("_mean"))), F.lit(0.0), lambda s, x: s + x)

    def quantile(p: float) -> Column:
        at = p * (n - 1)
        low = int(at)
        high = min(low + 1, n - 1)
        return F.col("_m")[low] + (F.col("_m")[high] - F.col("_m")[low]) * F.lit(at - low)

    out = df.withColumn("_m", a).withColumn("_mean", mean)
    return out.withColumns({"suitability_sd": F.sqrt(squares / (n - 1)), "suitability_lower": quantile((1 - level) / 2), "suitability_upper": quantile((1 + level) / 2), "n_members": F.lit(n)}).drop("_m", "_mean")


#: Columns of a projection that are there only if asked for.
OPTIONAL = ("suitability_sd", "suitability_lower", "suitability_upper", "novelty", "novel_variable")


def uncertainty_layers(df: DataFrame) -> list[str]:
    """Those of the optional columns that a projection has."""
    return [c for c in OPTIONAL if c in df.columns]


def coverage(df: DataFrame, predictors: list[str]) -> DataFrame:
    """(year, month, predictor, n_missing, n_grid) from one aggregate."""
    sums = df.groupBy("year", "month").agg(F.count("*").alias("n_grid"), *[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in predictors])
    return sums.unpivot(["year", "month", "n_grid"], predictors, "predictor", "n_missing")


def worst_month(df: DataFrame, predictors: list[str]) -> DataFrame:
    """The step with the least share of complete cells; the earliest of equal ones."""
    whole = F.lit(True)
    for c in predictors:
        whole = whole & F.col(c).isNotNull()
    steps = df.groupBy("year", "month").agg(F.sum(whole.cast("long")).alias("n_cells"), F.count("*").alias("n_grid"))
    share = F.col("n_cells").cast("double") / F.col("n_grid")
    return steps.agg(F.min_by(F.struct("*"), F.struct(share, "year", "month")).alias("s")).select("s.*")


def similarity(x: Column, below: Column, n: Column, lo: Column, hi: Column) -> Column:
    """Similarity of x to training values: at most 100, negative outside their range."""
    f = 100.0 * below / n
    span = hi - lo
    flat = F.when(x == lo, 100.0).otherwise(F.lit(float("-inf")))
    outside = F.when(below == 0, 100 * F.try_divide(x - lo, span)).when(f <= 50, 2 * f).when(f < 100, 2 * (100 - f)).otherwise(100 * F.try_divide(hi - x, span))
    return F.when(x.isNull(), F.lit(None).cast("double")).when(span == 0, flat).otherwise(outside)


#: Slots of a predictor's distinct values, about equally full.
SLOTS = 256


def novelty(df: DataFrame, train: DataFrame, predictors: list[str], key: list[str]) -> DataFrame:
    """novelty (least similarity over predictors, null if one is missing) and novel_variable (missing ones skipped).

    key: columns that name a row of df. Values are collapsed first, to the distinct ones of each predictor; those that
    lie in the training range get the number of training values below them from running counts inside slots, which are
    cut at quantiles of the distinct values, and the others need no count. Similarities then meet the rows by value, in
    a plain join, and one more aggregate brings each row's predictors together.
    """
    long = train.select(*predictors).unpivot([], predictors, "variable", "v").filter("v is not null")
    asked = df.select(F.struct(*key).alias("_key"), *predictors).unpivot(["_key"], predictors, "variable", "v").filter("v is not null")
    ends = long.groupBy("variable").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))  # a row for each predictor
    marks = long.groupBy("variable", "v").agg(F.count("*").alias("c"))
    values = asked.groupBy("variable", "v").agg(F.lit(0).cast("long").alias("c"))
    # a value that both have stands twice; the sum puts the two together
    both = marks.unionByName(values).groupBy("variable", "v").agg(F.sum("c").alias("c")).join(F.broadcast(ends), "variable")
    inside = F.col("v").between(F.col("lo"), F.col("hi"))
    below = counted_below(both.filter(inside)).unionByName(both.filter(~inside).withColumn("below", F.when(F.col("v") > F.col("hi"), F.col("n")).otherwise(0)))
    number = F.create_map(*[x for i, p in enumerate(predictors) for x in (F.lit(p), F.lit(i))])
    alike = below.select("variable", "v", similarity(F.col("v"), F.col("below"), F.col("n"), F.col("lo"), F.col("hi")).alias("sim"))
    sims = asked.join(alike, ["variable", "v"]).select("_key", F.element_at(number, F.col("variable")).alias("i"), "sim")
    least = sims.groupBy("_key").agg(F.min(F.struct("sim", "i")).alias("m"), F.count("*").alias("k"))
    names = F.array(*[F.lit(p) for p in predictors])
    found = least.select("_key.*", F.when(F.col("k") == len(predictors), F.col("m.sim")).alias("novelty"), F.get(names, F.col("m.i")).alias("novel_variable"))
    return df.join(found, key, "left").select(*df.columns, "novelty", "novel_variable")


def slotted(values: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Distinct (variable, v, ...) rows with a slot: of each variable about equally many rows in each, in order of v."""
    share = [i / slots for i in range(1, slots)]
    cuts = values.groupBy("variable").agg(F.percentile_approx("v", share, 10_000).alias("_cuts"))  # a row for each predictor
    return values.join(F.broadcast(cuts), "variable").withColumn("slot", F.size(F.filter("_cuts", lambda x: x <= F.col("v")))).drop("_cuts")


def counted_below(values: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Distinct (variable, v, c, ...) rows with below: the sum of c over lesser v of the variable."""
    from pyspark.sql import Window as W

    rows = slotted(values, slots)
    starts = rows.groupBy("variable", "slot").agg(F.sum("c").alias("_s")).withColumn("_s", F.sum("_s").over(W.partitionBy("variable").orderBy("slot")) - F.col("_s"))  # slots rows at most, for each predictor
    inner = W.partitionBy("variable", "slot").orderBy("v").rowsBetween(W.unboundedPreceding, W.currentRow)
    counted = rows.join(F.broadcast(starts), ["variable", "slot"]).withColumn("below", F.sum("c").over(inner) - F.col("c") + F.col("_s"))
    return counted.select(*values.columns, "below")


def novelty_summary(df: DataFrame) -> DataFrame:
    """(novel_variable, n_outside, share): cells outside the training range by the variable that puts them there."""
    total = df.agg(F.count("*").alias("_t"))
    out = df.filter("novelty < 0").groupBy("novel_variable").agg(F.count("*").alias("n_outside"))
    return out.join(F.broadcast(total)).select("novel_variable", "n_outside", (F.col("n_outside").cast("double") / F.col("_t")).alias("share"))


def stack(df: DataFrame, value: str, keys: list[str], layers: list[str]) -> DataFrame:
    """Monthly layers side by side, one row for each cell. layers: the names yyyy_mm, so no pass is spent finding them."""
    named = df.withColumn("_layer", F.format_string("%04d_%02d", "year", "month"))
    return named.groupBy(*keys).pivot("_layer", layers).agg(F.first(value, ignorenulls=True))


def partial_dependence(df: DataFrame, predictors: list[str], scorer, grid_size: int = 20, carried: list[str] = ()) -> DataFrame:
    """(variable, value, probability): mean score over the sample as one predictor sweeps its quantiles.

    All sweeps are one frame and one scoring pass. scorer gives a probability Column over predictor and carried columns.
    """
    share = [i / (grid_size - 1) for i in range(grid_size)]
    cuts = df.agg(*[F.array_distinct(F.percentile(p, share)).alias(p) for p in predictors])
    long = cuts.unpivot([], predictors, "variable", "values").filter(F.size("values") > 1).select("variable", F.explode("values").alias("value"))
    sample = df.select(*predictors, *carried)
    swept = sample.join(F.broadcast(long))  # predictors x grid_size rows, whatever the sample's size
    cols = {p: F.when(F.col("variable") == p, F.col("value")).otherwise(F.col(p)) for p in predictors}
    scored = swept.select("variable", "value", *carried, *[c.alias(p) for p, c in cols.items()]).withColumn("_p", scorer())
    return scored.groupBy("variable", "value").agg(S.exact_mean("_p").alias("probability"))


def distinct_gate(df: DataFrame, predictors: list[str], limit: int = 10) -> DataFrame:
    """(variable, n_distinct, term): smooth for predictors of more than limit values, else linear."""
    counts = df.agg(*[F.count_distinct(p).alias(p) for p in predictors]).unpivot([], predictors, "variable", "n_distinct")
    return counts.withColumn("term", F.when(F.col("n_distinct") > limit, "smooth").otherwise("linear"))


def normalised(df: DataFrame, columns: list[str], train: Column | None = None) -> DataFrame:
    """(x - mean) / sd with the moments of the training rows; null for a constant column."""
    only = (lambda c: F.when(train, F.col(c))) if train is not None else F.col
    moments = df.agg(*[x for c in columns for x in (F.avg(only(c)).alias(f"_m_{c}"), F.stddev_samp(only(c)).alias(f"_s_{c}"))])
    out = df.join(F.broadcast(moments))  # one row
    return out.withColumns({c: (F.col(c) - F.col(f"_m_{c}")) / F.nullif(F.col(f"_s_{c}"), F.lit(0.0)) for c in columns}).select(*df.columns)
