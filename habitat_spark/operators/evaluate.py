"""Evaluation of held-out scores: (label 1 or 0, score, fold).

Curves need running totals over scores. Equal scores are first collapsed by an aggregate; totals then run inside
ranges of scores, and each range starts from the sum of those before it, so no step sorts all scores in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Ranges of scores for running totals, with about as many distinct scores each.
RANGES = 64


def tie_runs(df: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, score, pos, neg), one row for each distinct score."""
    return df.groupBy(*keys, "score").agg(F.sum("label").cast("long").alias("pos"), F.sum(1 - F.col("label")).cast("long").alias("neg"))


def running(df: DataFrame, columns: list[str], by: str = "score", keys: tuple[str, ...] = ()) -> DataFrame:
    """Totals down descending values of by, as run_<column>, and of all rows, as all_<column>; of each of keys' values.

    Rows are cut into RANGES parts at approximate quantiles of by, so that no part has much more of them than another,
    wherever the values lie. by is best distinct (for each of keys).
    """
    cuts = df.agg(F.coalesce(F.percentile_approx(by, [i / RANGES for i in range(1, RANGES)], 10_000), F.array().cast("array<double>")).alias("_cuts"))  # one row
    rows = df.join(F.broadcast(cuts)).withColumn("_part", F.size(F.filter("_cuts", lambda c: c <= F.col(by)))).drop("_cuts")
    every = W.partitionBy(*keys).orderBy(F.desc("_part")).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*keys)
    sums = rows.groupBy(*keys, "_part").agg(*[F.sum(c).alias(f"_s_{c}") for c in columns])  # RANGES rows at most, for each of keys
    sums = sums.select(*keys, "_part", *[F.coalesce(F.sum(f"_s_{c}").over(every), F.lit(0)).alias(f"_o_{c}") for c in columns], *[F.sum(f"_s_{c}").over(whole).alias(f"all_{c}") for c in columns])
    inside = W.partitionBy(*keys, "_part").orderBy(F.desc(by)).rowsBetween(W.unboundedPreceding, 0)
    return rows.join(F.broadcast(sums), [*keys, "_part"]).select(*df.columns, *[(F.sum(c).over(inside) + F.col(f"_o_{c}")).alias(f"run_{c}") for c in columns], *[f"all_{c}" for c in columns])


def curve(df: DataFrame) -> DataFrame:
    """For each cutoff (score >= cutoff is called a patch): tp, fp, and the numbers of positives and negatives."""
    return curve_of(tie_runs(df))


def curve_of(runs: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """The same of (score, pos, neg) rows, for each of keys' values."""
    r = running(runs, ["pos", "neg"], keys=keys)
    return r.select(*keys, "score", "pos", "neg", F.col("run_pos").alias("tp"), F.col("run_neg").alias("fp"), F.col("all_pos").alias("p"), F.col("all_neg").alias("n"))


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b as doubles; null for a zero divisor."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.try_divide(a.cast("double"), b.cast("double"))


def roc_curve(df: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Sensitivity and specificity at each distinct score, of all rows or of each of keys' values."""
    return curve_of(tie_runs(df, keys), keys).select(*keys, "score", ratio("tp", "p").alias("sensitivity"), (1 - ratio("fp", "n")).alias("specificity"))


def pr_curve(df: DataFrame) -> DataFrame:
    return curve(df).select("score", ratio("tp", "p").alias("recall"), ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"))


def threshold_curve(df: DataFrame) -> DataFrame:
    s, q = ratio("tp", "p"), 1 - ratio("fp", "n")
    return curve(df).select("score", s.alias("sens"), q.alias("spec"), (s + q - 1).alias("tss"))


def best_cutoff(df: DataFrame) -> DataFrame:
    """The cutoff of the largest tss, the highest of equal ones; no row if there is one class only. A partial aggregate, no sort."""
    t = threshold_curve(df).filter("tss is not null")
    best = t.agg(F.max_by(F.struct("score", "tss"), F.struct("tss", "score")).alias("b"))
    return best.filter("b is not null").select(F.col("b.score").alias("cutoff"), F.col("b.tss").alias("tss"))


def _auc() -> Column:
    """roc_auc, over rows of a curve."""
    # each run of ties has, below it, the negatives that no cutoff up to it calls
    wins = F.col("pos") * (F.col("n") - F.col("fp")) + F.col("pos") * F.col("neg") / F.lit(2)
    return F.try_divide(F.sum(wins.cast("decimal(28,1)")).cast("double"), (F.max("p") * F.max("n")).cast("double"))


def _pr_auc() -> Column:
    before_tp, before_all = F.col("tp") - F.col("pos"), F.col("tp") + F.col("fp") - F.col("pos") - F.col("neg")
    previous = F.when(before_all > 0, ratio(before_tp, before_all)).otherwise(F.lit(1.0))
    piece = ratio("pos", "p") * (ratio(F.col("tp"), F.col("tp") + F.col("fp")) + previous) / 2
    return F.sum(piece.cast("decimal(38,18)")).cast("double")


def roc_auc(df: DataFrame) -> DataFrame:
    """Share of (positive, negative) pairs in the right order, ties counting a half."""
    return curve(df).agg(_auc().alias("roc_auc"))


def pr_auc(df: DataFrame) -> DataFrame:
    """Area under precision over recall by trapezoids from (0, 1)."""
    return curve(df).agg(_pr_auc().alias("pr_auc"))


def calibration(df: DataFrame, bins: int = 10) -> DataFrame:
    """Mean score, observed rate and size of equal bins, closed on the right."""
    at = F.greatest(F.ceil(F.col("score") * bins), F.lit(1)).cast("int")
    return df.groupBy(at.alias("bin")).agg(ratio(F.sum(F.col("score").cast("decimal(28,10)")), F.count("*")).alias("predicted"), ratio(F.sum("label"), F.count("*")).alias("observed"), F.count("*").alias("n"))


def counts(called: Column) -> list[Column]:
    one = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    y = F.col("label") == 1
    return [one(called & y).alias("tp"), one(called & ~y).alias("fp"), one(~called & y).alias("fn"), one(~called & ~y).alias("tn")]


def rates(df: DataFrame) -> DataFrame:
    """sens, spec, tss and precision of tp, fp, fn, tn."""
    sens, spec = ratio(F.col("tp"), F.col("tp") + F.col("fn")), ratio(F.col("tn"), F.col("tn") + F.col("fp"))
    return df.withColumns({"sens": sens, "spec": spec, "tss": sens + spec - 1, "precision": ratio(F.col("tp"), F.col("tp") + F.col("fp"))})


METRICS = ["sens", "spec", "tss", "precision"]


def metrics_at(df: DataFrame, cutoff: float | None) -> DataFrame:
    """(metric, value) at a cutoff; no rows without one."""
    rows = rates(df.agg(*counts(F.col("score") >= F.lit(cutoff)))).select(*METRICS).unpivot([], METRICS, "metric", "value")
    return rows if cutoff is not None else rows.limit(0)


def kappa() -> Column:
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    chance = ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (n * n)
    return F.try_divide((tp + tn) / n - chance, 1 - chance)


def _counts_at(cutoff: float) -> list[Column]:
    """tp, fp, fn and tn at a cutoff, over rows of a curve or of ties."""
    one = lambda c, called: F.coalesce(F.sum(F.when(called, F.col(c))), F.lit(0)).cast("long")
    yes = F.col("score") >= cutoff
    return [one("pos", yes).alias("tp"), one("neg", yes).alias("fp"), one("pos", ~yes).alias("fn"), one("neg", ~yes).alias("tn")]


def fold_runs(df: DataFrame) -> DataFrame:
    """(fold, score, pos, neg), one row for each distinct score of a fold."""
    return df.groupBy("fold", "score").agg(F.sum("label").cast("long").alias("pos"), F.sum(1 - F.col("label")).cast("long").alias("neg"))


def fold_values_of(runs: DataFrame) -> DataFrame:
    """fold_values, from fold_runs: one aggregate over all folds' curves."""
    found = curve_of(runs, ("fold",)).groupBy("fold").agg(_auc().alias("roc_auc"), *_counts_at(0.5))
    return rates(found).select("fold", kappa().alias("kap"), "sens", "spec", "roc_auc")


def fold_values(df: DataFrame) -> DataFrame:
    """A row for each fold: roc_auc, kap, sens and spec at one half. Totals run inside ranges of each fold's scores."""
    return fold_values_of(fold_runs(df))


FOLD_METRICS = ["roc_auc", "kap", "sens", "spec"]


def _fold_row(folds: DataFrame) -> DataFrame:
    """One row with mean_, err_ and n_ of each metric over folds."""
    return folds.agg(*[x for m in FOLD_METRICS for x in (F.avg(m).alias(f"mean_{m}"), (F.stddev_samp(m) / F.sqrt(F.count(m))).alias(f"err_{m}"), F.count(m).alias(f"n_{m}"))])


def _as_rows(df: DataFrame, names: list[str], rows: list[list]) -> DataFrame:
    """The rows' values, lists of columns of a frame of one row, as rows under names."""
    return df.select(F.inline(F.array(*[F.struct(*[v.alias(n) for n, v in zip(names, r)]) for r in rows])))


def fold_metrics(df: DataFrame) -> DataFrame:
    """(metric, mean, std_err, n) over folds, with tss from the means of sens and spec."""
    c = F.col
    rows = [[F.lit(m), c(f"mean_{m}"), c(f"err_{m}"), c(f"n_{m}")] for m in FOLD_METRICS]
    tss = [F.lit("tss"), c("mean_sens") + c("mean_spec") - 1, F.lit(None).cast("double"), F.greatest(*[f"n_{m}" for m in FOLD_METRICS])]
    return _as_rows(_fold_row(fold_values(df)), ["metric", "mean", "std_err", "n"], [*rows, tss])


def evaluation_table(df: DataFrame) -> DataFrame:
    """(metric, kind, threshold, value, std_err): ranking rows, those at one half, those at the best cutoff.

    roc_auc is the mean of folds; the rows at one half carry the folds' standard errors; all other values are pooled.
    Rows are collapsed once, to the distinct scores of each fold; the pooled curve and the folds' come from that.
    """
    runs = fold_runs(df)
    c = curve_of(runs.groupBy("score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")))
    sens, spec = ratio("tp", "p"), 1 - ratio("fp", "n")
    point = F.struct(F.col("score").alias("score"), sens.alias("sens"), spec.alias("spec"), (sens + spec - 1).alias("tss"), ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"))
    tss = F.when((sens + spec).isNotNull(), F.struct((sens + spec - 1).alias("tss"), F.col("score").alias("score")))
    pooled = rates(c.agg(_pr_auc().alias("pr_auc"), F.max_by(point, tss).alias("best"), *_counts_at(0.5)))
    one = pooled.join(F.broadcast(_fold_row(fold_values_of(runs))))  # one row beside another
    none = F.lit(None).cast("double")
    err = {"sens": F.col("err_sens"), "spec": F.col("err_spec")}
    rows = [[F.lit("roc_auc"), F.lit("rank"), none, F.col("mean_roc_auc"), F.col("err_roc_auc")], [F.lit("pr_auc"), F.lit("rank"), none, F.col("pr_auc"), none]]
    rows += [[F.lit(m), F.lit("default"), F.lit(0.5), F.col(m), err.get(m, none)] for m in METRICS]
    rows += [[F.lit(m), F.lit("best"), F.col("best")["score"], F.col("best")[m], none] for m in METRICS]
    return _as_rows(one, ["metric", "kind", "threshold", "value", "std_err"], rows).filter("kind <> 'best' or threshold is not null")


def with_bounds(table: DataFrame, bounds: DataFrame) -> DataFrame:
    """The evaluation table with lower and upper of bootstrap series, met by metric and kind (which is carried, not guessed from the cutoff)."""
    name = F.when(F.col("kind") == "rank", F.col("metric")).otherwise(F.concat_ws("_", "metric", F.when(F.col("kind") == "default", "half").otherwise("best")))
    return table.withColumn("series", name).join(F.broadcast(bounds.select("series", "lower", "upper")), "series", "left").drop("series")


def stratified_folds(df: DataFrame, v: int = 5, seed_order: Column | None = None, key: str = "station_id") -> DataFrame:
    """fold 0 to v - 1, classes dealt out evenly in a fixed pseudo-random order.

    Rows are numbered inside 256 hash groups of a class, then offset by the sizes of the groups before.
    """
    order = seed_order if seed_order is not None else F.xxhash64(key)
    rows = df.withColumn("_o", order).withColumn("_g", F.floor(F.pmod(F.col("_o"), F.lit(1_000_003)) / F.lit(3907)).cast("int"))
    sizes = rows.groupBy("label", "_g").agg(F.count("*").alias("_n"))
    starts = sizes.withColumn("_s", F.sum("_n").over(W.partitionBy("label").orderBy("_g")) - F.col("_n")).drop("_n")
    place = F.row_number().over(W.partitionBy("label", "_g").orderBy("_o", key)) - 1
    return rows.join(F.broadcast(starts), ["label", "_g"]).withColumn("fold", ((place + F.col("_s")) % v).cast("int")).drop("_o", "_g", "_s")
