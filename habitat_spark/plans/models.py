"""Model types, folds, fitting, evaluation, importance, effects, bootstrap and ensembles with Spark ML."""

from __future__ import annotations

import warnings
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import GBTClassifier, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import SQLTransformer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import evaluate as E
from ..operators import surfaces as U
from ..sources import scratch
from . import additive, bases
from .links import LINKS, chi_squared_tail

#: Links of Spark's own binomial regression; a glm with another one is fitted like an additive model without smooths.
SPARK_LINKS = ("logit", "probit", "cloglog")
#: Distinct values that a predictor has at most to stay a straight term.
STRAIGHT = 10
#: Engines that name a type.
ENGINES = {"ranger": "rf", "xgboost": "brt", "glm": "glm", "mgcv": "gam"}


@dataclass(frozen=True)
class Spec:
    """A model type and its settings."""

    type: str = "rf"
    trees: int = 100
    depth: int = 5
    min_n: int = 2
    rate: float = 0.05
    link: str = "logit"
    basis: int = 10
    seed: int = 1
    mtry: int | None = None
    bs: str | dict[str, str] | None = None
    method: str = "GCV.Cp"
    shrink: bool = False
    gamma: float = 1.0
    offset: str | None = None
    offset_transform: str = "none"


def resolve_type(type_: str | None = None, engine: str | None = None) -> str:
    """The type named, else the one of the engine, else rf."""
    if type_:
        if type_ not in ENGINES.values():
            raise ValueError(f"unknown model type {type_!r}; known: {', '.join(ENGINES.values())}")
        return type_
    return ENGINES.get(engine or "", "rf")


def estimator(spec: Spec):
    """Spark estimator of a type, over the vector column features."""
    if spec.type == "rf":
        return RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=spec.trees, maxDepth=min(30, max(spec.depth, 5)), minInstancesPerNode=spec.min_n, featureSubsetStrategy=str(spec.mtry or "sqrt"), seed=spec.seed)
    if spec.type == "brt":
        return GBTClassifier(featuresCol="features", labelCol="label", maxIter=spec.trees, maxDepth=spec.depth, stepSize=spec.rate, minInstancesPerNode=spec.min_n, seed=spec.seed)
    if spec.type == "glm":
        model = GeneralizedLinearRegression(featuresCol="features", labelCol="label", family="binomial", link=spec.link, regParam=0.0, maxIter=50)
        return model.setOffsetCol("_offset") if spec.offset else model
    raise ValueError(spec.type)


def settings_of(spec: Spec, size: int, predictors: int) -> list[Spec]:
    """size settings to try, the given one first: numbers of predictors and least rows for rf, depth and rate for brt, the cost of a degree of freedom for gam."""
    out = [spec]
    for i in range(1, size):
        # a fixed sequence that fills the unit square evenly
        u, v = (i * 0.7548776662) % 1, (i * 0.5698402910) % 1
        if spec.type == "rf":
            out.append(replace(spec, mtry=1 + int(u * predictors), min_n=2 + int(v * 38)))
        elif spec.type == "brt":
            out.append(replace(spec, depth=2 + int(u * 6), rate=round(10 ** (-2 + 1.5 * v), 4)))
        elif spec.type == "gam":
            out.append(replace(spec, gamma=round(0.5 + 3.5 * u, 3)))
    return list(dict.fromkeys(out))


class Columns(Transformer):
    """A pipeline stage of column expressions."""

    def __init__(self, columns: dict):
        super().__init__()
        self.columns = columns

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns(self.columns)


@dataclass
class Fitted:
    """A fitted model with what evaluation needs."""

    spec: Spec
    predictors: list[str]
    pipeline: PipelineModel
    stages: list[dict] = field(default_factory=list)
    terms: dict[str, list[str]] = field(default_factory=dict)
    features: list[str] = field(default_factory=list)
    additive: additive.Additive | None = None

    def score(self, df: DataFrame) -> DataFrame:
        """df with the probability of a patch as score."""
        out = df
        for stage in self.stages:
            out = out.withColumns(stage)
        out = self.pipeline.transform(out)
        p = F.col("prediction") if self.spec.type in ("glm", "gam") else vector_to_array("probability")[1]
        return out.withColumn("score", p).select(*df.columns, "score")


def fit(df: DataFrame, predictors: list[str], spec: Spec, transforms: dict[str, str] | None = None) -> Fitted:
    """Transforms, normalisation (on these rows alone) and the model. df: label 1 for a patch, and the predictors."""
    stages: list[dict] = []
    if transforms:
        check_transforms(df, transforms)
        fixed = {c: S.transform(t, F.col(c)) for c, t in transforms.items() if t not in POWERS}
        fitted = {c: power(F.col(c), fitted_power(df, c, t), t) for c, t in transforms.items() if t in POWERS}
        stages.append(fixed | fitted)
    if spec.offset:
        x = F.col(spec.offset).cast("double")
        stages.append({"_offset": F.ln(x) if spec.offset_transform == "log" else x})
        predictors = [c for c in predictors if c != spec.offset]
    train = df
    for s in stages:
        train = train.withColumns(s)
    train = train.dropna(subset=[*predictors, *(["_offset"] if spec.offset else [])])
    if spec.type == "gam" or spec.type == "glm" and spec.link not in SPARK_LINKS:
        return _additive(train, predictors, spec, stages)
    features, terms = list(predictors), {p: [p] for p in predictors}
    shape = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="raw", handleInvalid="skip"), StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True)])
    train = train.withColumn("label", F.col("label").cast("double"))
    ready = shape.fit(train)
    model = _fitted_alike(train, ready, spec, features) if spec.type in ("rf", "brt") else None
    model = model or estimator(spec).fit(ready.transform(train))
    return Fitted(spec, predictors, PipelineModel([*ready.stages, model]), stages, terms, features)


#: Rows from which on trees are fitted on distinct rows with their counts, if these are ALIKE at most, of SEVERAL rows each on average.
LARGE = 1_000_000
ALIKE = 200_000
SEVERAL = 4
#: Trees of a forest that are fitted side by side.
BESIDE = 8


def _fitted_alike(train: DataFrame, shape: PipelineModel, spec: Spec, features: list[str]):
    """The trees fitted on distinct rows (features and label) with their counts; None where few rows are alike.

    Sums over equal rows are what trees are made of, so boosted ones are the same. In a forest each row is drawn with
    replacement by each tree, a Poisson number of times with mean 1; the sum of n such numbers is one with mean n. So each
    tree gets its own counts, drawn in the tasks, and is fitted on these without a further draw. A leaf's least number of
    rows is a share of the counts' sum.
    """
    if train.count() < LARGE:
        return None
    alike = scratch.stored(train.groupBy(*features, "label").agg(F.count("*").cast("double").alias("_n")), "alike")
    try:
        groups, rows = alike.agg(F.count("*"), F.sum("_n")).first()
        if rows < max(LARGE, 10 * spec.min_n) or groups > min(ALIKE, rows // SEVERAL):
            return None
        shaped = shape.transform(alike.repartition(-(-groups // 25_000), *features))
        if spec.type == "brt":
            return estimator(spec).setWeightCol("_n").setMinInstancesPerNode(1).setMinWeightFractionPerNode((spec.min_n - 0.5) / rows).fit(shaped)
        return _forest(shaped, spec, features)
    finally:
        scratch.discard(alike)


def _forest(shaped: DataFrame, spec: Spec, features: list[str]) -> RandomForestClassificationModel:
    """A forest over rows that stand for _n each."""
    seed, trees = spec.seed, spec.trees

    @F.pandas_udf("array<double>")
    def drawn(n: pd.Series, row: pd.Series) -> pd.Series:
        return pd.Series([np.random.default_rng([seed, r & (2**63 - 1)]).poisson(x, trees).astype(float) for x, r in zip(n, row)])

    bags = shaped.select("features", "label", drawn("_n", F.xxhash64(*features, "label")).alias("_drawn")).persist()
    try:
        totals = bags.agg(*[F.sum(F.col("_drawn")[i]) for i in range(trees)]).first()

        def tree(i: int):
            one = estimator(replace(spec, trees=1, seed=int(np.random.default_rng([seed, i]).integers(2**31)))).setBootstrap(False).setWeightCol("_w")
            one = one.setMinInstancesPerNode(1).setMinWeightFractionPerNode((spec.min_n - 0.5) / totals[i])
            return one.fit(bags.select("features", "label", F.col("_drawn")[i].alias("_w")).filter("_w > 0"))

        with ThreadPoolExecutor(BESIDE) as pool:
            made = list(pool.map(tree, range(trees)))
    finally:
        bags.unpersist()
    # Spark has no Python way to bring trees together in one model
    context = shaped.sparkSession.sparkContext
    kinds = context._jvm.org.apache.spark.ml.classification
    array = context._gateway.new_array(kinds.DecisionTreeClassificationModel, trees)
    for i, m in enumerate(made):
        array[i] = m._java_obj.trees()[0]
    return RandomForestClassificationModel(kinds.RandomForestClassificationModel(made[0].uid, array, len(features), 2)).setFeaturesCol("features")


def _additive(train: DataFrame, predictors: list[str], spec: Spec, stages: list[dict]) -> Fitted:
    """A smooth of each predictor with over STRAIGHT values (of a gam), the others straight; the mean as a stage of SQL."""
    if spec.link not in LINKS:
        raise ValueError(f"unknown link {spec.link!r}; known: {', '.join(LINKS)}")
    rows = scratch.stored(train.select(*[F.col(p).cast("double").alias(p) for p in predictors], F.col("label").cast("double").alias("label"), (F.col("_offset") if spec.offset else F.lit(0.0)).alias("_offset")), "additive")
    kept = [rows]
    try:
        facts = rows.agg(*[x for p in predictors for x in (F.approx_count_distinct(p).alias(f"n_{p}"), F.avg(p).alias(f"m_{p}"), F.stddev_pop(p).alias(f"s_{p}"), F.min(p).alias(f"a_{p}"), F.max(p).alias(f"b_{p}"), F.percentile_approx(p, [i / 100 for i in range(101)], 10_000).alias(f"q_{p}"))]).first()
        terms = []
        for p in predictors:
            # an approximate count tells small numbers exactly, and large ones from small ones
            if spec.type == "gam" and facts[f"n_{p}"] > STRAIGHT:
                kind = (spec.bs.get(p) if isinstance(spec.bs, dict) else spec.bs) or "tp"
                places = np.unique([facts[f"a_{p}"], *facts[f"q_{p}"], facts[f"b_{p}"]])
                if places.size <= STRAIGHT:  # nearly all rows have a few of the values
                    places = np.linspace(facts[f"a_{p}"], facts[f"b_{p}"], spec.basis)
                terms.append(bases.smooth(p, kind, spec.basis, places))
            else:
                terms.append(bases.linear(p, facts[f"m_{p}"] or 0.0, facts[f"s_{p}"] or 0.0))
        # equal rows are one with their count: each pass of the fit then reads what is distinct
        alike = scratch.stored(rows.groupBy(*rows.columns).agg(F.count("*").alias("_n")), "alike")
        kept.append(alike)
        made = additive.fitted(alike, terms, spec.link, spec.method, spec.shrink, spec.gamma)
    finally:
        scratch.discard(*kept)
    columns = {b.name: [f"{b.name}_{i}" for i in range(b.size)] if b.penalties else [b.name] for b in made.terms}
    stage = SQLTransformer(statement=made.prediction_sql("`_offset`" if spec.offset else None))
    return Fitted(spec, predictors, PipelineModel([stage]), stages, columns, [c for p in predictors for c in columns[p]], made)


def check_transforms(df: DataFrame, transforms: dict[str, str]) -> None:
    """Logarithms of zeros are an error; folding the sign of a mixed column is worth a warning. One aggregate."""
    sums = df.agg(*[F.sum((c).cast("int")).alias(n) for t in transforms for n, c in ((f"z_{t}", F.col(t) == 0), (f"n_{t}", F.col(t) < 0), (f"p_{t}", F.col(t) > 0))]).first()
    for c, t in transforms.items():
        if t in ("log", "log10", "abs_log", "boxcox") and sums[f"z_{c}"]:
            raise ValueError(f"{c} has zeros; {t} of them doesn't exist")
        if t == "boxcox" and sums[f"n_{c}"]:
            raise ValueError(f"{c} has negative values; {t} of them doesn't exist")
        if t not in POWERS and sums[f"n_{c}"] and sums[f"p_{c}"]:
            warnings.warn(f"{c} has both signs; {t} folds them together", stacklevel=3)


def cross_validated(df: DataFrame, predictors: list[str], spec: Spec, folds: int = 5, transforms=None, key: str = "station_id") -> tuple[DataFrame, list[Fitted]]:
    """(held-out rows with fold and score, the folds' models)."""
    rows = scratch.stored(E.stratified_folds(df, folds, key=key), "folds")
    models, parts = [], []
    for k in range(folds):
        m = fit(rows.filter(F.col("fold") != k), predictors, spec, transforms)
        models.append(m)
        parts.append(m.score(rows.filter(F.col("fold") == k)).select(key, "fold", "label", "score"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out, models


def tuned(df: DataFrame, predictors: list[str], specs: list[Spec], folds: int = 3, transforms=None) -> Spec:
    """The setting with the best mean roc_auc over folds; the first of equal ones."""
    best, top = specs[0], -1.0
    for s in specs:
        held, _ = cross_validated(df, predictors, s, folds, transforms)
        auc = E.fold_values(held).agg(F.avg("roc_auc")).first()[0] or 0.0
        if auc > top:
            best, top = s, auc
    return best


#: Rows among which importance deals out values anew: larger tables are cut into random blocks of about as many.
DEALT_ROWS = 100_000


def importance(fitted: Fitted, df: DataFrame, times: int = 3, key: str = "station_id", block: int = DEALT_ROWS) -> DataFrame:
    """(variable, importance): mean loss of roc_auc when a predictor's values are dealt out anew, the largest first.

    Each repeat pairs every row with another of its random block, once for all predictors; a row then makes a copy for
    each predictor with the pair's value of that one. All copies are scored in one pass, and kept as distinct scores.
    """
    from pyspark.sql import Window as W

    names = fitted.predictors
    base = df.select(key, "label", *names).dropna()
    blocks = max(1, -(-base.count() // block))
    copies = base.select("label", *names, F.lit("").alias("variable"), F.lit(0).alias("rep"))
    kinds = dict(base.dtypes)
    for r in range(times):
        rows = base.withColumn("_b", F.pmod(F.xxhash64(key, F.lit(3 * r)), F.lit(blocks)))
        place = lambda k: F.row_number().over(W.partitionBy("_b").orderBy(F.xxhash64(key, F.lit(k)), key))
        other = rows.withColumn("_r", place(3 * r + 1)).select("_b", "_r", *[F.col(p).alias(f"_o_{p}") for p in names])  # noqa: B023
        pairs = rows.withColumn("_r", place(3 * r + 2)).join(other, ["_b", "_r"])
        variants = F.explode(F.array(*[F.struct(F.lit(p).alias("variable"), *[F.col(f"_o_{q}" if q == p else q).cast(kinds[q]).alias(q) for q in names]) for p in names]))
        copies = copies.unionByName(pairs.select("label", variants.alias("v")).select("label", "v.*", F.lit(r).alias("rep")))
    # stored: the curves read the scores several times, and their values are read twice
    runs = scratch.stored(E.fold_runs(fitted.score(copies).withColumn("fold", F.struct("variable", "rep"))), "importance-runs")
    long = scratch.stored(E.fold_values_of(runs).select("fold.variable", "roc_auc"), "importance")
    scratch.discard(runs)
    whole = long.filter("variable = ''").select(F.col("roc_auc").alias("_all"))
    lost = long.filter("variable <> ''").groupBy("variable").agg(F.avg("roc_auc").alias("a"))
    return lost.join(F.broadcast(whole)).select("variable", (F.col("_all") - F.col("a")).alias("importance")).orderBy(F.desc("importance"), "variable")


def coefficients(fitted: Fitted) -> DataFrame:
    """(variable, estimate, std_error, statistic, p_value, lower, upper): on the link's scale (log-odds), a standard deviation, largest first."""
    if fitted.spec.type != "glm":
        raise ValueError("only a glm has coefficients")
    from pyspark.sql import SparkSession

    if fitted.additive:
        b, se = fitted.additive.beta[1:], np.sqrt(np.diag(fitted.additive.covariance))[1:]
        t = b / np.maximum(se, 1e-300)
        p = [chi_squared_tail(x * x, 1) for x in t]
    else:
        s = fitted.pipeline.stages[-1].summary
        n = len(fitted.features)
        b, se, t, p = list(fitted.pipeline.stages[-1].coefficients), s.coefficientStandardErrors[:n], s.tValues[:n], s.pValues[:n]
    rows = [(v, float(x), float(e), float(y), float(z), float(x - 1.96 * e), float(x + 1.96 * e)) for v, x, e, y, z in zip(fitted.features, b, se, t, p)]
    return SparkSession.active().createDataFrame(rows, "variable string, estimate double, std_error double, statistic double, p_value double, lower double, upper double").orderBy(F.desc(F.abs("estimate")))


def smooth_terms(fitted: Fitted, df: DataFrame | None = None) -> DataFrame:
    """(term, edf, columns, ref_df, statistic, p_value) of the smooths of a gam, the most bent first. df isn't needed."""
    from pyspark.sql import SparkSession

    a = fitted.additive
    if fitted.spec.type != "gam" or a is None:
        raise ValueError("only a gam has smooth terms")
    rows = []
    for b in a.terms:
        if b.penalties:
            statistic, reference, p = a.wald(b.name)
            rows.append((b.name, a.freedom(b.name), b.size, reference, statistic, p))
    return SparkSession.active().createDataFrame(rows, "term string, edf double, columns int, ref_df double, statistic double, p_value double").orderBy(F.desc("edf"), "term")


def partial_effects(fitted: Fitted, df: DataFrame, grid_size: int = 20, max_rows: int = 500, key: str = "station_id") -> DataFrame:
    """(variable, value, probability) over a fixed sample of the rows; every sweep is scored in one pass."""
    sample = df.select(key, *fitted.predictors).dropna().orderBy(F.xxhash64(key)).limit(max_rows).select(*fitted.predictors)
    share = [i / (grid_size - 1) for i in range(grid_size)]
    kinds = dict(sample.dtypes)
    cut = lambda p: F.array_distinct(F.transform(F.percentile(p, share), lambda v: F.round(v) if kinds[p] in ("int", "bigint") else v))
    cuts = sample.agg(*[cut(p).alias(p) for p in fitted.predictors]).unpivot([], fitted.predictors, "variable", "values").filter(F.size("values") > 1)
    swept = sample.join(F.broadcast(cuts.select("variable", F.explode("values").alias("value"))))  # predictors x grid_size values
    swept = swept.select("variable", "value", *[F.when(F.col("variable") == p, F.col("value")).otherwise(F.col(p)).alias(p) for p in fitted.predictors])
    return fitted.score(swept).groupBy("variable", "value").agg(F.avg("score").alias("probability"))


#: Distinct scores of a range that one task draws, and replicates that it draws of it.
BOOTSTRAP_SCORES = 100_000
BOOTSTRAP_TIMES = 200


def bootstrap(df: DataFrame, cutoff: float, times: int = 2000, level: float = 0.95, seed: int = 1, places: int | None = None, most: int = BOOTSTRAP_SCORES) -> DataFrame:
    """(series, lower, upper, n): percentile bounds over replicates of the held-out rows.

    Rows with equal score and label are alike, so a replicate draws their counts: a multinomial over the distinct
    scores of either class. It is split as a tree: first the counts of each class in each range of at most about `most`
    scores, from the ranges' totals, and then, in a task for each range, those of its scores. A range knows from the
    first draw what lies above it, so its parts of a replicate's areas and its best cutoff can be added to the others'.
    Each replicate, and each range of it, has a seed of its own. Draws without both classes are dropped. places: round
    scores before.
    """
    if times < 100:
        raise ValueError("at least 100 replicates are needed")
    score = F.col("score") if places is None else F.round("score", places)
    runs = scratch.stored(E.tie_runs(df.withColumn("score", score.cast("double"))), "bootstrap")
    ranges = max(1, -(-runs.count() // most))
    cuts = runs.agg(F.percentile_approx("score", [i / ranges for i in range(ranges + 1)], 10_000).alias("cuts"))  # one row
    runs = runs.join(F.broadcast(cuts)).withColumn("part", F.size(F.filter(F.slice("cuts", 2, ranges - 1), lambda c: c < F.col("score")))).drop("cuts") if ranges > 1 else runs.withColumn("part", F.lit(0))
    sums = runs.groupBy("part").agg(F.sum("pos"), F.sum("neg"), F.max("score")).orderBy("part").collect()  # a row for each range
    if not sums:
        raise ValueError("no rows to draw from")
    parts, totals, tops = [r[0] for r in sums], np.array([[r[1], r[2]] for r in sums], float), [r[3] for r in sums]
    n = int(totals.sum())
    blocks = -(-times // BOOTSTRAP_TIMES)
    values = {"half": 0.5, "best": cutoff}
    schema = "id int, p long, q long, auc double, pr double, tss double, score double, " + ", ".join(f"{x}_{name} long" for name in values for x in ("tp", "fp"))

    def drawn(pdf: pd.DataFrame) -> pd.DataFrame:
        block, part = int(pdf["block"].iloc[0]), parts.index(int(pdf["part"].iloc[0]))
        pdf = pdf.sort_values("score")
        score, pos, neg = (pdf[c].to_numpy(float) for c in ("score", "pos", "neg"))
        # of each value that is asked for, the first score that isn't below, if it is in this range
        at = {k: int(np.searchsorted(score, v)) for k, v in values.items() if v <= tops[part] and (part == 0 or v > tops[part - 1])}
        rows = []
        for i in range(block * BOOTSTRAP_TIMES, min(times, (block + 1) * BOOTSTRAP_TIMES)):
            first = np.random.default_rng([seed, i]).multinomial(n, totals.ravel() / n).reshape(totals.shape)
            all_p, all_q = (int(x) for x in first.sum(0))
            if not all_p or not all_q:
                continue
            rng = np.random.default_rng([seed, i, part])
            p, q = (rng.multinomial(m, x / x.sum()) if m else np.zeros(x.size, np.int64) for m, x in zip(first[part].tolist(), (pos, neg)))
            above_p, above_q = (int(x) for x in first[part + 1 :].sum(0))
            tp, fp = np.cumsum(p[::-1])[::-1] + above_p, np.cumsum(q[::-1])[::-1] + above_q
            auc = float((p * (all_q - fp + q / 2)).sum() / (all_p * all_q))
            seen = np.flatnonzero(p + q)[::-1]  # from the top
            pr, best = 0.0, (None, None)
            if seen.size:
                sens, prec = tp[seen] / all_p, tp[seen] / (tp[seen] + fp[seen])
                before = above_p / (above_p + above_q) if above_p + above_q else 1.0
                pr = float((np.diff(sens, prepend=above_p / all_p) * (prec + np.concatenate([[before], prec[:-1]])) / 2).sum())
                tss = sens - fp[seen] / all_q
                k = int(np.argmax(tss))
                best = float(tss[k]), float(score[seen[k]])
            counts = [int(x[at[name]]) if name in at else None for name in values for x in (tp, fp)]
            rows.append((i, all_p, all_q, auc, pr, *best, *counts))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")]).astype({c: "Int64" for name in values for c in (f"tp_{name}", f"fp_{name}")})

    spread = runs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    some = spread.groupBy("block", "part").applyInPandas(drawn, schema)
    cells = [F.max(f"{x}_{name}").alias(f"{x}_{name}") for name in values for x in ("tp", "fp")]
    # of equal bests the largest cutoff
    whole = some.groupBy("id").agg(F.max("p").alias("p"), F.max("q").alias("q"), F.sum("auc").alias("roc_auc"), F.sum("pr").alias("pr_auc"), F.max(F.struct("tss", "score"))["score"].alias("cutoff"), *cells)
    columns = {}
    for name in values:
        tp, fp = F.coalesce(f"tp_{name}", F.lit(0)), F.coalesce(f"fp_{name}", F.lit(0))  # no score reaches the value: no patch is called
        sens, spec = tp / F.col("p"), 1 - fp / F.col("q")
        columns |= {f"sens_{name}": sens, f"spec_{name}": spec, f"tss_{name}": sens + spec - 1, f"precision_{name}": F.try_divide(tp, tp + fp)}
    series = ["roc_auc", *columns, "pr_auc", "cutoff"]
    tail = (1 - level) / 2
    long = whole.withColumns(columns).unpivot([], series, "series", "value").filter(F.col("value").isNotNull())
    return long.groupBy("series").agg(F.percentile("value", tail).alias("lower"), F.percentile("value", 1 - tail).alias("upper"), F.count("*").alias("n"))


def ensemble(df: DataFrame, predictors: list[str], spec: Spec, members: int = 10, transforms: dict[str, str] | None = None) -> list[Fitted]:
    """Refits on rows drawn with replacement, powers of transforms included; a failing member is left out."""
    out = []
    for i in range(members):
        try:
            out.append(fit(df.sample(True, 1.0, seed=spec.seed + i), predictors, spec, transforms))
        except Exception as error:  # noqa: BLE001
            warnings.warn(f"ensemble member {i} failed: {error}", stacklevel=2)
    return out


#: Transforms whose power is fitted on the training rows.
POWERS = ("boxcox", "yeojohnson")
LAMBDAS = tuple(round(-2 + 0.1 * i, 1) for i in range(41))


def power_profile(df: DataFrame, column: str, kind: str, grid: list[float] | None = None, count: str | None = None) -> DataFrame:
    """(lam, log_likelihood) of Box-Cox or Yeo-Johnson powers, all in one aggregate over the column; lazy, one row for each power.

    count: a column that says for how many equal rows a row stands; the means then come from an aggregate before.
    """
    lams = list(grid or LAMBDAS)
    x = F.col(column).cast("double")
    jac = F.ln(x) if kind == "boxcox" else F.signum(x) * F.log1p(F.abs(x))
    rows = df.filter(x.isNotNull())
    powers = [power(x, lam, kind) for lam in lams]
    if count is None:
        sums = rows.agg(F.count("*").alias("n"), F.sum(jac).alias("j"), *[F.var_pop(y).alias(f"v{i}") for i, y in enumerate(powers)])
    else:
        n = F.col(count)
        means = rows.agg(*[(F.sum(n * y) / F.sum(n)).alias(f"_m{i}") for i, y in enumerate(powers)])  # one row
        off = [y - F.col(f"_m{i}") for i, y in enumerate(powers)]
        sums = rows.join(F.broadcast(means)).agg(F.sum(n).alias("n"), F.sum(n * jac).alias("j"), *[(F.sum(n * d * d) / F.sum(n)).alias(f"v{i}") for i, d in enumerate(off)])
    value = lambda i, lam: -F.col("n") / 2 * F.ln(F.col(f"v{i}")) + (lam - 1) * F.col("j")
    return sums.select(F.inline(F.array(*[F.struct(F.lit(float(lam)).alias("lam"), value(i, lam).alias("log_likelihood")) for i, lam in enumerate(lams)]))).filter("log_likelihood is not null")


def fitted_power(df: DataFrame, column: str, kind: str) -> float:
    """The power of the greatest likelihood, to a hundredth; 1 for a constant column. Equal values are raised once."""
    values = scratch.stored(df.groupBy(column).agg(F.count("*").alias("_n")), "values")
    try:
        low, high = values.agg(F.min(column), F.max(column)).first()
        if kind == "boxcox" and low is not None and low <= 0:
            raise ValueError(f"{column} has values that aren't positive")
        if low == high:
            return 1.0
        best = lambda grid: power_profile(values, column, kind, grid, "_n").agg(F.max_by("lam", F.struct("log_likelihood", "lam"))).first()[0]
        near = best(None)
        return best([round(near + i / 100, 2) for i in range(-10, 11)])
    finally:
        scratch.discard(values)


def power(x: F.Column, lam: float, kind: str) -> F.Column:
    """The transform with a given power."""
    if kind == "boxcox":
        return F.ln(x) if lam == 0 else (F.pow(x, F.lit(lam)) - 1) / F.lit(lam)
    up = F.log1p(x) if lam == 0 else (F.pow(x + 1, F.lit(lam)) - 1) / F.lit(lam)
    down = -F.log1p(-x) if lam == 2 else -(F.pow(1 - x, F.lit(2 - lam)) - 1) / F.lit(2 - lam)
    return F.when(x >= 0, up).otherwise(down)


def projected(fitted: Fitted, grid: DataFrame, members: list[Fitted] | None = None, train: DataFrame | None = None, key=("cell", "year", "month"), level: float = 0.9) -> DataFrame:
    """suitability of every complete cell of all months in one plan, with spread over members and novelty if asked."""
    out = fitted.score(grid.dropna(subset=fitted.predictors)).withColumnRenamed("score", "suitability")
    if members and len(members) > 1:
        for i, m in enumerate(members):
            out = m.score(out).withColumnRenamed("score", f"_m{i}")
        out = U.spread(out, [F.col(f"_m{i}") for i in range(len(members))], level).drop(*[f"_m{i}" for i in range(len(members))])
    if train is not None:
        out = U.novelty(out, train, fitted.predictors, list(key))
    return out
