import copy
import os

import pytest
import yaml
from pyspark.sql import functions as F

from habitat_spark.plans import config as C
from habitat_spark.plans import models as MD
from habitat_spark.queries import MOCK
from habitat_spark.sources import mock, readers
from habitat_spark.streaming import scoring


def changed(**sections):
    out = copy.deepcopy(MOCK)
    for k, v in sections.items():
        out.setdefault(k, {}).update(v)
    return out


def test_config_round_trip(tmp_path):
    path = tmp_path / "run.yaml"
    C.save(C.resolve(MOCK), str(path))
    assert C.load(str(path))["species"]["name"] == "cfin_total"
    with pytest.raises(C.ConfigError):
        C.save({"species": {}}, str(tmp_path / "bad.yaml"))
    assert not (tmp_path / "bad.yaml").exists()


@pytest.mark.parametrize("sections", [
    {"species": {"name": None}}, {"species": {"threshold": {"method": "percentile", "value": 2}}}, {"model": {"type": "svm"}}, {"model": {"bootstrap": 50}}, {"study_area": {"xmin": 10.0}},
    {"covariates": {"prejoin": [{"type": "upscale", "covariate": "SST"}]}}, {"covariates": {"prejoin": [{"type": "upscale", "covariate": "SST", "to": 1.0, "method": "idw"}]}}, {"covariates": {"prejoin": [{"type": "fill_gaps", "covariate": "SST", "from": "CHL"}]}},
    {"covariates": {"steps": [{"type": "contour_distance", "var": "SST"}]}}, {"covariates": {"source": "parquet"}}, {"species": {"active": "nobody"}}, {"model": {"offset": "CHL"}}, {"model": {"bs": "zz"}}, {"model": {"bs": {"CHL": "cr"}}}, {"model": {"link": "nonsense"}}, {"model": {"family": "nonsense"}}, {"model": {"bogus": 1}}, {"bogus": {}}, {"model": {"k": 3}}, {"model": {"family": "logit", "link": "logit"}},
    {"projection": {"uncertainty": {"bogus": 1}}}, {"projection": {"uncertainty": {"kind": "none"}}}, {"covariates": {"log_transform": ["SST"], "transforms": {"SST": "sqrt"}}}, {"covariates": {"log_transform": ["CHL"]}},
    {"covariates": {"variables": ["SST", "SST"]}}, {"covariates": {"steps": [{"type": "lag", "var": "CHL"}]}}, {"covariates": {"transforms": {"NO": "log"}}}, {"covariates": {"grid": "other"}}, {"dates": {"training": {"years": [2019, 2018], "months": [1, 2]}}},
])
def test_bad_settings(sections):
    with pytest.raises(C.ConfigError if "model" not in sections or "type" not in sections["model"] else ValueError):
        C.resolve(changed(**sections))


def test_other_names_of_settings():
    v = C.resolve(changed(model={"family": "cauchit", "bs": {"SST": "cr", "jday": "cc"}, "method": "P-REML"}, projection={"uncertainty": {"method": "bootstrap", "replicates": 50}}, covariates={"log_transform": ["SST"]})).values
    assert v["model"]["link"] == "cauchit" and C.uncertainty(v) == {"kind": "bootstrap", "members": 50, "level": 0.9, "novelty": True} and v["covariates"]["transforms"] == {"SST": "abs_log"}


def test_periods_are_sets():
    v = C.resolve(changed(dates={"projection": {"years": [2030, 2031], "months": [1, 1]}})).values
    assert C.periods(v) == ([2018, 2019, 2030, 2031], [1, 6, 7, 8])
    assert C.progress("fitting the model") == 0.85


def ready(spark, **sections):
    from habitat_spark.plans import pipeline as P

    return P.prepare(spark, C.resolve(changed(**sections)))


def test_products_and_their_grid(spark):
    """The grid that a run lands on, what is drawn out on it, and single covariates put on other grids before."""
    two = [{"variables": ["SST", "SSS"]}, {"variables": ["CHL"], "resolution": 0.5}]
    finest, coarsest = (ready(spark, covariates={"variables": [], "products": two, "grid": g}) for g in ("finest", "coarsest"))
    assert finest.spacing_u == 250_000 and finest.upsampled == ["CHL"] and finest.names == ["SST", "SSS", "CHL"]
    assert coarsest.spacing_u == 500_000 and coarsest.upsampled == [] and coarsest.names == ["CHL", "SST", "SSS"]
    assert finest.field.count() == 17 * 13 * 6 and coarsest.field.count() == 9 * 7 * 6
    assert finest.field.select("year", "month", "CHL").distinct().count() == 9 * 7 * 6  # each value stands in all cells around it
    made = ready(spark, covariates={"variables": [], "products": two, "prejoin": [{"type": "upscale", "covariate": "SSS", "to": "CHL", "method": "median"}]})
    assert made.upsampled == ["CHL", "SSS"] and made.field.select("year", "month", "SSS").distinct().count() == 9 * 7 * 6
    smooth = ready(spark, covariates={"variables": [], "products": two, "prejoin": [{"type": "downscale", "covariate": "CHL", "to": "SST", "method": "bilinear"}]})
    assert smooth.upsampled == [] and smooth.field.select("year", "month", "CHL").distinct().count() > 9 * 7 * 6
    degrees = ready(spark, covariates={"variables": [], "products": two, "prejoin": [{"type": "upscale", "covariate": "SST", "to": 1.0}]})
    assert degrees.upsampled == ["CHL", "SST"] or set(degrees.upsampled) == {"CHL", "SST"}


def test_gaps_layers_and_series(spark):
    two = [{"variables": ["CHL"]}, {"variables": ["CHL_MODEL"], "resolution": 0.5}]
    fill = {"type": "fill_gaps", "covariate": "CHL", "from": "CHL_MODEL"}
    plain = ready(spark, covariates={"variables": [], "products": two, "prejoin": [fill]})
    kept = ready(spark, covariates={"variables": [], "products": two, "prejoin": [fill | {"keep_source": True, "rescale": True}]})
    assert plain.names == ["CHL"] and kept.names == ["CHL", "CHL_MODEL"] and "CHL_source" in plain.field.columns
    deep = ready(spark, covariates={"bathymetry": ["DEPTH"], "climate": ["NAO"], "steps": [{"type": "isobath_distance", "levels": [100, 200]}, {"type": "shore_distance"}, {"type": "temporal_gradient", "var": "SST", "per": "day"}]})
    assert deep.predictors[-2:] == ["NAO", "DEPTH"] and {"isobath_dist_100", "isobath_dist_200", "shore_distance", "SST_dt"} <= set(deep.names)
    assert deep.data.filter("DEPTH is null or NAO is null").count() == 0 and deep.data.count() > 100
    assert deep.field.agg({"shore_distance": "min"}).first()[0] == 0
    without = ready(spark, covariates={"exclude": ["SSS"], "derived": []})
    assert without.predictors == ["SST"]
    with pytest.raises(C.ConfigError):
        ready(spark, covariates={"steps": [{"type": "shore_distance"}]})


def test_powers_are_fitted(spark):
    df = spark.range(400).select("id", (1 + (F.col("id") % 50)).cast("double").alias("x"))
    squares = df.withColumn("x", F.pow("x", F.lit(3.0)))
    assert MD.fitted_power(squares, "x", "boxcox") == pytest.approx(MD.fitted_power(df, "x", "boxcox") / 3, abs=0.02)
    assert MD.fitted_power(df.withColumn("x", F.lit(2.0)), "x", "yeojohnson") == 1.0
    with pytest.raises(ValueError):
        MD.fitted_power(df.withColumn("x", -F.col("x")), "x", "boxcox")
    rows = squares.withColumn("label", (F.rand(3) < F.col("x") / 200_000).cast("int"))
    m = MD.fit(rows, ["x"], MD.Spec(type="glm"), {"x": "boxcox"})
    assert 0 < m.score(rows).agg(F.avg("score")).first()[0] < 1


def test_pipeline_finds_the_planted_signal(spark, tmp_path):
    from habitat_spark.plans import pipeline as P

    run = P.run(spark, C.resolve(changed(covariates={"transforms": {"SST": "yeojohnson"}}, model={"type": "rf", "trees": 10, "folds": 3, "bootstrap": 200, "importance": 1}, projection={"uncertainty": {"level": 0.5}})))
    auc = run.evaluation.filter("metric = 'roc_auc'").first()
    assert auc["value"] > 0.7 and auc["lower"] < auc["value"] < auc["upper"]
    rows = run.projection.agg({"suitability": "min"}).first()[0], run.projection.agg({"suitability": "max"}).first()[0]
    assert 0 <= rows[0] <= rows[1] <= 1
    assert {"suitability_sd", "novelty", "novel_variable"} <= set(run.projection.columns)
    first = run.tables["importance"].first()
    assert first["importance"] > 0 and {r["variable"] for r in run.tables["partial_effects"].collect()} <= set(run.model.predictors)
    folder = "file://" + str(tmp_path / "out")
    P.write(run, folder)
    P.export(spark, folder, str(tmp_path / "export"))
    assert spark.read.parquet(folder + "/suitability").count() == run.projection.count() == spark.read.csv(str(tmp_path / "export" / "suitability_csv"), header=True).count()
    assert spark.read.parquet(str(tmp_path / "export" / "stack")).columns[3:] == ["2019_06", "2019_07", "2019_08"]
    assert spark.read.csv(folder + "/importance", header=True).count() == len(run.model.predictors)
    assert {r["fold"] for r in spark.read.csv(folder + "/roc_curve_by_fold", header=True).collect()} == {"0", "1", "2"}
    values = yaml.safe_load((tmp_path / "out" / "threshold.yaml").read_text())
    assert values["cutoff_lower"] <= values["cutoff"] <= values["cutoff_upper"] and values["predictors"] == run.model.predictors
    stages = [t.scratch_path for t in run.stages]
    assert len(stages) > 5 and any(os.path.exists(x) for x in stages)
    run.release()
    assert not any(os.path.exists(x) for x in stages)


def test_members_are_of_the_same_model(spark):
    from habitat_spark.plans import pipeline as P

    run = P.run(spark, C.resolve(changed(covariates={"transforms": {"SST": "fourth_root", "SSS": "boxcox"}}, model={"type": "glm", "folds": 2, "bootstrap": 0, "importance": 0}, projection={"uncertainty": {"kind": "bootstrap", "members": 2}})), project=False)
    assert len(run.members) == 2
    for m in run.members:
        assert [set(x) for x in m.stages] == [{"SST", "SSS"}] == [set(x) for x in run.model.stages]
        assert str(m.stages[0]["SST"]) == str(run.model.stages[0]["SST"])
    run.release()


def test_a_failing_diagnostic_is_a_warning(spark, monkeypatch):
    from habitat_spark.plans import pipeline as P

    def fails(*_):
        raise RuntimeError("not today")

    monkeypatch.setattr(MD, "importance", fails)
    monkeypatch.setattr(MD, "bootstrap", fails)
    with pytest.warns(UserWarning, match="not today"):
        run = P.run(spark, C.resolve(changed(model={"type": "glm", "folds": 2, "bootstrap": 100, "importance": 1})), project=False)
    assert "importance" not in run.tables and "partial_effects" in run.tables and "lower" not in run.evaluation.columns
    run.release()


def test_tuning_takes_the_best_setting(spark):
    rows = spark.range(600).select(F.col("id").alias("station_id"), F.rand(1).alias("a"), F.rand(2).alias("b")).withColumn("label", ((F.col("a") > 0.5) != (F.col("b") > 0.5)).cast("int"))
    weak, strong = MD.Spec(type="brt", trees=1, depth=1), MD.Spec(type="brt", trees=8, depth=4, rate=0.3)
    assert MD.tuned(rows, ["a", "b"], [weak, strong, weak], 2) == strong
    for kind, changes in (("rf", {"mtry", "min_n"}), ("brt", {"depth", "rate"}), ("gam", {"gamma"})):
        specs = MD.settings_of(MD.Spec(type=kind), 6, 4)
        assert specs[0] == MD.Spec(type=kind) and len(set(specs)) == len(specs) > 3
        assert {k for x in specs[1:] for k in vars(x) if vars(x)[k] != vars(specs[0])[k]} == changes


@pytest.mark.parametrize("settings", [{"type": "brt", "trees": 5}, {"type": "glm"}, {"type": "gam"}, {"type": "rf", "trees": 5, "tune": True, "tune_grid": 2}])
def test_every_type_beats_chance(spark, settings):
    from habitat_spark.plans import pipeline as P

    run = P.run(spark, C.resolve(changed(model={**settings, "folds": 2, "bootstrap": False, "importance": 0})), project=False)
    assert run.evaluation.filter("metric = 'roc_auc'").first()["value"] > 0.6
    if settings["type"] == "glm":
        sizes = [abs(r["estimate"]) for r in run.tables["coefficients"].collect()]
        assert sizes == sorted(sizes, reverse=True)
    if settings["type"] == "gam":
        terms = run.tables["smooth_terms"].collect()
        assert terms and all(0 < r["edf"] <= r["columns"] for r in terms)


def test_importance_finds_what_matters(spark):
    rows = spark.range(2000).select(F.col("id").alias("station_id"), F.rand(1).alias("a"), F.rand(2).alias("b")).withColumn("label", (F.col("a") + 0.2 * F.rand(3) > 0.6).cast("int")).persist()
    m = MD.fit(rows, ["a", "b"], MD.Spec(type="glm"))
    for block in (100_000, 300):
        got = {r["variable"]: r["importance"] for r in MD.importance(m, rows, 2, block=block).collect()}
        assert got["a"] > 0.3 and abs(got["b"]) < 0.02


def test_generated_settings(tmp_path):
    made = C.generate(str(tmp_path / "new.yaml"), "cfin_total", (2003, 2017), (1, 12), {"xmin": -76, "xmax": -65, "ymin": 35, "ymax": 45}, ["SST"], model={"type": "glm"})
    assert made["model"]["type"] == "glm" and made["model"]["trees"] == 500 and C.load(str(tmp_path / "new.yaml")).values == made.values
    assert C.resolve(changed(species={"name": None, "active": "pcal"}))["species"]["prefix"] == "pseudo"


def test_links_and_transforms(spark):
    df = spark.createDataFrame([(0.0, 1), (2.0, 0)], "x double, label int")
    with pytest.raises(ValueError):
        MD.check_transforms(df, {"x": "log"})
    assert MD.resolve_type(None, "xgboost") == "brt" and MD.resolve_type() == "rf"


def test_station_file(spark, tmp_path):
    s = mock.stations(spark, (2018, 2018), (6, 8), (-70, -66, 41, 44), 50)
    path = str(tmp_path / "stations")
    s.coalesce(1).write.csv(path, header=True)
    got = readers.read_stations(spark, path, {"lon": "lon", "lat": "lat", "year": "year", "month": "month", "day": "day", "dataset": "dataset"}, ["cfin_CV", "cfin_CVI"])
    assert got.count() == 50 and got.filter("abundance > 0").count() == 50
    with pytest.raises(ValueError):
        readers.read_stations(spark, path, {"lon": "nowhere"}, "cfin_CV")


def test_stream(spark, tmp_path):
    from pyspark.sql import functions as F

    from habitat_spark.sources import adapters as A
    from .conftest import SMALL

    s = A.stations(spark, SMALL).limit(100)
    s.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(s.schema).parquet(str(tmp_path / "in"))
    out = scoring.scored(stream, A.grid(spark, SMALL), ["sst"], A.LATTICE, lambda: F.col("sst") / 50)
    q = out.writeStream.format("memory").queryName("scored").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("scored").count() == 100


def test_trees_on_distinct_rows(spark, monkeypatch):
    """Where many rows are alike, trees get each distinct one once, with its count; the models stay what they were."""
    rows = spark.range(6000).select((F.col("id") % 20).cast("double").alias("x"), (F.col("id") % 7).cast("double").alias("y"), ((F.col("id") * 37 + F.col("id") % 20 * 211) % 4000 < F.col("id") % 20 * 200).cast("int").alias("label"))
    fits = {}
    for large in (10**9, 1000):
        monkeypatch.setattr(MD, "LARGE", large, raising=False)
        for kind in ("rf", "brt"):
            fits[kind, large] = MD.fit(rows, ["x", "y"], MD.Spec(type=kind, trees=20, depth=3, rate=0.2, min_n=30))
    scores = {k: {(r["x"], r["y"]): r["score"] for r in m.score(rows.select("x", "y").distinct()).collect()} for k, m in fits.items()}
    assert fits["brt", 1000].pipeline.stages[-1].getOrDefault("weightCol") == "_n"
    assert all(abs(v - scores["brt", 10**9][k]) < 1e-9 for k, v in scores["brt", 1000].items())
    assert max(abs(v - scores["rf", 10**9][k]) for k, v in scores["rf", 1000].items()) < 0.1
    forest = fits["rf", 1000].pipeline.stages[-1]
    # distinct rows, not all, are counted in the trees, each tree with counts of its own
    sums = {round(t._java_obj.rootNode().impurity(), 12) for t in forest.trees}
    assert forest.getNumTrees == 20 and len(sums) > 10 and fits["rf", 1000].spec.trees == 20


def test_few_alike_rows_are_fitted_as_they_are(spark, monkeypatch):
    monkeypatch.setattr(MD, "LARGE", 100)
    rows = spark.range(400).select((F.col("id") * 0.37 % 1).alias("x"), (F.col("id") * 0.37 % 1 > 0.5).cast("int").alias("label"))
    model = MD.fit(rows, ["x"], MD.Spec(type="brt", trees=2)).pipeline.stages[-1]
    assert not model.isSet("weightCol")
