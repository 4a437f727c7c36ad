import pytest
from pyspark.sql import functions as F

from habitat_spark.functions import headers as H
from habitat_spark.functions import scalars as S


def column(spark, values, kind, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("x")).alias("y")).collect()]


def test_dates(spark):
    values = ["05-JAN-03", "17-jun-11", "14-MAR-77", "14-MAR-99", "14-MAR-00", "05-JAN-2003", "2003-01-05", "01/05/03", "31-FEB-03", "x", None, ""]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    y, m, d = S.split_date(F.col("x"))
    got = [tuple(r) for r in rows.orderBy("i").select(y, m, d).collect()]
    assert got == [(2003, 1, 5), (2011, 6, 17), (1977, 3, 14), (1999, 3, 14), (2000, 3, 14), (2003, 1, 5), (2003, 1, 5), (2003, 1, 5), *[(None, None, None)] * 4]


def test_thresholds_round_half_even(spark):
    got = column(spark, [9573.412, 46160.0, 1600.0, 1400.0, 120.0, 0.4, 2500.0], "double", S.rounded_threshold)
    assert got == [10000, 46000, 2000, 1400, 120, 0.4, 2000]


def test_transforms(spark):
    assert column(spark, [1.0, 10.0, -100.0], "double", lambda x: F.round(S.transform("log10", x), 9)) == [0, 1, 2]
    assert column(spark, [4.0, 9.0], "double", lambda x: S.transform("sqrt", x)) == [2, 3]
    assert column(spark, [16.0, 81.0], "double", lambda x: F.round(S.transform("fourth_root", x), 9)) == [2, 3]
    assert column(spark, [0.0, None], "double", lambda x: S.transform("log", x)) == [None, None]


def test_units_and_names():
    assert [H.abundance_units(s) for s in ("_10M2", "_100M3", "_M2")] == [(10, "M2"), (100, "M3"), (1, "M2")]
    names = H.taxon_shorthands(["CALANUS_FINMARCHICUS", "CENTROPAGES_TYPICUS", "CALANIDAE", "PSEUDOCALANUS_SPP"])
    assert list(names.values()) == ["cfin", "ctyp", "cala", "pcal"]
    assert list(H.taxon_shorthands(["OITHONA_SPP", "ONCAEA_SPP"]).values()) == ["oitspp", "oncspp"]
    assert list(H.taxon_shorthands(["OITHONA_SPP", "CALANUS_FINMARCHICUS"]).values()) == ["ospp", "cfin"]
    assert list(H.taxon_shorthands(["PSEUDOCALANIDAE", "PSEUDODIAPTOMIDAE"]).values()) == ["pseudoc", "pseudod"]
    assert set(H.taxon_shorthands(["CALANUS_FINMARCHICUS", "calanus_finmarchicus"]).values()) == {"cfin"}
    with pytest.warns(UserWarning):
        H.taxon_shorthands(["ABCDEFGHIJKLMNOPQRSTUV_X", "ABCDEFGHIJKLMNOPQRSTUW_X"])


def test_raw_header():
    header = ["STATION", "LATITUDE", "LONGITUDE", "DATE", "CALANUS_FINMARCHICUS_CV_VI_10M2", "CALANUS_FINMARCHICUS_10M2", "DEPTH"]
    assert H.is_raw_export(header) and not H.is_raw_export([*header, "lat"])
    taxa = H.zoop_taxa(header)
    assert [(t.taxon, t.stage, t.name) for t in taxa] == [("CALANUS_FINMARCHICUS", "CV_VI", "cfin_CV_VI"), ("CALANUS_FINMARCHICUS", None, "cfin_total")]
    assert H.raw_suffix(header) == "_10M2"


def test_stage_columns():
    header = ["cfin_CIV", "cfin_CV", "cfin_CVI", "cfin_CV_VI", "cfin_total"]
    assert H.stage_columns(header, "cfin") == header[:-1]
    assert H.stage_columns(header, "cfin", ["CIV", "adult"]) == ["cfin_CIV", "cfin_CV_VI"]
    for stages in (["CX"], ["CV", "adult"]):
        with pytest.raises(ValueError):
            H.stage_columns(header, "cfin", stages)
    with pytest.raises(ValueError):
        H.stage_columns(header, "ctyp")


def test_resolution():
    assert H.dataset_resolution("a_0.083deg_P1M-m") == (0.083, "P1M")
    assert H.dataset_resolution("b_4km_P1D")[1] == "P1D"


def test_one_format_for_a_column(spark):
    from habitat_spark.sources import readers

    frame = lambda *values: spark.createDataFrame([(v,) for v in values], "DATE string")
    rows = readers.split_dates(frame("05-JAN-03", None, "14-mar-77", " "))
    assert [tuple(r) for r in rows.collect()] == [(2003, 1, 5), (None,) * 3, (1977, 3, 14), (None,) * 3]
    assert readers.split_dates(frame("01/05/2003", "12/31/1999"), keep=True).columns == ["DATE", "year", "month", "day"]
    for bad in (("05-JAN-03", "2003-01-05"), (None, "")):  # two formats; nothing at all
        with pytest.raises(ValueError):
            readers.split_dates(frame(*bad))
    with pytest.raises(ValueError):
        readers.split_dates(frame("05-JAN-03"), "WHEN")
    with pytest.warns(UserWarning, match="years to come"):
        readers.split_dates(frame("05-JAN-68"))


def test_lines(spark, tmp_path):
    from habitat_spark.sources import readers

    for i in (1, 2):
        (tmp_path / f"f{i}.txt").write_text(f"title\nDEPTH,TEMP,NA\nM,C,\n{i}, 4.5,x\n{i},-9999,y\n\n")
    rows = readers.read_lines(spark, str(tmp_path), [2, 3], 4)
    assert rows.columns == ["DEPTH_M", "TEMP_C"]
    assert sorted(map(tuple, rows.collect()), key=repr) == [("1", "4.5"), ("1", None), ("2", "4.5"), ("2", None)]


def test_species_in_order():
    header = ["LATITUDE", "LONGITUDE", "DATE", "METRIDIA_LUCENS_10M2", "CALANUS_FINMARCHICUS_10M2"]
    assert H.available_species(header) == ["cfin", "mluc"] and list(H.species_catalog(header)) == ["cfin", "mluc"]


def test_catalog():
    from habitat_spark.plans import catalog as K

    assert K.axis("SST") == "SST (degrees C)" and K.axis("nothing") == "nothing" and K.label("CHL").startswith("CHL - ")
    assert K.gridded()["SST"].resolution == (0.083, "P1M") and set(K.static()) == {"DEPTH", "SLOPE", "ASPECT"}
    assert {"SST", "DEPTH", "NAO", "jday", "front_distance"} <= {c.name for c in K.info()} and "jday" not in {c.name for c in K.info(False)}
    ramp = K.ramp(-50.0, 50.0)
    assert ramp[3] == 0.5 and K.ramp(10.0, 50.0)[3] == 0.02 and K.ramp(None, None)[1] == 0.2 and len(ramp) == 6


def test_doubtful_names(spark, tmp_path):
    from habitat_spark.sources import readers

    def doubts(*columns):
        import warnings

        with warnings.catch_warnings(record=True) as found:
            warnings.simplefilter("always")
            H.check_taxa(H.zoop_taxa(list(columns)), list(columns))
        return " ".join(str(w.message) for w in found)

    assert doubts("CALANUS_FINMARCHICUS_10M2", "METRIDIA_LUCENS_CIV_10M2") == ""
    assert "inside" in doubts("CALANUS_CIV_ODD_10M2")
    assert "several ways" in doubts("Calanus_finmarchicus_CV_10M2", "CALANUS_FINMARCHICUS_CIV_10M2")
    assert "begin the names" in doubts("CALANUS_10M2", "CALANUS_SPP_10M2")
    assert "units" in doubts("CALANUS_SPP_10M2", "METRIDIA_SPP_100M3")
    with pytest.raises(ValueError):
        doubts("CALANUS_FINMARCHICUS_10M2", "CALANUS_FINMARCHICUS_TOTAL_10M2")
    spark.createDataFrame([(1, 2, 3, 4)], "cfin_CIV int, cfin_CV_VI int, cfin_CI_IV int, cfin_total int").coalesce(1).write.csv(str(tmp_path / "s"), header=True)
    assert readers.available_stages(spark, str(tmp_path / "s"), "cfin") == ["CIV", "adult"]
    assert readers.available_stages(spark, str(tmp_path / "s"), "cfin", False) == ["CIV", "CV_VI", "CI_IV"]
