"""Rows without an id and rows that share one, in the stages that drop rows."""

import random

import corpus_pipeline


def prose(seed, n=60):
    return " ".join(f"w{random.Random(seed * 1000 + i).randrange(5000)}" for i in range(n))


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def kept(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)


def test_near_duplicates_by_row(spark, tmp_path):
    rows = [(None, prose(1)), (None, prose(2)), (None, prose(3)), (7, prose(3)), (8, prose(4)), (8, prose(4)), (9, prose(5)), (9, prose(6)), (10, prose(6)), (None, prose(7)), (None, prose(7))]
    want = [(None, prose(1)), (None, prose(2)), (7, prose(3)), (8, prose(4)), (9, prose(5)), (9, prose(6)), (None, prose(7))]
    assert kept(corpus_pipeline.near_duplicates(spark, frame(spark, rows).repartition(3), str(tmp_path))) == sorted(want, key=repr)


def test_decontamination_by_row(spark, tmp_path):
    spark.createDataFrame([(0, prose(1))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(None, prose(1)), (None, prose(2)), (3, prose(1)), (3, prose(3)), (4, prose(4)), (4, prose(4))]
    want = [(None, prose(2)), (3, prose(3)), (4, prose(4)), (4, prose(4))]
    assert kept(corpus_pipeline.decontamination(spark, frame(spark, rows), str(tmp_path))) == sorted(want, key=repr)


def tables(spark, tmp_path, rows):
    """documents with columns named like those that stages use inside, benchmark and labels, under a folder."""
    names = ["_row", "_row_", "row", "id", "node", "key", "root", "uid", "fp", "score", "_score", "ids", "marks", "size"]
    schema = "doc_id long, text string, n_chars long, " + ", ".join(f"{n} string" for n in names)
    docs = spark.createDataFrame([(d, t, len(t or ""), *[f"{n} of {d}" for n in names]) for d, t in rows], schema)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, prose(90))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(d, 1, 0) for d in range(4)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return names


def test_columns_whose_names_clash(spark, tmp_path):
    rows = [(i, prose(i)) for i in range(12)] + [(50, prose(3)), (51, prose(90)), (52, None), (None, "password = abcdefgh1 " + prose(60))]
    names = tables(spark, tmp_path, rows)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    want = {"near duplicates": {d for d, _ in rows} - {50}, "decontamination": {d for d, _ in rows} - {51}, "secret scans": {d for d, _ in rows}}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        kept_rows = out.collect()
        assert all(r[n] == f"{n} of {r['doc_id']}" for r in kept_rows for n in names)
        if name in want:
            assert {r["doc_id"] for r in kept_rows} == want[name], name
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert all(r["round_trip"] for r in out) and len({r["doc_id"] for r in out}) == len(out) and {r["doc_id"] for r in out} <= want["near duplicates"] & want["decontamination"]


def test_empty_tables(spark, tmp_path):
    tables(spark, tmp_path, [])
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
