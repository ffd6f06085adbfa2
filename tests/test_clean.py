"""Cleaning expressions."""

from pyspark.sql import functions as F

from quarrystone.functions.clean import date_key, doi_list, is_blank, label_key, smiles_key, split_role


def _map(spark, f, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["x"] for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_dates(spark):
    assert _map(spark, date_key, ["2018-08-10", "18 March 2022", "20120220", "2022/01/04", "01.12.2012", "2012-01-02T00:00:00Z", "1 April 2014", "Apr 3, 2014", "- -", "", None, "99999999", "soon"]) == [20180810, 20220318, 20120220, 20220104, 20121201, 20120102, 20140401, 20140403, None, None, None, None, None]


def test_blanks_labels_splits(spark):
    assert _map(spark, is_blank, [None, "", " - - ", "N/A", " ", "NaN", "x"]) == [True] * 6 + [False]
    assert _map(spark, label_key, ["CT-0000058 ", "ct 0000058", None, "?"]) == ["ct0000058", "ct0000058", None, None]
    assert _map(spark, split_role, [" TRAIN", "val", "Valid", "validation ", "test", "x", None]) == ["train", "validation", "validation", "validation", "test", None, None]


def test_references_and_structures(spark):
    got = _map(spark, lambda c: doi_list(c, ("10.99000/archive.self",)), ["DOI 10.99000/ARCHIVE.SELF., http://dx.doi.example/10.9901/A.1", "doi:10.9901/a.1, 10.9901/a.1", None, "none"])
    assert got == [["10.9901/a.1"], ["10.9901/a.1"], [], []]
    assert _map(spark, lambda c: doi_list(c, ()), ["https://doi.example/10.99218/Metsep.2015.1, DOI 10.99219/x.2."]) == [["10.99218/metsep.2015.1", "10.99219/x.2"]]
    assert _map(spark, smiles_key, ["B.A", "A.B", "A", "", None]) == ["A.B", "A.B", "A", None, None]
    assert _map(spark, smiles_key, ["B.A\t", " B . A", "A\n.B", "\u00a0A.B", "\t", "n/a"]) == ["A.B"] * 4 + [None, None]
