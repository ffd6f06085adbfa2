"""Problem 10: cut texts."""

from pyspark.sql import functions as F

from quarrystone.llm.truncation import _measured, ending_form, ending_forms, find_truncated, source_limits

SCHEMA = "doc_id long, text string, source string, cut string"


def _limited():
    full = "The phases were shaken and then separated by hand before each sample was counted again. "
    rows = [(i, (f"{i} " + full * 9)[: 100 + i] + ".", "a", None) for i in range(60)]
    rows += [(100 + i, (f"{i} " + full * 9)[:197] + "ab", "a", None) for i in range(20)]  # 199 characters, within a word
    rows += [(200 + i, (f"{i} " + full * 9)[:196] + "...", "a", None) for i in range(5)]
    rows += [(205, ("205 " + full * 9)[:194].rstrip() + "...", "a", None)]
    rows += [(300 + i, (f"{i} " + full * 9)[:198] + ".", "a", None) for i in range(5)]  # complete at the limit
    return rows


def test_limit_and_endings(spark):
    df = spark.createDataFrame(_limited(), SCHEMA)
    assert [(r["kind"], r["top"]) for r in source_limits(_measured(df, "doc_id", "text", "source")).collect() if r["kind"] == "chars"] == [("chars", 199)]
    out = {r["doc_id"]: r for r in find_truncated(df, "doc_id", "text", "source").collect()}
    assert {i for i, r in out.items() if r["cut"]} == {*range(100, 120), *range(200, 206)}
    assert out[100]["evidence"] == "limit" and out[0]["evidence"] is None


def test_transfer_and_edges(spark):
    rows = [(1, "It ended.", "b", None), (2, "It ended within a wo", "b", None), (3, None, "b", None), (4, "", None, None), (5, "  \n", "b", None), (6, "Fine.\nStatus: open \n", "b", None), (11, "Good.\nStatus: open", "b", None), (12, "Good.\nStatus: open", "b", None), (13, "Once.\nStatus: shut", "b", None), (7, "Fine.\nStatus: op", "b", None), (8, "x" * 100_000, None, None), (9, "終わった。", "b", None), (9, "終わった。", "b", None), (10, 'He said "so."', "b", None)]
    out = find_truncated(spark.createDataFrame(rows, SCHEMA), "doc_id", "text", "source").collect()
    assert sorted(r["doc_id"] for r in out if r["cut"]) == [2, 7, 8, 13] and len(out) == 14
    assert all(r["evidence"] == "transfer" for r in out if r["cut"])
    assert find_truncated(spark.createDataFrame([], SCHEMA), "doc_id", "text", "source").count() == 0


def test_forms_of_last_lines(spark):
    cases = [("a\n- Ce: log D = -1.98 \n", "- … 0.00"), ("- Ce: log D = 11.9", "- … 0.0"), ("| Yb | 12 |", "| … |"), ("-- me, page 214", "-- … -- me, page 0"), ("Keywords: b; Third phase", "Keywords: … third phase"), ("2021-10-01 12:06 | Lu | log D 0.72", "0 … log d 0.00"), ("", " … "), (None, None), ("word " * 50_000 + "; end", "word … end")]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string")
    assert [r["f"] for r in df.select("i", ending_form(F.col("t")).alias("f")).orderBy("i").collect()] == [f for _, f in cases]


def test_a_form_counts_once_per_text(spark):
    """Copies of one cut text do not make its ending a complete form, and forms met in several texts are learned."""
    rows = [(i, "We saw a drop in the", "a", None) for i in range(50)] + [(100 + i, f"Note {i}.\nSee Table {i}", "a", None) for i in range(5)] + [(200, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert [tuple(r) for r in ending_forms(df, "doc_id", "text", "source").collect()] == [("See … see table 0", 5)]
    assert {r["doc_id"] for r in find_truncated(df, "doc_id", "text", "source").where("cut").collect()} == set(range(50))
