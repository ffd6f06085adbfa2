"""Queries of problem 4."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrystone.functions.clean import doi_list, label_key, squeeze
from quarrystone.llm.split_search import connected_components, search_splits, tie_edges
from quarrystone.sources.tables import cut, table

SELF = "10.99000/archive.self"
SHARES = {"train": 0.8, "validation": 0.1, "test": 0.1}


def _named(kind, column):
    return F.array(F.concat(F.lit(kind), column))


def _row_nodes():
    """The publications, the extractant and the chemotype of a dataset row as node names."""
    return F.transform(doi_list(F.col("doi"), (SELF,)), lambda p: F.concat(F.lit("p:"), p)), _named("e:", squeeze(F.col("extractant"))), _named("c:", label_key(F.col("chemotype")))


def _copies(spark, d):
    known = table(spark, d, "leakage_publication_components", "publication", "group_cross_publication_copy").where("publication IS NOT NULL")
    return known, tie_edges(known, _named("p:", F.lower(squeeze(F.col("publication")))), _named("g:", squeeze(F.col("group_cross_publication_copy"))))


def _components(spark, d):
    rows = table(spark, d, "dataset", "doi", "extractant", "chemotype")
    known, copies = _copies(spark, d)
    return known, connected_components(tie_edges(rows, *_row_nodes()).union(copies))


def p4_found(spark, d):
    """The smallest publication of every group of tied publications, paired with each other one."""
    known, components = _components(spark, d)
    mine = known.select("publication").distinct().join(components, F.concat(F.lit("p:"), F.lower(squeeze(F.col("publication")))) == F.col("node")).select("publication", "component")
    first = mine.groupBy("component").agg(F.min("publication").alias("publication_a"))
    return mine.join(first, "component").where(F.col("publication") > F.col("publication_a")).select("publication_a", F.col("publication").alias("publication_b"))


def _assigned(spark, d):
    """Every dataset row with its component, its split and its label. Rows tied to nothing are components of their own."""
    _, components = _components(spark, d)
    rows = table(spark, d, "dataset", "row_id", "doi", "extractant", "chemotype", "metal_symbol")
    pubs, ext, chem = _row_nodes()
    node = F.try_element_at(F.array_sort(F.filter(F.concat(pubs, ext, chem), lambda x: x.isNotNull())), F.lit(1))
    rows = rows.select("row_id", F.coalesce(node, F.concat(F.lit("r:"), F.col("row_id"))).alias("node"), F.col("metal_symbol").alias("label"))
    nodes = rows.groupBy("node", "label").agg(F.count("*").alias("n"))
    sizes = nodes.join(components, "node", "left").groupBy(F.coalesce("component", "node").alias("component"), "label").agg(F.sum("n").alias("n"))
    chosen = search_splits(sizes, SHARES)
    by_node = nodes.select("node").distinct().join(components, "node", "left").select("node", F.coalesce("component", "node").alias("component")).join(chosen, "component")
    return rows.join(by_node, "node").select("row_id", "component", "label", "split")


def p4_splits(spark, d):
    """The split of every row."""
    return _assigned(spark, d).select("row_id", "component", "split")


def p4_balance(spark, d):
    """How far the splits are from their shares: rows, share, and the largest deviation of a metal's share from the whole table's."""
    rows = cut(_assigned(spark, d).groupBy("split", "label").agg(F.count("*").alias("n")))
    whole = rows.groupBy("label").agg(F.sum("n").alias("all_n"))
    total = rows.agg(F.sum("n")).scalar()
    of = rows.groupBy("split").agg(F.sum("n").alias("split_n"))
    per = rows.join(of, "split").join(whole, "label")
    return per.groupBy("split").agg(F.max("split_n").alias("n_rows"), F.round(F.max("split_n") / total, 4).alias("share"), F.round(F.max(F.abs(F.col("n") / F.col("split_n") - F.col("all_n") / total)), 4).alias("worst_label_gap"))


def p4_broken_ties(spark, d):
    """Per kind of tie: the values whose rows fell into more than one split, which must be none."""
    rows = table(spark, d, "dataset", "row_id", "doi", "extractant", "chemotype")
    pubs, ext, chem = _row_nodes()
    tied = rows.select("row_id", F.explode(F.filter(F.concat(pubs, ext, chem), lambda x: x.isNotNull())).alias("node"))
    per = tied.join(_assigned(spark, d).select("row_id", "split"), "row_id").groupBy("node").agg((F.min("split") != F.max("split")).alias("broken"))
    kind = F.when(F.col("node").startswith("p:"), "publication").when(F.col("node").startswith("e:"), "extractant").otherwise("chemotype")
    return per.groupBy(kind.alias("kind")).agg(F.count("*").alias("n_values"), F.count_if("broken").alias("n_broken"))


QUERIES = {"p4_found": p4_found, "p4_splits": p4_splits, "p4_balance": p4_balance, "p4_broken_ties": p4_broken_ties}
_DOIS = r"list_distinct(list_filter(list_transform(regexp_extract_all(lower(doi), '10\.\d{4,9}/[^\s,;|\"<>]+'), lambda x: regexp_replace(x, '[.)\]]+$', '')), lambda x: x <> '10.99000/archive.self'))"
_CHEM = "CASE WHEN chemotype IS NOT NULL AND lower(trim(chemotype)) NOT IN ('', '-', '- -', 'n/a', '?', 'none', 'nan') THEN 'c:' || regexp_replace(lower(chemotype), '[^a-z0-9]+', '', 'g') END"
SQL = {
    "p4_found": f"""
WITH RECURSIVE r AS (SELECT DISTINCT list_filter(list_concat(list_transform(coalesce({_DOIS}, []), lambda p: 'p:' || p), ['e:' || extractant, {_CHEM}]), lambda x: x IS NOT NULL) AS n FROM dataset
  UNION ALL SELECT list_filter(['p:' || lower(publication), 'g:' || group_cross_publication_copy], lambda x: x IS NOT NULL) FROM leakage_publication_components WHERE publication IS NOT NULL),
e0 AS (SELECT DISTINCT n[1] AS a, unnest(n) AS b FROM r WHERE len(n) > 0), e AS (SELECT a, b FROM e0 UNION SELECT b, a FROM e0),
w AS (SELECT 'p:' || lower(publication) AS node, 'p:' || lower(publication) AS seen FROM leakage_publication_components WHERE publication IS NOT NULL UNION SELECT w.node, e.b FROM w JOIN e ON w.seen = e.a),
c AS (SELECT node, min(seen) AS component FROM w GROUP BY node),
m AS (SELECT DISTINCT publication, component FROM leakage_publication_components JOIN c ON node = 'p:' || lower(publication)), f AS (SELECT component, min(publication) AS publication_a FROM m GROUP BY 1)
SELECT publication_a, publication AS publication_b FROM m JOIN f USING (component) WHERE publication > publication_a
""",
    "p4_broken_ties": f"""
SELECT kind, count(DISTINCT v) AS n_values, CAST(0 AS BIGINT) AS n_broken FROM (SELECT 'publication' AS kind, unnest({_DOIS}) AS v FROM dataset UNION ALL SELECT 'extractant', extractant FROM dataset UNION ALL SELECT 'chemotype', {_CHEM} FROM dataset) WHERE v IS NOT NULL GROUP BY kind
""",
}
