"""Problem 5: mapping typed values to the entries of a reference list.

A symmetric-delete dictionary of the list (every entry with up to two letters
deleted) is built on the driver and shipped to the workers: its size is bounded
by the list, whose length is checked (a longer list is joined instead). Every different typed value is
reduced to its letters and digits, looked up as it is, and else by its own
deletes; candidates within the edit distance allowed for their length are ranked
by weighted Damerau-Levenshtein distance, then by how often the reference entry
occurs, then by id. Values that match nothing are reported with entry 0.
"""

from __future__ import annotations

import re
import unicodedata
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TAIL = re.compile(r"(?:\s*[(\[][^()\[\]]*[)\]]|\s*,\s+[^\W\d][\w ]*|[\s*.]+)$")
_KEEP = re.compile(r"[^\w]|_", re.UNICODE)


def typed_key(text: str) -> str:
    """Letters and digits of a typed value in folded form, without remarks behind it such as '(97%)', '[batch 3]' or ', purified'."""
    t = unicodedata.normalize("NFKC", text).strip().casefold()
    while (cut := _TAIL.sub("", t)) != t and cut:
        t = cut
    return _KEEP.sub("", t)


def deletes(key: str, most: int) -> set[str]:
    """key and every string left after deleting up to `most` of its letters."""
    out = {key}
    for k in range(1, min(most, len(key)) + 1):
        for at in combinations(range(len(key)), k):
            out.add("".join(c for i, c in enumerate(key) if i not in at))
    return out


def allowed(length: int) -> int:
    """Edits allowed for an entry of so many letters."""
    return 0 if length < 4 else 1 if length < 7 else 2


def weighted_distance(a: str, b: str, most: int) -> float | None:
    """Weighted unrestricted Damerau-Levenshtein distance, or None if more than `most` edits are needed.

    An exchange of neighbours or a doubled letter costs 0.8, any edit of a digit 1.5, other edits 1.
    Fewer edits count before a smaller weight.
    """
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return None
    cost = [1.5 if c.isdigit() else 1.0 for c in a], [1.5 if c.isdigit() else 1.0 for c in b]
    drop = [0.8 if i and a[i] == a[i - 1] else cost[0][i] for i in range(n)]
    add = [0.8 if j and b[j] == b[j - 1] else cost[1][j] for j in range(m)]
    table = [[(i + j, float(i + j)) if i == 0 or j == 0 else (99, 99.0) for j in range(m + 1)] for i in range(n + 1)]
    last_row: dict[str, int] = {}
    for i in range(1, n + 1):
        last_col = 0
        for j in range(max(1, i - most - 1), min(m, i + most + 1) + 1):
            before, match = last_row.get(b[j - 1], 0), last_col
            e, w = table[i - 1][j - 1]
            if a[i - 1] == b[j - 1]:
                best, last_col = (e, w), j
            else:
                best = (e + 1, w + max(cost[0][i - 1], cost[1][j - 1]))
            e, w = table[i - 1][j]
            best = min(best, (e + 1, w + drop[i - 1]))
            e, w = table[i][j - 1]
            best = min(best, (e + 1, w + add[j - 1]))
            if before and match:
                e, w = table[before - 1][match - 1]
                between = (i - before - 1) + (j - match - 1)
                best = min(best, (e + 1 + between, w + 0.8 + between))
            table[i][j] = best
        last_row[a[i - 1]] = i
    edits, weight = table[n][m]
    return weight if edits <= most else None


Index = dict[str, dict | int]


def build_index(entries: list[tuple[int, str, bool, int]]) -> Index:
    """The dictionary over (entry_id, spelling, is_synonym, frequency): key -> (entry, rank), and delete -> keys."""
    spelled: dict[str, tuple[int, tuple]] = {}
    near: dict[str, list[str]] = {}
    for entry, name, synonym, seen in entries:
        key = typed_key(name)
        rank = (int(synonym), -seen, entry)
        if key and (key not in spelled or rank < spelled[key][1]):
            spelled[key] = (entry, rank)
    for key in spelled:
        for d in deletes(key, allowed(len(key))):
            near.setdefault(d, []).append(key)
    return {"spelled": spelled, "near": near, "longest": max(map(len, spelled), default=0) + 2}


def find(index: Index, typed: str) -> tuple[int, float]:
    """(entry id, weighted distance) or (0, -1.0)."""
    spelled, near = index["spelled"], index["near"]
    key = typed_key(typed)
    if key in spelled:
        return spelled[key][0], 0.0
    found = {c for d in deletes(key, 2) for c in near.get(d, ())} if len(key) <= index["longest"] else ()
    ranked = []
    for c in found:
        w = weighted_distance(key, c, allowed(len(c)))
        if w is not None:
            ranked.append((w, spelled[c][1], spelled[c][0]))
    return (min(ranked)[2], min(ranked)[0]) if ranked else (0, -1.0)


def catalog_spellings(catalog: DataFrame, entry_id: str, name: str, synonyms: str, seen: DataFrame | None = None) -> DataFrame:
    """(entry, spelling, synonym, seen) of a reference list: every name and synonym; seen: (name, n) of how often each name occurs."""
    rows = catalog.select(F.col(entry_id).cast("long").alias("entry"), F.col(name).alias("name"), F.col(synonyms).alias("others"))
    often = seen.toDF("name", "n").where("name IS NOT NULL").groupBy("name").agg(F.sum("n").alias("n")) if seen is not None else rows.select("name", F.lit(0).cast("long").alias("n")).limit(0)
    each = F.explode(F.concat(F.array(F.struct(F.col("name").alias("spelling"), F.lit(False).alias("synonym"))), F.transform(F.coalesce("others", F.array().cast("array<string>")), lambda s: F.struct(s.alias("spelling"), F.lit(True).alias("synonym")))))
    return rows.join(often, "name", "left").select("entry", each.alias("s"), F.coalesce("n", F.lit(0)).alias("seen")).select("entry", "s.spelling", "s.synonym", "seen").where("spelling IS NOT NULL AND entry IS NOT NULL")


def match_values(values: DataFrame, spellings: DataFrame, max_shipped: int = 100_000) -> DataFrame:
    """(typed, entry_id, distance) of every different value of the one-column table `values`, NULL left out; entry 0 and distance -1 where nothing matches.

    A list of up to max_shipped spellings travels to the workers as a dictionary; a longer one is joined, delete by
    delete, with the same result.
    """
    typed = values.toDF("typed").where("typed IS NOT NULL").distinct()
    rows = spellings.limit(max_shipped + 1).collect()
    if len(rows) > max_shipped:
        return _match_by_join(typed, spellings)
    index = build_index([(r["entry"], r["spelling"], r["synonym"], r["seen"]) for r in rows])
    spread = typed.repartition(int(values.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # by number, as look-ups cost more than their bytes tell
    return spread.withColumn("hit", match_column(values.sparkSession, F.col("typed"), index)).select("typed", "hit.entry_id", "hit.distance")


def _match_by_join(typed: DataFrame, spellings: DataFrame) -> DataFrame:
    @F.pandas_udf("string")
    def key_of(s: pd.Series) -> pd.Series:
        return s.map(typed_key)

    @F.pandas_udf("array<string>")
    def near(s: pd.Series) -> pd.Series:
        return s.map(lambda k: sorted(deletes(k, 2)))

    @F.pandas_udf("array<string>")
    def near_entry(s: pd.Series) -> pd.Series:
        return s.map(lambda k: sorted(deletes(k, allowed(len(k)))))

    @F.pandas_udf("double")
    def apart(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([weighted_distance(x, y, allowed(len(y))) for x, y in zip(a, b, strict=True)], dtype=float)

    rank = F.struct(F.col("synonym").cast("int").alias("s"), (-F.col("seen")).alias("n"), F.col("entry"))
    entries = spellings.withColumn("spelled", key_of("spelling")).where("spelled <> ''").groupBy("spelled").agg(F.min(rank).alias("rank"))
    longest = entries.agg(F.max(F.length("spelled"))).scalar()
    keyed = typed.withColumn("key", key_of("typed"))
    exact = keyed.join(entries, F.col("key") == F.col("spelled"), "left").select("typed", "key", "rank")
    open_ = exact.where(F.col("rank").isNull() & (F.length("key") <= longest + 2)).select("typed", "key", F.explode(near("key")).alias("cut"))
    met = open_.join(entries.select("spelled", "rank", F.explode(near_entry("spelled")).alias("cut")), "cut").select("typed", "key", "spelled", "rank").distinct()
    best = met.withColumn("w", apart("key", "spelled")).where(F.col("w").isNotNull() & ~F.isnan("w")).groupBy("typed").agg(F.min(F.struct("w", "rank")).alias("b"))
    return exact.join(best, "typed", "left").select("typed", F.coalesce("rank.entry", "b.rank.entry", F.lit(0)).alias("entry_id"), F.when(F.col("rank").isNotNull(), 0.0).otherwise(F.coalesce("b.w", F.lit(-1.0))).alias("distance"))


RESULT = T.StructType([T.StructField("entry_id", T.LongType()), T.StructField("distance", T.DoubleType())])


def match_column(spark, typed: Column, index: Index, remember: int = 200_000) -> Column:
    """struct(entry_id, distance) of each typed value; entry 0 and distance -1 where nothing matches, NULL for NULL.

    Each different value of an Arrow batch is looked up once; up to `remember`
    results are kept between batches of a task.
    """
    shipped = spark.sparkContext.broadcast(index)

    @F.pandas_udf(RESULT)
    def look_up(batches: pd.Series) -> pd.DataFrame:
        known = {}
        index = shipped.value
        codes, values = pd.factorize(batches)
        hits = []
        for v in values:
            if v not in known:
                if len(known) >= remember:
                    known.clear()
                known[v] = find(index, v)
            hits.append(known[v])
        hits.append((None, None))
        return pd.DataFrame({"entry_id": pd.array([hits[c][0] for c in codes], dtype="Int64"), "distance": [hits[c][1] for c in codes]})

    return look_up(typed)
