"""Problem 5: typed values and the reference list."""

import random

from pyspark.sql import functions as F

from quarrystone.llm.catalog_match import allowed, build_index, catalog_spellings, find, match_column, match_values, typed_key, weighted_distance

NAMES = [(1, "Fenunepine amide"), (2, "Silinozamide 415"), (3, "Silinozamide 118"), (4, "toluene"), (5, "1,2-dichloroethane")]


def _plain(a, b):
    """Unrestricted Damerau-Levenshtein distance by the textbook recurrence."""
    big = len(a) + len(b)
    d = {(-1, -1): big}
    for i in range(len(a) + 1):
        d[i, -1], d[i, 0] = big, i
    for j in range(len(b) + 1):
        d[-1, j], d[0, j] = big, j
    last = {}
    for i in range(1, len(a) + 1):
        col = 0
        for j in range(1, len(b) + 1):
            k, m = last.get(b[j - 1], 0), col
            same = a[i - 1] == b[j - 1]
            if same:
                col = j
            d[i, j] = min(d[i - 1, j - 1] + (not same), d[i, j - 1] + 1, d[i - 1, j] + 1, d[k - 1, m - 1] + (i - k - 1) + 1 + (j - m - 1))
        last[a[i - 1]] = i
    return d[len(a), len(b)]


def test_distance_against_brute_force():
    rng = random.Random(1)
    for _ in range(3000):
        a = "".join(rng.choice("abc1") for _ in range(rng.randint(0, 8)))
        b = "".join(rng.choice("abc1") for _ in range(rng.randint(0, 8)))
        assert (weighted_distance(a, b, 2) is not None) == (_plain(a, b) <= 2), (a, b)


def test_lookup_finds_all_within_reach():
    index = build_index([(i, n, False, 0) for i, n in NAMES] + [(4, "PhMe", True, 0)])
    rng = random.Random(2)
    for i, name in NAMES:
        key = typed_key(name)
        for _ in range(200):
            typed = list(key)
            for _ in range(allowed(len(key))):
                at = rng.randrange(len(typed))
                typed[at : at + 1] = rng.choice([[], [typed[at], "q"], ["q"]])
            hit = find(index, "".join(typed))[0]
            rivals = [j for j, other in NAMES if _plain("".join(typed), typed_key(other)) <= allowed(len(typed_key(other)))]
            assert hit in rivals
    assert find(index, "  phme [batch 3]")[0] == 4 and find(index, "TOLUENE, purified")[0] == 4 and find(index, "1,2-DICHLOROETHANE (97%)")[0] == 5
    assert find(index, "Silinozamide 415 *")[0] == 2 and find(index, "Zutemigol")[0] == 0 and find(index, "x" * 5000)[0] == 0


def _catalog(spark, rows):
    return spark.createDataFrame(rows, "id long, name string, synonyms array<string>")


def test_column(spark):
    df = spark.createDataFrame([(1, "tolune"), (2, None), (3, ""), (4, "dodecane"), (5, "dodecane"), (6, "unknown thing")], "k int, typed string")
    index = build_index([(1, "toluene", False, 0), (1, "PhMe", True, 0), (2, "dodecane", False, 2)])
    got = {r["k"]: r["h"] for r in df.withColumn("h", match_column(spark, F.col("typed"), index)).collect()}
    assert got[1]["entry_id"] == 1 and got[2]["entry_id"] is None and got[3]["entry_id"] == 0 and got[4]["entry_id"] == got[5]["entry_id"] == 2 and got[6]["entry_id"] == 0
    assert df.where("false").withColumn("h", match_column(spark, F.col("typed"), index)).count() == 0


def test_joined_lists_match_like_shipped_ones(spark):
    """Names of over 80 letters, short names that lost a letter, ties, NULLs and repeats, through the dictionary and through the join."""
    long = "bis(2,4,4-trimethylpentyl)" * 4 + " phosphinic acid"
    catalog = _catalog(spark, [(1, "toluene", ["PhMe", None]), (2, "dodecane", None), (3, long, []), (4, "MIBK", []), (5, "abcdefgh", []), (6, "abcdefgi", []), (7, None, ["seven of nine"])])
    typed = ["tolune", "dodecane", "Dodecaen", long[:-1] + "x", long[:40] + "!" + long[40:], "MBK", "abcdefgj", "phm", "nothing like it", "", "seven of nin", "y" * 100_000, None, "tolune"]
    df = spark.createDataFrame([(t,) for t in typed], "typed string")
    spellings = catalog_spellings(catalog, "id", "name", "synonyms", spark.createDataFrame([("abcdefgi", 5), (None, 2)], "name string, n long"))
    shipped, joined = ({r["typed"]: (r["entry_id"], r["distance"]) for r in match_values(df, spellings, most).collect()} for most in (100, 3))
    assert shipped == joined and len(shipped) == 12
    assert {t: shipped[t][0] for t in typed if t is not None} == {"tolune": 1, "dodecane": 2, "Dodecaen": 2, long[:-1] + "x": 3, long[:40] + "!" + long[40:]: 3, "MBK": 4, "abcdefgj": 6, "phm": 1, "nothing like it": 0, "": 0, "seven of nin": 7, "y" * 100_000: 0}
    assert match_values(df.where("false"), spellings).count() == 0 and match_values(df, spellings.where("false")).where("entry_id <> 0").count() == 0
