"""Problem 2: most similar vectors."""

import numpy as np

from quarrystone.llm import ivfpq
from quarrystone.llm.ivfpq import pack_vectors, similar_pairs


def _data(rng, n_families, size):
    rows = []
    for _ in range(n_families):
        core = rng.random(256) < 0.17
        for _ in range(size):
            rows.append(np.where(rng.random(256) < 0.03, ~core, core).astype(float))
    return rows


def _brute(rows, ids, k=5, least=0.6):
    x = np.array(rows, dtype=np.float64)
    both = x @ x.T
    ones = x.sum(1)
    alike = both / (ones[:, None] + ones[None] - both)
    np.fill_diagonal(alike, -1)
    out = set()
    for i in range(len(x)):
        for j in np.lexsort((ids, -alike[i]))[:k]:
            if alike[i, j] >= least:
                out.add((int(min(ids[i], ids[j])), int(max(ids[i], ids[j]))))
    return out


def _frame(spark, rows):
    return spark.createDataFrame(rows, "id long, v array<float>, entry long")


def test_recall_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = _data(rng, 120, 10)
    rows += [rows[0]] * 9 + [rows[50]] * 2 + [rows[77]] * 4  # copies
    ids = rng.permutation(len(rows)) + 1
    for block, queries in ((4096, 65536), (16, 20)):
        monkeypatch.setattr(ivfpq, "BLOCK", block)
        monkeypatch.setattr(ivfpq, "QUERIES", queries)
        df = _frame(spark, [(int(i), [float(e) for e in r], 0) for i, r in zip(ids, rows)])
        got = {(r["a"], r["b"]) for r in similar_pairs(pack_vectors(df, "id", "v", 256), 5, 0.6).collect()}
        want = _brute(rows, ids)
        assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.03 * len(want)


def test_unusable_and_empty(spark):
    good = [1.0] * 10 + [0.0] * 246
    rows = [(1, good, 0), (2, good, 0), (3, None, 0), (4, [0.0] * 256, 0), (5, [float("nan")] + good[1:], 0), (6, good[:200], 0), (7, [None] + good[1:], 0), (1, good, 0)]
    assert [(r["a"], r["b"]) for r in similar_pairs(pack_vectors(_frame(spark, rows), "id", "v", 256), 5, 0.6).collect()] == [(1, 2)]
    assert similar_pairs(pack_vectors(_frame(spark, []), "id", "v", 256), 5, 0.6).count() == 0


def test_pairs_of_unrelated_lists_are_found_through_a_third(spark):
    bits = lambda *ones: np.packbits([i in ones for i in range(256)]).tobytes()
    x = {1: bits(*range(10)), 2: bits(*range(1, 11)), 3: bits(*range(2, 12)), 4: bits(*range(5, 17)), 5: bits(*range(100, 110))}
    entries = spark.createDataFrame([(e, b) for e, b in x.items()], "entry long, bits binary")
    alike = {(1, 2): 9 / 11, (2, 3): 9 / 11, (2, 4): 6 / 16}
    near = spark.createDataFrame([(a, b, s, 1 if s > 0.5 and (a, b) != (2, 3) else 2) for p, s in alike.items() for a, b in (p, p[::-1])], "entry long, other long, similarity double, place int")
    got = sorted(map(tuple, ivfpq._closed(near, entries, 2, 0.6, 32).collect()))
    assert got == [(1, 3, 8 / 12), (3, 1, 8 / 12)]
