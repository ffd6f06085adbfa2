"""Problem 9: containers."""

import random
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from quarrystone.llm.packing import pack, plan_packing


def _check_plan(histogram, capacity):
    runs, n = plan_packing(histogram, capacity)
    used, ranks = Counter(), defaultdict(set)
    for size, rank, items, first, per in runs:
        for k in range(items):
            assert rank + k not in ranks[size]
            ranks[size].add(rank + k)
            used[first + k // per] += size
    assert all(ranks[s] == set(range(c)) for s, c in histogram.items() if c)
    assert not used or (max(used.values()) <= capacity and set(used) == set(range(n)))
    return n


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(0, 30), max_size=40))
def test_every_item_once_and_never_too_full(histogram):
    _check_plan(histogram, 64)


def test_little_room_is_left():
    rng = random.Random(1)
    sizes = Counter(min(2048, max(1, int(rng.lognormvariate(5.3, 0.8)))) for _ in range(20_000))
    n = _check_plan(sizes, 2048)
    assert n <= 1.01 * sum(s * c for s, c in sizes.items()) / 2048 + 1


def test_pack(spark):
    rows = [(i, s, 1) for i, s in enumerate([0, None, 5, 2048, 2049, 5000, 4096, 7, 7, 7])] + [(100 + i, 300, 1) for i in range(500)] + [(100, 300, 1)]
    got = pack(spark.createDataFrame(rows, "doc_id long, n_tokens int, container int"), "doc_id", "n_tokens", 2048, per_task=50).collect()
    total = Counter()
    for r in got:
        total[r["container"]] += r["size"]
    assert max(total.values()) <= 2048 and len(got) == len(rows) + 1 + 2 + 1
    assert sorted(r["size"] for r in got if r["item"] == 5) == [904, 2048, 2048] and [r["size"] for r in got if r["item"] == 3] == [2048]
    assert {r["container"] for r in got} == set(range(max(total) + 1))
    assert pack(spark.createDataFrame([], "doc_id long, n_tokens int"), "doc_id", "n_tokens", 2048).count() == 0
    assert [r["container"] for r in pack(spark.createDataFrame([(1, 0)], "doc_id long, n_tokens int"), "doc_id", "n_tokens", 2048).collect()] == [0]
