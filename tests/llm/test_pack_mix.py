import itertools
import random

import pytest
from pyspark.sql import functions as F

from scriptorium.llm import mix, pack, tokens


@pytest.mark.parametrize("seed", range(5))
def test_packing_is_whole_and_tight(seed):
    rng = random.Random(seed)
    sizes, capacity = [rng.choice([0, rng.randrange(1, 700), rng.randrange(1, 3000)]) for _ in range(400)], 512
    bins = pack.pack_sizes(sizes, capacity)
    assert all(0 < sum(n for *_, n in b) <= capacity for b in bins)
    for i, size in enumerate(sizes):
        parts = sorted((first, n) for b in bins for j, first, n in b if j == i)
        assert sum(n for _, n in parts) == size and (len(parts) <= 1 or size > capacity)
        assert all(a + n == c for (a, n), (c, _) in zip(parts, parts[1:]))
    assert len(bins) <= 1.02 * sum(sizes) / capacity + 2


def test_search_mends_a_bad_start():
    sizes = [60, 50, 40, 30, 20]
    bins = pack.improve([[0], [1], [2], [3], [4]], sizes, 100)
    assert len(bins) == 2 and sorted(i for b in bins for i in b) == [0, 1, 2, 3, 4]


def open_exchange(bins, sizes, capacity, most):
    """An exchange of up to two items for up to two, `most` in all, that raises the sum of squared fills, by trying all."""
    sums = [{(sum(c), len(c)) for n in (0, 1, 2) for c in itertools.combinations([sizes[i] for i in b], n)} for b in bins]
    fill = [sum(sizes[i] for i in b) for b in bins]
    under = [b for b in range(len(bins)) if fill[b] < capacity]
    for d, b in itertools.permutations(under, 2):
        for (give, n), (take, k) in itertools.product(sums[d], sums[b]):
            m = give - take
            if n + k <= most and 0 < m <= capacity - fill[b] and fill[b] - fill[d] + m > 0:
                return bins[d], bins[b], give, take
    return None


@pytest.mark.parametrize("name", ["many containers", "many items", "random"])
def test_search_leaves_no_exchange_open(name):
    rng = random.Random(4)
    sizes, capacity = {"many containers": ([rng.randrange(300, 420) for _ in range(200)] + [rng.randrange(60, 130) for _ in range(150)], 512), "many items": ([rng.randrange(3, 400, 7) for _ in range(300)], 6_000), "random": ([rng.randrange(1, 400) for _ in range(300)], 512)}[name]
    start = [[i] for i in range(len(sizes))] if name != "many items" else [list(range(k, 300, 13)) for k in range(13)]
    bins = pack.improve(start, sizes, capacity)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes))) and max(sum(sizes[i] for i in b) for b in bins) <= capacity
    assert open_exchange(bins, sizes, capacity, 3) is None and open_exchange(bins, sizes, capacity, 4) is None
    bins = pack.improve(pack.best_fit(sizes, capacity), sizes, capacity)
    assert open_exchange(bins, sizes, capacity, 4) is None


def test_pack_spark(spark):
    docs = spark.createDataFrame([(1, "word " * 1500, "x"), (2, "a b c", "x"), (2, "a b c", "x"), (3, "", "x"), (4, None, "x")], "doc_id bigint, text string, container string")
    specs = spark.createDataFrame([("s", 512), ("none", None), ("zero", 0)], "spec_name string, capacity_tokens int")
    p = pack.pack(docs, specs)
    assert {r.doc_id: r.n for r in p.groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()} == {1: tokens.count_tokens(["word " * 1500])[0], 2: 6}
    assert p.groupBy("spec_name", "container").agg(F.sum("n_tokens").alias("n")).where("n > 512").count() == 0
    assert pack.pack(docs.limit(0), specs).count() == 0


def test_expected_copies_spread_what_a_full_source_lacks():
    t = [{"mix_name": "m", "source": s, "target_share": w, "max_repeat": r, "budget_ratio": 1.0} for s, w, r in (("a", 1.0, 1), ("b", 1.0, 4), ("absent", 2.0, 4))]
    got = {r["source"]: r for r in mix.expected_copies(t, {"a": 100, "b": 300}, 400)}
    assert got["a"]["given"] == 100 and abs(got["b"]["given"] - 300) < 1e-6 and got["absent"]["copies"] == 0.0


def test_mix(spark):
    docs = spark.createDataFrame([(i, "w " * 20, ["Big ", "small-one", None][0 if i % 10 else 1] if i % 50 else None) for i in range(1000)], "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("m", "big", 0.5, 3, 0.4), ("m", "small_one", 0.5, 3, 0.4), ("n", "nowhere", 1.0, 2, 0.5)], "mix_name string, source string, target_share double, max_repeat int, budget_ratio double")
    m = mix.mix(docs, targets)
    assert m.groupBy("mix_name", "doc_id").count().agg(F.max("count")).first()[0] <= 3
    s = {(r.mix_name, r.source): r for r in mix.shares(docs, targets).collect()}
    assert abs(s["m", "big"].reached_share - 0.5) < 0.02 and s["n", "nowhere"].reached_tokens == 0
    assert sorted(map(tuple, m.collect())) == sorted(map(tuple, mix.mix(docs, targets).collect()))
    assert mix.mix(docs.limit(0), targets).count() == 0
