"""Plans behind the operators: exact quantiles in passes, distances by pairs of cells, crowded cells dealt to tasks."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.operators import selection
from fieldloom.plans import pairs, quantiles
from fieldloom.sources.planar import Events

SHARES = (0.0, 0.05, 0.5, 0.95, 1.0)


def percentiles(df, column):
    kept = df.where(f"{column} > 0 and {column} < double('infinity')")
    return kept.agg(F.percentile(column, F.array(*map(F.lit, SHARES))).alias("q")).first().q


@pytest.mark.parametrize("few", [4, 10_000])
def test_quantiles_in_passes_are_those_of_percentile(spark, monkeypatch, few):
    monkeypatch.setattr(quantiles, "FEW", few)
    draw = random.Random(3)
    odd = [None, float("nan"), float("inf"), float("-inf"), 0.0, -0.0, -2.0]
    for values in (
        [draw.lognormvariate(0, 9) for _ in range(3000)] + odd,
        [float(draw.randrange(6)) for _ in range(900)],
        [5e-324, 1.7e308, 1.0, 1.0 + 2**-52, 1.0 + 2**-51] * 5,
        [7.0],
    ):
        df = spark.createDataFrame([(v,) for v in values], "v double")
        assert quantiles.quantiles(df, SHARES) == percentiles(df, "v")
    assert quantiles.quantiles(spark.createDataFrame([(v,) for v in odd], "v double"), SHARES) is None
    assert quantiles.quantiles(spark.createDataFrame([], "v double"), SHARES) is None


def places(kind, n, dim):
    draw = random.Random(n + dim)
    if kind == "ties":
        return [tuple(float(draw.randrange(9)) for _ in range(dim)) for _ in range(n)]
    if kind == "hot":  # a third in one place, a third in a small part, one far away
        spot = [(0.25,) * dim] * (n // 3) + [tuple(draw.gauss(0.5, 1e-4) for _ in range(dim)) for _ in range(n // 3)]
        return spot + [tuple(draw.random() for _ in range(dim)) for _ in range(n // 3)] + [(300.0,) * dim]
    return [tuple(draw.random() for _ in range(dim)) for _ in range(n)]


@pytest.mark.parametrize("dim,kind", [(1, "even"), (2, "even"), (2, "ties"), (2, "hot"), (3, "even"), (4, "even")])
def test_distances_by_pairs_of_cells(spark, monkeypatch, dim, kind):
    monkeypatch.setattr(quantiles, "LEAF", 36)
    monkeypatch.setattr(quantiles, "WORK", 3000)
    axes = tuple("xyzu"[:dim])
    events = Events.from_frame(spark.createDataFrame(places(kind, 240, dim), ", ".join(f"{a} double" for a in axes)), axes)
    assert quantiles.pair_quantiles(events.df, events.coords, SHARES) == percentiles(selection.pair_distances(events), "distance")


def test_distances_that_do_not_count(spark):
    frame = lambda values: spark.createDataFrame([(v,) for v in values], "x double")
    find = lambda values: quantiles.pair_quantiles(frame(values), ["x"], (0.0, 1.0))
    assert find([]) is None and find([1.0]) is None and find([1.0, 1.0, 1.0]) is None
    assert find([1.0, None, float("nan"), float("inf")]) is None
    assert find([0.0, -0.0, 2.0, 2.0]) == [2.0, 2.0]
    assert find([0.0, 1e-200, 3.0]) == [3.0, 3.0]  # a square that vanishes is no distance
    assert find([-1e308, 1e308, 1e308]) is None  # nor one that overflows
    clashing = spark.createDataFrame([(0.0, 1, 5), (4.0, 2, 6)], "c0 double, m int, level int")
    assert quantiles.pair_quantiles(clashing, ["c0"], (0.5,)) == [4.0]


def test_few_pairs_of_places_are_opened(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "LEAF", 64)  # eight places a cell
    monkeypatch.setattr(quantiles, "WORK", 20_000)
    opened, kept = [], quantiles._leaves

    def counted(*args):
        leaves = kept(*args)
        opened.append(leaves.agg(F.sum("size")).first()[0])
        return leaves

    monkeypatch.setattr(quantiles, "_leaves", counted)
    draw = random.Random(1)
    for n in (1000, 4000):
        df = spark.createDataFrame([(draw.random(), draw.random()) for _ in range(n)], "x double, y double")
        assert len(quantiles.pair_quantiles(df, ["x", "y"], selection.SHARES)) == 3
    assert opened[1] < 0.15 * 4000 * 3999 / 2
    assert opened[1] < 12 * opened[0]  # 16 times the pairs


def crowd(spark, n):
    """Nine of ten rows in a hundredth of the area."""
    draw = random.Random(n)
    rows = [(i, *((draw.uniform(4.0, 5.0), draw.uniform(4.0, 5.0)) if i % 10 else (draw.uniform(0, 10), draw.uniform(0, 10)))) for i in range(n)]
    return spark.createDataFrame(rows, "i long, x double, y double")


@pytest.mark.parametrize("by_source", [False, True])
def test_crowded_cells_are_dealt(spark, monkeypatch, by_source):
    sources, targets = crowd(spark, 3000), crowd(spark, 600).toDF("t", "tx", "ty")
    near = lambda salt: (
        pairs.near_pairs_by_source(targets, sources, ["tx", "ty"], ["x", "y"], F.lit(1.0), salt)
        if by_source
        else pairs.near_pairs(targets, sources, ["tx", "ty"], ["x", "y"], 1.0, salt)
    )
    plain = near(None)
    assert "xxhash64" not in plain._jdf.queryExecution().toString()
    expected = {tuple(r) for r in plain.select("t", "i").collect()}
    monkeypatch.setattr(pairs, "PAIRS", 20_000)
    for salt in (None, ["i"]):
        dealt = near(salt)
        assert dealt.columns == plain.columns
        found = [tuple(r) for r in dealt.select("t", "i").collect()]
        assert len(found) == len(set(found)) and set(found) == expected
    monkeypatch.setattr(pairs, "HOT_CELLS", 3)  # a higher bound for fewer cells, the same pairs
    found = [tuple(r) for r in near(["i"]).select("t", "i").collect()]
    assert len(found) == len(set(found)) and set(found) == expected


def test_tasks_of_a_crowd_are_alike(spark, monkeypatch):
    sources, targets = crowd(spark, 6000), crowd(spark, 3000).toDF("t", "tx", "ty")
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "8", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    former = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        sizes = {}
        for bound in (1 << 26, 5000):
            monkeypatch.setattr(pairs, "PAIRS", bound)
            found = pairs.near_pairs(targets, sources, ["tx", "ty"], ["x", "y"], 1.0, ["i"])
            sizes[bound] = sorted(r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect())
    finally:
        for k, v in former.items():
            spark.conf.set(k, v)
    assert sum(sizes[5000]) == sum(sizes[1 << 26])
    assert sizes[1 << 26][-1] > 4 * sizes[1 << 26][0]
    assert len(sizes[5000]) == 8 and sizes[5000][-1] <= 4 * (sizes[5000][3] + sizes[5000][4]) / 2


def test_gaussian_sums_by_cells_equal_all_pairs(spark, monkeypatch):
    """Crowds, weights, and events far from all others; no table of pairs is summed but for the few apart."""
    from fieldloom.functions.kernels import get_kernel
    from fieldloom.operators import selection
    from fieldloom.operators.bandwidths import AbramsonBandwidth
    from fieldloom.operators.spacetime import SpatiotemporalBandwidthExperiment
    from fieldloom.plans import gauss

    rng = np.random.default_rng(3)
    x = np.r_[rng.normal(0, 1, 300), rng.uniform(-20, 20, 100), 26.0, 60.0, -45.5]
    rows = [(i, float(a), float(rng.normal(0, 300)), float(1 + i % 3)) for i, a in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, x double, t double, w double")
    line = Events.from_frame(df, ("x",), event_id="id", weight="w")
    moving = Events.from_frame(df, ("x",), event_id="id", weight="w", time="t")
    plane = Events.from_frame(df.withColumn("y", F.col("t") / 100), ("x", "y"), event_id="id", weight="w")
    hs, g = [0.2, 0.7, 2.0], get_kernel("gaussian")

    def all_of():
        one = {(r.h, r.i): (r.f, r.wide) for r in selection.leave_one_out(line, g, hs, wide=True).collect()}
        two = {(r.h, r.i): (r.f,) for r in selection.leave_one_out(plane, g, hs).collect()}
        many = {(r.hs, r.ht): tuple(r)[2:] for r in SpatiotemporalBandwidthExperiment((0.5, 2.0), (60.0, 180.0)).scores(moving).collect()}
        width = {r.event_id: (r.bandwidth,) for r in AbramsonBandwidth(0.8).resolve(line).collect()}
        return one, two, many, width

    want = all_of()
    taken = []
    whole = selection.pair_sums
    monkeypatch.setattr(selection, "pair_sums", lambda rows, *more: taken.append(rows.count()) or whole(rows, *more))
    monkeypatch.setattr(gauss, "ROWS", 0)
    for a, b in zip(want, all_of(), strict=True):
        assert a.keys() == b.keys()
        for k in a:
            assert np.allclose(a[k], b[k], rtol=1e-7, atol=1e-300), (k, a[k], b[k])
    assert taken and max(taken) < 200


def test_sums_over_vectors_meet_in_blocks(spark, monkeypatch):
    """Blocks of seven vectors give the sums of all pairs; a null vector takes no part."""
    from fieldloom.plans import sums

    monkeypatch.setattr(sums, "BLOCK", 7)
    v = np.random.default_rng(2).normal(size=(60, 5))
    df = spark.createDataFrame([*((i, [float(c) for c in x]) for i, x in enumerate(v)), (60, None)], "id long, v array<double>").repartition(3)
    got = {r.id: r.total for r in sums.vector_sums(df, "id", "v", lambda square: np.exp(-square)).collect()}
    want = np.exp(-((v[:, None] - v[None, :]) ** 2).sum(axis=2)).sum(axis=1)
    assert sorted(got) == list(range(60)) and np.allclose([got[i] for i in range(60)], want, rtol=1e-12)


def test_distances_on_a_line_are_counted_and_not_made(spark, monkeypatch):
    """Exact quantiles, ties and all, with no table of pairs of places; cells of many sizes."""
    monkeypatch.setattr(quantiles, "_settle", lambda *_: pytest.fail("pairs of places were made"))
    rng = np.random.default_rng(5)
    for runs, work, few, values in (
        (1 << 22, 1 << 20, 10_000, rng.uniform(-1, 10, 1200)),
        (50, 2000, 5, np.round(rng.uniform(-1, 10, 500), 1)),
        (50, 2000, 5, np.r_[[0.25] * 90, rng.normal(0.5, 1e-4, 90), 300.0]),
    ):
        for name, value in (("RUNS", runs), ("WORK", work), ("FEW", few)):
            monkeypatch.setattr(quantiles, name, value)
        events = Events.from_frame(spark.createDataFrame([(float(v),) for v in values], "x double"), ("x",))
        assert quantiles.pair_quantiles(events.df, events.coords, SHARES) == percentiles(selection.pair_distances(events), "distance")


def test_minimiser_over_cells_follows_that_over_all_pairs(spark, monkeypatch):
    from fieldloom.plans import gauss

    x = np.random.default_rng(4).normal(0, 1, 300)
    events = Events.from_frame(spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "id long, x double"), ("x",), event_id="id")
    want = selection.LikelihoodCV(most=4).select(events)
    monkeypatch.setattr(gauss, "ROWS", 0)
    reads, kept = [], gauss._cells_of
    monkeypatch.setattr(gauss, "_cells_of", lambda *a: reads.append(1) or kept(*a))
    found = selection.LikelihoodCV(most=4).select(events)
    assert np.allclose(found.trace, want.trace, rtol=1e-9) and found.bounds == want.bounds
    assert not reads  # cells are bounded by the box of the events and not counted
