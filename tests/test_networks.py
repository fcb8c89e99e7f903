"""Networks against hand values and series."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.functions.kernels import get_kernel
from fieldloom.functions.time import CyclicTime, LinearTime
from fieldloom.operators import heat
from fieldloom.operators import network_selection as selection
from fieldloom.operators.heat import HeatNetworkKDE
from fieldloom.operators.network import (
    JunctionPolicy,
    NetworkKDE,
    NetworkKNNBandwidth,
    NetworkTimeBandwidths,
    NetworkTimeKNNBandwidth,
    TemporalNetworkKDE,
    components,
    kernel_from_stretches,
    location_distances,
    propagate,
    traversal,
)
from fieldloom.operators.workspace import NetworkWorkspace
from fieldloom.sources import store
from fieldloom.sources.network import Network, arixels, snap
from fieldloom.sources.planar import Events, axis_cells

EVENT = "event_id long, edge_index long, offset double, weight double"


def network(spark, lines, **more):
    rows = [(i, [{"x": float(a), "y": float(b)} for a, b in line]) for i, line in enumerate(lines)]
    df = spark.createDataFrame(rows, "edge_index long, geometry array<struct<x:double,y:double>>")
    return Network.from_lines(df, edge_index="edge_index", **more)


@pytest.fixture(scope="module")
def junction(spark):
    return network(spark, [[(-1, 0), (0, 0)], [(0, 0), (1, 0)], [(0, 0), (0, 1)]])


def test_snapping(spark, junction):
    df = spark.createDataFrame([(0, -0.75, 0.05), (1, 0.0, 0.0), (2, 5.0, 5.0), (3, 0.05, 0.05)], "id long, x double, y double")
    e = Events.from_frame(df, ("x", "y"), event_id="id")
    for limit in (0.2, None):
        got = {r.event_id: r for r in snap(junction, e, limit).collect()}
        assert got[0].offset == pytest.approx(0.25) and got[1].status == "snapped_to_v" and got[1].edge_index == 0
        assert got[3].edge_index == 1 and got[3].status == "ambiguous_nearest" and got[3].candidates == 2
        assert (got[2].status == "beyond_max_distance") == (limit is not None)


def test_ties_just_beyond_the_reach_are_seen(spark):
    e = Events.from_frame(spark.createDataFrame([(0, 0.4, 7.6)], "id long, x double, y double"), ("x", "y"), event_id="id")
    assert [r.candidates for r in snap(Network.grid(spark, 8, 8), e, 0.4).collect()] == [2]  # 8 - 7.6 is 4e-16 above 0.4


def test_lixels_and_arixels(spark, junction):
    lixels = junction.lixels(0.4)
    rows = lixels.orderBy("lixel_id").collect()
    assert [r.lixel_id for r in rows] == list(range(9)) and [round(r.length, 9) for r in rows] == [0.4, 0.4, 0.2] * 3
    cells = axis_cells(spark, 0.0, 2.5, 1.0, "time")
    made = arixels(lixels, cells, 9)
    assert made.count() == 27 and made.agg(F.sum("arixel_measure")).first()[0] == pytest.approx(7.5)
    assert network(spark, [[(0, 0), (2.1, 0)]]).lixels(0.3).count() == 7


def test_distances_and_traversal(spark, junction):
    s = spark.createDataFrame([("s", 0, 0.3)], "source string, edge_index long, offset double")
    t = spark.createDataFrame([("a", 0, 0.8), ("b", 1, 0.5), ("s", 0, 0.3)], "target string, edge_index long, offset double")
    assert {r.target: round(r.distance, 9) for r in location_distances(junction, s, t, None).collect()} == {"a": 0.5, "b": 1.2, "s": 0.0}
    assert {r.target for r in location_distances(junction, s, t, 0.6).collect()} == {"a", "s"}
    edges = spark.createDataFrame([(0, "10", "20", 1.0, 0.1), (1, "10", "20", 1.2, 0.2), (2, "20", "30", 1.0, 0.1)], "edge_index long, u string, v string, length double, cost double")
    nodes = spark.createDataFrame([("10", 0.0, 0.0), ("20", 0.9, 0.0), ("30", 1.8, 0.0)], "node_id string, x double, y double")
    g = Network.from_tables(nodes, edges, directed=True)
    a = spark.createDataFrame([("a", 0, 0.4), ("b", 2, 0.7)], "source string, edge_index long, offset double")
    b = a.withColumnRenamed("source", "target")
    got = {(r.source, r.target): r.distance for r in location_distances(g, a, b, None).collect()}
    assert got["a", "b"] == pytest.approx(1.3) and ("b", "a") not in got
    assert {(r.source, r.target): r.distance for r in location_distances(g, a, b, None, directed=False).collect()}["b", "a"] == pytest.approx(1.3)
    assert {(r.source, r.target): r.distance for r in location_distances(g, a, b, None, weight="cost").collect()}["a", "b"] == pytest.approx(0.13)
    reached = {r.edge_index: r.reached_fraction for r in traversal(g, "10", 0.15, weight="cost").collect()}
    assert reached == pytest.approx({0: 1.0, 1: 0.75, 2: 0.5})
    assert g.quality().first().parallel_pairs == 1 and g.check().valid


def test_propagation_policies(spark, junction):
    event = spark.createDataFrame([(0, 0, 0.2525, 1.0)], EVENT)
    lixels = junction.lixels(0.005)
    want = {"simple": (0.75, None, None), "discontinuous": (None, 0.1040625, None), "continuous": (None, None, 0.22435625)}
    for policy, (at_event, beyond, before) in want.items():
        f = NetworkKDE("epanechnikov", 1.0, policy).evaluate(junction, event, lixels).collect()
        value = lambda e, o: next(r.density for r in f if r.edge_index == e and abs(r.center_offset - o) < 1e-9)  # noqa: B023, E731
        if at_event:
            assert value(0, 0.2525) == pytest.approx(at_event)
        if beyond:
            assert value(1, 0.1025) == value(2, 0.1025) == pytest.approx(beyond)
        if before:
            assert value(0, 0.9975) == pytest.approx(before) and value(1, 0.0025) == pytest.approx(0.21875)
            assert sum(r.density * r.length for r in f) == pytest.approx(1.0, abs=5e-4)
    sources = spark.createDataFrame([("s", 0, 1.0)], "source string, edge_index long, offset double")
    first = [r.coefficient for r in propagate(junction, sources, 0.5, policy="discontinuous").collect()]
    assert first == pytest.approx([2 / 3] * 3)
    with pytest.raises(RuntimeError):
        propagate(junction, sources, 50.0, policy="continuous", max_records=10).count()


def test_network_time(spark, junction):
    event = spark.createDataFrame([(0, 0, 0.25, 1.0, 1.0)], EVENT + ", time double")
    cells = spark.createDataFrame([(0, 1.0, 1.0)], "time_index long, time double, time_width double")
    kde = TemporalNetworkKDE(NetworkKDE("epanechnikov", 1.0, "simple"), 1.0, LinearTime())
    lixels = junction.lixels(0.5)
    got = {r.lixel_id: r.density for r in kde.evaluate(junction, event, lixels, cells).collect()}
    plain = {r.lixel_id: r.density for r in NetworkKDE("epanechnikov", 1.0, "simple").evaluate(junction, event, lixels).collect()}
    assert got[0] == pytest.approx(0.75 / math.sqrt(2 * math.pi))
    assert got == pytest.approx({i: v / math.sqrt(2 * math.pi) for i, v in plain.items()})


def test_heat_on_an_interval(spark):
    two = network(spark, [[(0, 0), (1, 0)], [(3, 0), (4, 0)]])
    event = spark.createDataFrame([(0, 0, 0.5, 1.0)], EVENT)
    f = HeatNetworkKDE(0.025, 0.0125).evaluate(two, event, two.lixels(0.05)).orderBy("lixel_id").collect()

    def series(a, b):
        terms = (2 * math.cos(k * math.pi / 2) * math.exp(-((k * math.pi) ** 2) * 0.025) * (math.sin(k * math.pi * b) - math.sin(k * math.pi * a)) / (k * math.pi * (b - a)) for k in range(1, 60))
        return 1 + sum(terms)

    for r in f:
        want = series(r.start_offset, r.end_offset) if r.edge_index == 0 else 0.0
        assert r.density == pytest.approx(want, abs=4e-3)
    assert sum(r.density * r.length for r in f) == pytest.approx(1.0, abs=1e-9)
    assert components(two).select("component").distinct().count() == 2


def plain_heat(segments, times):
    """exp(-t M^-1 S) M^-1 as a dense matrix for each time, by diagonalisation, with the names of the nodes and their masses."""
    rows = segments.collect()
    names = sorted({n for r in rows for n in (r.a, r.b)})
    at = {n: i for i, n in enumerate(names)}
    mass, stiff = np.zeros(len(names)), np.zeros((len(names), len(names)))
    for r in rows:
        i, j, size = at[r.a], at[r.b], r.right - r.left
        mass[[i, j]] += size / 2
        stiff[i, i] += 1 / size
        stiff[j, j] += 1 / size
        stiff[i, j] -= 1 / size
        stiff[j, i] -= 1 / size
    root = 1 / np.sqrt(mass)
    values, vectors = np.linalg.eigh(root[:, None] * stiff * root)
    return names, mass, [root[:, None] * (vectors * np.exp(-t * np.maximum(values, 0))) @ vectors.T * root for t in times]


def heat_case(spark, size, n, seed=5):
    r = np.random.default_rng(seed)
    net = Network.grid(spark, size, size)
    edges = 2 * size * (size + 1)
    rows = [(i, int(r.integers(0, edges)), float(r.choice([0.0, 0.25, r.random()])), float(r.uniform(0.5, 2))) for i in range(n)]
    return net, spark.createDataFrame(rows, EVENT), net.lixels(0.5)


def test_heat_matches_diagonalisation_and_tiles_match_the_whole(spark):
    net, events, cells = heat_case(spark, 9, 40)
    points = heat.breakpoints(net, cells, events)
    segments, times = heat.segments_of(points), [0.01, 0.08]
    names, mass, matrices = plain_heat(segments, times)
    sources = heat.event_nodes(points, events).select("component", "node", F.lit("all").alias("key"), F.col("weight").alias("value"))
    given = np.zeros(len(names))
    for r in sources.collect():
        given[names.index(r.node)] += r.value
    for tile in (5, 1000):
        rows = heat.evolve(segments, sources, times, nodes=net.nodes, own=True, tile=tile).collect()
        assert len(rows) >= (len(names) * 2 if tile == 1000 else 1) and len({(r.time, r.node) for r in rows}) == len(rows)
        for t, matrix in zip(times, matrices, strict=True):
            got = {r.node: (r.value, r.own) for r in rows if r.time == t}
            want = matrix @ given
            assert np.allclose([got.get(n, (0.0, 0))[0] for n in names], want, atol=1e-9 * want.max())
            assert all(math.isclose(got[n][1], matrix[i, i], rel_tol=1e-8) for i, n in enumerate(names) if n in got)


def test_heat_scores_match_all_pairs(spark):
    net, events, cells = heat_case(spark, 3, 25)
    points, times = heat.breakpoints(net, cells, events), [0.02, 0.3]
    names, mass, matrices = plain_heat(heat.segments_of(points), times)
    rows = heat.event_nodes(points, events).orderBy("event_id").collect()
    at, w = [names.index(r.node) for r in rows], np.array([r.weight for r in rows])
    likelihood = {r.h: r.score for r in heat.heat_scores(net, events, cells, times).collect()}
    squares = {r.h: r.score for r in heat.heat_scores(net, events, cells, times, objective="least_squares").collect()}
    ends = [(names.index(r.a), names.index(r.b), r.right - r.left) for r in heat.segments_of(points).collect()]
    for t, matrix in zip(times, matrices, strict=True):
        pairs = matrix[np.ix_(at, at)]
        np.fill_diagonal(pairs, 0)
        f = (w @ pairs) / (w.sum() - w)
        assert math.isclose(likelihood[t], -(w @ np.log(f)) / w.sum(), rel_tol=1e-7)
        density = matrix[:, at] @ w / w.sum()
        square = sum(size * (density[i] ** 2 + density[i] * density[j] + density[j] ** 2) / 3 for i, j, size in ends)
        assert math.isclose(squares[t], square - 2 * (w @ f) / w.sum(), rel_tol=1e-7)


def test_heat_selectors(spark):
    net, events, cells = heat_case(spark, 2, 12)
    low, high = heat.heat_time_bounds(net, events)
    assert 0 < low < high
    for selector in (heat.HeatLikelihoodCV(most=6), heat.HeatLeastSquaresCV(bounds=(0.01, 1.0), most=6)):
        found = selector.select(net, events, cells)
        assert len(found.trace) <= 6 and found.score == min(s for _, s in found.trace) and found.bounds[0] <= found.bandwidth <= found.bounds[1]
    field = HeatNetworkKDE(heat.HeatLikelihoodCV(bounds=(0.05, 0.2), most=3)).evaluate(net, events, cells)
    assert math.isclose(field.agg(F.sum(F.col("density") * F.col("length"))).first()[0], 1.0, rel_tol=1e-9) and heat.equivalent_bandwidth(2.0) == 2.0


def timed_case(spark, n=14, seed=2):
    r = np.random.default_rng(seed)
    rows = [(i, int(r.integers(0, 24)), float(r.random()), float(r.uniform(0.5, 2)), float(r.uniform(0, 24))) for i in range(n)]
    net = Network.grid(spark, 3, 3)
    return net, spark.createDataFrame(rows, EVENT + ", time double"), rows


def plain_distances(rows, size=3):
    """Shortest paths between places on a full grid: steps across and along between the ends of their edges."""
    across = (size + 1) * size

    def ends(e):
        if e < across:
            return (e // size, e % size), (e // size, e % size + 1)
        e -= across
        return (e // (size + 1), e % (size + 1)), (e // (size + 1) + 1, e % (size + 1))

    n = len(rows)
    out = np.zeros((n, n))
    for i, a in enumerate(rows):
        for j, b in enumerate(rows):
            ways = [abs(a[2] - b[2])] if a[1] == b[1] else []
            for p, x in zip(ends(a[1]), (a[2], 1 - a[2]), strict=True):
                for q, y in zip(ends(b[1]), (b[2], 1 - b[2]), strict=True):
                    ways.append(x + y + abs(p[0] - q[0]) + abs(p[1] - q[1]))
            out[i, j] = min(ways)
    return out


def epanechnikov(u):
    return np.where(u <= 1, 0.75 * (1 - u * u), 0.0)


def test_network_selectors_match_all_pairs(spark):
    net, events, rows = timed_case(spark)
    d, w = plain_distances(rows), np.array([r[3] for r in rows])
    off = d[~np.eye(len(rows), dtype=bool)]
    q = np.quantile(off[off > 0], [0.05, 0.5, 0.95])
    low = max(0.2 * q[0], 1e-6 * q[1])
    assert np.allclose(selection.distance_bounds(net, events), (low, max(2 * q[2], 10 * low)))

    def loo(h):
        k = epanechnikov(d / h) / h
        np.fill_diagonal(k, 0)
        return (w @ k) / (w.sum() - w)

    def likelihood(h):
        return -(w @ np.log(np.maximum(loo(h), 1e-300))) / w.sum()

    found = selection.NetworkLikelihoodCV(bounds=(1.0, 4.0), most=5).select(net, events)
    assert all(math.isclose(s, likelihood(h), rel_tol=1e-9) for h, s in found.trace) and found.score == min(s for _, s in found.trace)
    cells = net.lixels(0.25)
    places = [(0, r.edge_index, r.center_offset, 0, 0) for r in cells.orderBy("lixel_id").collect()]
    cross = plain_distances([*rows, *places])[: len(rows), len(rows) :]
    squares = selection.NetworkLeastSquaresCV(bounds=(1.0, 4.0), most=3).select(net, events, cells)
    for h, s in squares.trace:
        f = (w / w.sum()) @ (epanechnikov(cross / h) / h)
        assert math.isclose(s, (f * f).sum() * 0.25 - 2 * (w @ loo(h)) / w.sum(), rel_tol=1e-9)
    kde = NetworkKDE(bandwidth=selection.NetworkLikelihoodCV(bounds=(1.0, 4.0), most=3), policy="simple").evaluate(net, events, cells)
    assert kde.where("density > 0").count() > 0


@pytest.mark.parametrize("mode", ["joint", "separate"])
def test_network_time_experiments_match_all_pairs(spark, mode):
    net, events, rows = timed_case(spark)
    d, w, t = plain_distances(rows), np.array([r[3] for r in rows]), np.array([r[4] for r in rows])
    lixels, cells = net.lixels(0.5), axis_cells(spark, 0.0, 24.0, 6.0, "time")
    places = [(0, r.edge_index, r.center_offset, 0, 0) for r in lixels.orderBy("lixel_id").collect()]
    cross, centres, a = plain_distances([*rows, *places])[: len(rows), len(rows) :], np.arange(4) * 6 + 3.0, w / w.sum()
    gauss = lambda u, h: np.exp(-0.5 * (u / h) ** 2) / h / math.sqrt(2 * math.pi)

    def loo(k):
        k = k.copy()
        np.fill_diagonal(k, 0)
        return (w @ k) / (w.sum() - w)

    joint, space, when = {}, {}, {}
    for h in (1.0, 2.0):
        ks, kc = epanechnikov(d / h) / h, epanechnikov(cross / h) / h
        space[h] = ((a @ kc) ** 2).sum() * 0.5 - 2 * a @ loo(ks)
        for ht in (3.0, 8.0):
            kt, kf = gauss(t[:, None] - t[None, :], ht), gauss(centres[:, None] - t[None, :], ht)
            when[ht] = ((kf @ a) ** 2).sum() * 6 - 2 * a @ loo(kt)
            joint[h, ht] = (((kf * a) @ kc) ** 2).sum() * 0.5 * 6 - 2 * a @ loo(ks * kt)
    run = selection.NetworkTimeBandwidthExperiment((1.0, 2.0), (3.0, 8.0), LinearTime(), policy="simple", objective="least_squares", mode=mode)
    got = run.run(net, events, lixels, cells).first()
    want = min(joint, key=joint.get) if mode == "joint" else (min(space, key=space.get), min(when, key=when.get))
    assert (got.h, got.ht) == want and math.isclose(got.score, joint[want], rel_tol=1e-9)


def test_network_time_bandwidths(spark):
    net, events, rows = timed_case(spark)
    d, t = plain_distances(rows), np.array([r[4] for r in rows])
    for domain, gap in ((LinearTime(), abs(t[:, None] - t[None, :])), (CyclicTime(24.0), np.minimum(abs(t[:, None] - t[None, :]), 24 - abs(t[:, None] - t[None, :])))):
        got = {r.source: (r.h, r.ht) for r in NetworkTimeKNNBandwidth(2, 3, 1.5, 2.0).resolve(net, events, domain).collect()}
        for i in range(len(rows)):
            assert np.allclose(got[i], (np.sort(np.delete(d[i], i))[1] * 1.5, np.sort(np.delete(gap[i], i))[2] * 2.0))
    lixels, cells = net.lixels(0.5), axis_cells(spark, 0.0, 24.0, 6.0, "time")
    kde = TemporalNetworkKDE(NetworkKDE(policy="simple"), None, LinearTime(), bandwidths=NetworkTimeBandwidths("h", "ht"))
    with_widths = events.withColumn("h", 1.0 + F.col("event_id") % 2).withColumn("ht", 2.0 + F.col("event_id") % 3)
    got = {(r.lixel_id, r.time_index): r.density for r in kde.evaluate(net, with_widths, lixels, cells).collect()}
    places = [(0, r.edge_index, r.center_offset, 0, 0) for r in lixels.orderBy("lixel_id").collect()]
    cross, w = plain_distances([*rows, *places])[: len(rows), len(rows) :], np.array([r[3] for r in rows])
    h, ht = 1.0 + np.arange(len(rows)) % 2, 2.0 + np.arange(len(rows)) % 3
    for k in range(4):
        when = np.exp(-0.5 * ((k * 6 + 3 - t) / ht) ** 2) / ht / math.sqrt(2 * math.pi)
        f = (w / w.sum() * when) @ (epanechnikov(cross / h[:, None]) / h[:, None])
        assert np.allclose([got[i, k] for i in range(len(places))], f, rtol=1e-9)


def test_checks_of_places_and_lixels(spark):
    net, events, _ = timed_case(spark)
    assert net.check_places(events, "event_id").valid and net.check_lixels(net.lixels(0.3)).valid
    bad = spark.createDataFrame([(1, 0, 1.5, 1.0), (1, 999, 0.5, 1.0), (2, 0, float("nan"), 1.0)], EVENT)
    assert {i.code for i in net.check_places(bad, "event_id").errors} == {"duplicate_ids", "unknown_edge", "offset"}
    assert {i.code for i in net.check_lixels(net.lixels(0.3).where("lixel_id > 2 and edge_index <> 5")).errors} == {"bare", "broken"}
    assert Network.shape(spark, "t").summary().first().n_nodes == 4 and components(Network.shape(spark, "disconnected")).select("component").distinct().count() == 2
    with pytest.raises(ValueError):
        Network.from_tables(net.nodes, net.edges, crs="EPSG:4326", require_projected=True)
    rule = JunctionPolicy("halves", lambda n: F.lit(0.5), start=lambda n: F.lit(1.0))
    field = NetworkKDE(bandwidth=1.0, policy=rule).evaluate(Network.shape(spark, "cross"), spark.createDataFrame([(0, 0, 0.5, 1.0)], EVENT), Network.shape(spark, "cross").lixels(0.5))
    got = {r.edge_index: r.density for r in field.where("start_offset = 0").collect()}
    assert math.isclose(got[1], 0.5 * 0.75 * (1 - 0.75**2)) and got[1] == got[2] == got[3]


@pytest.mark.parametrize("policy", ["discontinuous", "continuous"])
def test_merged_paths_carry_the_sum_of_all_paths(spark, policy):
    net = Network.grid(spark, 8, 8, 1.0)
    at = spark.createDataFrame([(0, 40, 0.25), (1, 40, 0.0)], "source int, edge_index long, offset double")
    places = net.lixels(0.5).select(F.col("lixel_id").alias("target"), "edge_index", F.col("center_offset").alias("offset"))
    kernel, h = get_kernel("epanechnikov"), 5.0

    def values(found):
        return {(r.source, r.target): r.k for r in kernel_from_stretches(found.withColumn("h", F.lit(h)), places, kernel, F.col("h")).collect()}

    one, all_paths = (propagate(net, at, h, policy=policy, merged=m) for m in (True, False))
    n, many = (x.where("source = 0").count() for x in (one, all_paths))
    assert n < many / (4 if policy == "continuous" else 1.5)
    want = values(all_paths)
    got = values(one)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-10) for k in want)


def test_far_propagation_is_polynomial(spark):
    net = Network.grid(spark, 8, 8, 1.0)
    at = spark.createDataFrame([(0, 40, 0.25)], "source int, edge_index long, offset double")
    sizes = {h: propagate(net, at, float(h)).count() for h in (5, 10)}
    assert sizes[10] < 6 * sizes[5] and sizes[10] < 3000
    with pytest.raises(RuntimeError):
        propagate(net, at, 10.0, max_records=sizes[10] - 1)


def test_breakpoints_do_not_chain(spark):
    line = network(spark, [[(0, 0), (1, 0)]])
    offsets = [0.3 + i * 0.6e-12 for i in range(6)]
    rows = spark.createDataFrame([(i, 0, o, 1.0) for i, o in enumerate(offsets)], EVENT)
    points = heat.breakpoints(line, line.lixels(1.0), rows).where("raw > 0.2 and raw < 0.4").collect()
    assert len(points) == 6 and all(abs(r["raw"] - r["at"]) <= 1.0001e-12 for r in points) and len({r["at"] for r in points}) == 3


def test_heat_with_pieces_matches_the_whole(spark):
    net, events, cells = heat_case(spark, 3, 60, seed=8)
    points = heat.breakpoints(net, cells, events, 0.11)
    segments = heat.segments_of(points)
    nodes = heat.event_nodes(points, events)
    sources = nodes.select("component", "node", (F.col("event_id") % 2).cast("string").alias("key"), F.col("weight").alias("value"))
    names, _, (matrix,) = plain_heat(segments, [0.05])
    for piece, tile in ((1, 1000), (3, 1000), (4, 6)):
        rows = heat.evolve(segments, sources, [0.05], nodes=net.nodes, own=True, piece=piece, tile=tile).collect()
        for key in ("0", "1"):
            given = np.zeros(len(names))
            for r in sources.where(F.col("key") == key).collect():
                given[names.index(r.node)] += r.value
            got = {r.node: (r.value, r.own) for r in rows if r.key == key}
            assert np.allclose([got.get(n, (0.0, 0))[0] for n in names], matrix @ given, atol=1e-9 * (matrix @ given).max())
            assert all(math.isclose(got[n][1], matrix[i, i], rel_tol=1e-8) for i, n in enumerate(names) if n in got)


def test_an_edge_of_many_offsets_is_no_group(spark):
    line = network(spark, [[(0, 0), (1, 0)]])
    n = 40_000
    rows = spark.range(n).select(F.col("id").alias("event_id"), F.lit(0).cast("long").alias("edge_index"), ((F.col("id") + 0.5) / n).alias("offset"), F.lit(1.0).alias("weight"))
    found = HeatNetworkKDE(0.01).evaluate(line, rows, line.lixels(0.05)).collect()
    assert all(r.density == pytest.approx(1.0, abs=1e-7) for r in found)


@pytest.fixture(scope="module")
def workspace(spark):
    net = Network.grid(spark, 3, 3)
    rows = [(i, int(e), float(o), float(w), float(t)) for i, (e, o, w, t) in enumerate(np.random.default_rng(4).uniform((0, 0, 0.5, 0), (24, 1, 2, 24), (20, 4)))]
    return NetworkWorkspace.of(net, spark.createDataFrame(rows, EVENT + ", time double"), net.lixels(0.3))


def test_workspaces_give_the_fields_they_were_prepared_for(spark, workspace, tmp_path):
    made = workspace.prepare_distances(1.5).prepare_stretches("continuous", 1.5)
    path = str(tmp_path / "w")
    made.save(path)
    loaded = NetworkWorkspace.load(spark, path)
    for kde in (NetworkKDE("epanechnikov", 1.2, "simple"), NetworkKDE("quartic", 0.7, "simple", "intensity"), NetworkKDE("epanechnikov", 1.1, "continuous")):
        want, got = ({r.lixel_id: r[kde.target] for r in rows.collect()} for rows in (kde.evaluate(made.network, made.events, made.lixels), loaded.evaluate(kde)))
        assert got == pytest.approx(want, abs=1e-12)
    kde, cells = TemporalNetworkKDE(NetworkKDE("epanechnikov", 1.2, "simple"), 3.0, CyclicTime(24.0)), axis_cells(spark, 0.0, 24.0, 6.0, "time")
    want, got = (
        {(r.lixel_id, r.time_index): r.density for r in rows.collect()} for rows in (kde.evaluate(made.network, made.events, made.lixels, cells), loaded.evaluate_over_time(kde, cells))
    )
    assert got == pytest.approx(want, abs=1e-12)
    for kde in (NetworkKDE("epanechnikov", 1.6, "simple"), NetworkKDE("epanechnikov", 1.0, "discontinuous"), NetworkKDE("gaussian", 0.1, "simple")):
        with pytest.raises(ValueError):
            loaded.evaluate(kde)


def test_stale_assets_are_refused(spark, workspace, tmp_path):
    made = workspace.prepare_distances(1.0)
    asset = made.assets["distances"]
    other = NetworkWorkspace.of(made.network, made.events.where("event_id > 0"), made.lixels)
    with pytest.raises(ValueError, match="other events"):
        other.attach("distances", asset)
    path = str(tmp_path / "w")
    tables = {"nodes": made.network.nodes, "edges": made.network.edges, "events": other.events, "lixels": made.lixels, "asset_distances": asset.table}
    about = {"kind": "distances", "cutoff": 1.0, "directed": False, "made_from": dict(asset.made_from), "policy": "simple"}
    store.save(path, tables, {"workspace": 1, "directed": False, "crs": None, "assets": {"distances": about}})
    with pytest.raises(ValueError, match="other events"):
        NetworkWorkspace.load(spark, path)
    pairs = location_distances(made.network, made._sources(), made._targets(), 1.0).collect()
    assert asset.n_pairs() == len(pairs) and asset.density(20, 96) == len(pairs) / 1920
    mine = sorted(r.distance for r in pairs if r.source == 3)
    assert [r.distance for r in asset.neighbors(3).collect()] == pytest.approx(mine) and {r.source: r.n for r in asset.counts().collect()}[3] == len(mine)


@pytest.mark.parametrize("directed", [False, True])
def test_places_of_one_edge_meet_within_the_cutoff(spark, directed):
    line = network(spark, [[(0, 0), (100, 0)]], directed=directed)
    at = np.random.default_rng(2).uniform(0, 100, 60)
    places = spark.createDataFrame([(i, 0, float(x), float(0.5 + i % 7)) for i, x in enumerate(at)], "source long, edge_index long, offset double, cutoff double")
    targets = places.select(F.col("source").alias("target"), "edge_index", "offset")
    for cutoff in (0.7, 4.0, "cutoff"):
        got = {(r.source, r.target): r.distance for r in location_distances(line, places, targets, cutoff).collect()}
        reach = lambda i: 0.5 + i % 7 if cutoff == "cutoff" else cutoff
        want = {(i, j): abs(x - y) for i, x in enumerate(at) for j, y in enumerate(at) if abs(x - y) <= reach(i) and (y >= x or not directed)}
        assert got == pytest.approx(want)


def test_pairs_of_places_are_not_shuffled(spark):
    """Distances equal brute force over nodes, directed or not, with own cutoffs; a pair is one row that goes straight to its target's sum."""
    rng = np.random.default_rng(5)
    lines = [[tuple(map(float, rng.integers(0, 4, 2))) for _ in range(2)] for _ in range(14)]
    lines = [line for line in lines if line[0] != line[1]]
    for one_way, cutoff in ((False, "cutoff"), (True, None)):
        net = network(spark, lines, directed=one_way)
        e = {r.edge_index: (r.u, r.v, r.length) for r in net.edges.collect()}
        rows = [(i, int(k := rng.choice(list(e))), float(rng.choice([0.0, 1.0, rng.random()]) * e[k][2]), float(rng.uniform(0.1, 4))) for i in range(40)]
        s = spark.createDataFrame(rows, "source long, edge_index long, offset double, cutoff double")
        t = s.select(F.col("source").alias("target"), "edge_index", "offset")
        names = sorted({n for u, v, _ in e.values() for n in (u, v)})
        # a graph in which every place is a node
        at = {n: i for i, n in enumerate(names)}
        size = len(names) + len(rows)
        far = np.full((size, size), np.inf)
        for k, (u, v, length) in e.items():
            stops = sorted([(0.0, at[u]), (length, at[v]), *((o, len(names) + i) for i, x, o, _ in rows if x == k)])
            for (p, a), (q, b) in zip(stops, stops[1:], strict=False):
                for x, y in ((a, b), *(() if one_way and q > p else ((b, a),))):
                    far[x, y] = min(far[x, y], q - p + 1e-13)
        np.fill_diagonal(far, 0.0)
        for i in range(size):
            far = np.minimum(far, far[:, i : i + 1] + far[i : i + 1])
        want = far[len(names) :, len(names) :]
        top = [np.inf if cutoff is None else r[3] for r in rows]
        d = location_distances(net, s, t, cutoff, carry=["cutoff"] if cutoff is None else ())
        got = [(r.source, r.target, r.distance) for r in d.collect()]
        assert len({x[:2] for x in got}) == len(got)
        assert {x[:2] for x in got} == {(i, j) for i in range(40) for j in range(40) if want[i, j] <= top[i] and np.isfinite(want[i, j])}
        assert all(abs(want[i, j] - x) < 1e-9 for i, j, x in got)
        plan = d.groupBy("target").count()._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(source" not in plan


@pytest.mark.parametrize("directed", [False, True])
def test_neighbours_are_found_without_pairs(spark, directed, monkeypatch):
    square = network(spark, [[(0, 0), (1, 0)], [(1, 0), (1, 1)], [(1, 1), (0, 1)], [(0, 1), (0, 0)], [(0, 0), (1, 1)]], directed=directed)
    r = np.random.default_rng(8)
    rows = [(i, int(e), float(min(o, 1.0)), 1.0, float(t)) for i, (e, o, t) in enumerate(zip(r.integers(0, 5, 40), r.choice([0.0, 0.25, 0.3, 0.7, 1.0], 40) + r.uniform(0, 0.01, 40) * (np.arange(40) % 3), r.integers(0, 24, 40)))]
    events = spark.createDataFrame(rows, EVENT + ", time double")
    places = [events.select(F.col("event_id").alias(n), "edge_index", "offset") for n in ("source", "target")]
    pairs = location_distances(square, *places, None).where("source <> target").collect()
    monkeypatch.setattr("fieldloom.operators.network.location_distances", lambda *a, **k: pytest.fail("pairs"))
    for k in (1, 7):
        got = {x.source: x.h for x in NetworkKNNBandwidth(k, minimum=1e-6).resolve(square, events).collect()}
        assert got == pytest.approx({i: max(1e-6, sorted(x.distance for x in pairs if x.source == i)[k - 1]) for i in range(40)})


@pytest.mark.parametrize("kernel, crowded", [("epanechnikov", False), ("quartic", True), ("triangular", False), ("uniform", True)])
def test_selection_sums_kernels_without_pairs(spark, kernel, crowded, monkeypatch):
    bow = network(spark, [[(0, 0), (1, 0)], [(1, 0), (1, 1)], [(1, 1), (0, 1)], [(0, 1), (0, 0)], [(0, 0), (1, 1)], [(0, 0), (-1.5, 0.5), (0, 1)]])
    r = np.random.default_rng(11)
    length = {x.edge_index: x.length for x in bow.edges.collect()}
    rows = [(i, int(e), float(length[int(e)] * o), float(w), float(t)) for i, (e, o, w, t) in enumerate(zip(r.integers(0, 6, 60), r.choice([0.0, 0.31, 1.0, 0.5], 60) * 0.9 + r.uniform(0, 0.1, 60), r.uniform(0.5, 2, 60), r.integers(0, 9, 60)))]
    events, cells, w, t = spark.createDataFrame(rows, EVENT + ", time double"), bow.lixels(0.3), np.array([x[3] for x in rows]), np.array([x[4] for x in rows])
    source, target = (events.select(F.col("event_id").alias(n), "edge_index", "offset") for n in ("source", "target"))
    at = cells.select(F.col("lixel_id").alias("target"), "edge_index", F.col("center_offset").alias("offset"))
    d, cross, size = np.zeros((60, 60)), np.zeros((60, at.count())), np.array([x.length for x in cells.orderBy("lixel_id").collect()])
    for to, where in ((target, d), (at, cross)):
        for x in location_distances(bow, source, to, None).collect():
            where[x.source, x.target] = x.distance
    monkeypatch.setattr("fieldloom.operators.network_selection.location_distances", lambda *a, **k: pytest.fail("pairs"))
    if crowded:
        monkeypatch.setattr("fieldloom.plans.lines.MOST", 10)
        monkeypatch.setattr("fieldloom.plans.lines.BLOCK", 64)
    f, hs, hts = get_kernel(kernel), (0.2, 1.7), (2.0, 5.0)
    loo = lambda k: w @ (k * (1 - np.eye(60))) / (w.sum() - w)
    plain, squares, joint = {}, {}, {}
    for h in hs:
        k = f.scaled_array(d * d, h, 1)
        plain[h] = -(w @ np.log(np.maximum(loo(k), 1e-300))) / w.sum()
        squares[h] = ((w / w.sum() @ f.scaled_array(cross * cross, h, 1)) ** 2) @ size - 2 * w @ loo(k) / w.sum()
        for ht in hts:
            both = k * get_kernel("gaussian").scaled_array((t[:, None] - t) ** 2, ht, 1)
            joint[h, ht] = -(w @ np.log(np.maximum(loo(both), 1e-300))) / w.sum()
    got = {x.h: x.score for x in selection.NetworkBandwidthGrid(hs, kernel=kernel).scores(bow, events).collect()}
    assert got == pytest.approx(plain, rel=1e-9)
    got = {x.h: x.score for x in selection.NetworkBandwidthGrid(hs, "least_squares", kernel).scores(bow, events, cells).collect()}
    assert got == pytest.approx(squares, rel=1e-9)
    run = selection.NetworkTimeBandwidthExperiment(hs, hts, LinearTime(), kernel, policy="simple")
    assert {(x.h, x.ht): x.score for x in run.scores(bow, events).collect()} == pytest.approx(joint, rel=1e-9)


@pytest.mark.parametrize("policy", ["continuous", "discontinuous"])
def test_paths_are_followed_once_for_each_edge(spark, policy, monkeypatch):
    net = Network.grid(spark, 3, 3)
    r = np.random.default_rng(5)
    rows = [(i, int(e), float(o), float(w), float(h)) for i, (e, o, w, h) in enumerate(zip(r.integers(0, 24, 30), r.choice([0.0, 1.0, 0.15, 0.6, 0.83], 30), r.uniform(0.5, 2, 30), r.choice([0.4, 1.5, 2.3], 30)))]
    events, cells = spark.createDataFrame(rows, EVENT + ", h double"), net.lixels(0.3)
    kde = NetworkKDE("epanechnikov", "h", policy)
    want = {x.lixel_id: x.density for x in kde.field(events, cells, kde.kernel_values(net, events, cells)).collect()}  # by stretches of each event
    monkeypatch.setattr("fieldloom.operators.network.kernel_from_stretches", lambda *a, **k: pytest.fail("stretches of events"))
    assert {x.lixel_id: x.density for x in kde.evaluate(net, events, cells).collect()} == pytest.approx(want, abs=1e-12)


def test_workspaces_keep_ways_between_edges_and_no_pairs(spark, workspace, tmp_path):
    made = workspace.prepare_distances(1.5)
    many = workspace.events.withColumn("event_id", F.explode(F.array(*[F.col("event_id") + 100 * i for i in range(5)])))
    five = NetworkWorkspace.of(workspace.network, many, workspace.lixels).prepare_distances(1.5)
    made.save(str(tmp_path / "a")), five.save(str(tmp_path / "b"))
    rows = [store.load(spark, str(tmp_path / n))[0]["asset_distances"].count() for n in "ab"]
    assert rows[0] == rows[1] and five.assets["distances"].n_pairs() == 5 * made.assets["distances"].n_pairs()


def test_heat_tasks_hold_few_rows_as_objects():
    import pyarrow as pa

    table = pa.RecordBatch.from_pydict({"sizes": [[1.0] * 9000, [1.0] * 9000, [1.0] * 40000, [], [1.0] * 5]})
    parts = list(heat._some([table]))
    assert [len(x) for x in parts] == [1, 1, 1, 2] and pa.Table.from_batches(parts).combine_chunks().to_batches()[0].equals(table)
