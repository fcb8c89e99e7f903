"""Fields against closed forms and hand values."""

import math
import random

import pytest
from pyspark.sql import functions as F

from fieldloom.functions.kernels import get_kernel
from fieldloom.functions.time import CyclicTime, LinearTime
from fieldloom.operators import risk, selection
from fieldloom.operators.bandwidths import AbramsonBandwidth, BalloonKNNBandwidth, BandwidthMatrix, KNNBandwidth, kth_distances
from fieldloom.operators.spacetime import PairAsset, SpatiotemporalBandwidthExperiment, SpatiotemporalKDE
from fieldloom.operators.spatial import Metric, SpatialKDE, integral, to_grid, with_wkt
from fieldloom.sources.planar import Boundary, Events, Support, axis_count, fingerprint
from fieldloom.sources.store import load, save
from fieldloom.streaming.fields import field_sink, merged_field


def events(spark, points, weights=None, **more):
    dim = len(points[0])
    rows = [(i, *map(float, p), float((weights or [1] * len(points))[i])) for i, p in enumerate(points)]
    names = ["id", *("xyz"[:dim]), "w"]
    df = spark.createDataFrame(rows, "id long, " + ", ".join(f"{n} double" for n in names[1:]))
    return Events.from_frame(df, tuple("xyz"[:dim]), weight="w", event_id="id", **more)


def places(spark, points, **more):
    dim = len(points[0])
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], "id long, " + ", ".join(f"{c} double" for c in "xyz"[:dim]))
    return Support.points(df, tuple("xyz"[:dim]), support_id="id", **more)


def values(df, name="density", key="support_id"):
    return [r[name] for r in df.orderBy(key).collect()]


FOUR = [(-0.5, 0), (0, 0), (0.5, 0), (0, 0.5)]


def test_single_gaussian(spark):
    got = values(SpatialKDE("gaussian", 2.0).fit_evaluate(events(spark, [(0, 0)]), places(spark, [(0, 0), (2, 0)])))
    assert got == pytest.approx([1 / (8 * math.pi), math.exp(-0.5) / (8 * math.pi)], rel=1e-12)


@pytest.mark.parametrize("kernel", ["gaussian", "epanechnikov", "biweight", "triangular", "uniform", "Exponential"])
def test_kernels_integrate_to_one(spark, kernel):
    width = 14.0 if get_kernel(kernel).reach is None else 0.8
    grid = Support.grid(spark, (-width, -width, width, width), width / 100)
    f = SpatialKDE(kernel, 0.55).fit_evaluate(events(spark, [(0, 0)]), grid)
    assert integral(f, "density") == pytest.approx(1.0, abs=4e-3)


def test_weights_and_intensity(spark):
    grid = Support.grid(spark, (-5, -5, 5, 5), 0.1)
    f = SpatialKDE("gaussian", 0.6, "intensity").fit_evaluate(events(spark, FOUR, [1, 2, 3, 4]), grid)
    assert integral(f, "intensity") == pytest.approx(10.0, rel=3e-4)
    assert to_grid(f, "intensity", grid.shape).shape == (100, 100)
    assert with_wkt(f).select("geometry").first()[0].startswith("POINT (")


def test_checks(spark):
    e = events(spark, FOUR + [(0, 0)], [1, 1, 1, 1, 0])
    assert {i.code for i in e.check().warnings} >= {"duplicate_coordinates"} and e.check().valid
    assert not events(spark, [(math.nan, 0)]).check().valid and not events(spark, [(0, 0)], [-1]).check().valid
    assert not events(spark, [(0, 0)], [0]).check().valid
    with pytest.raises(ValueError):
        SpatialKDE("gaussian", True).fit(e)
    with pytest.raises(ValueError):
        SpatialKDE("none", 1.0).fit(e)
    with pytest.raises(ValueError):
        SpatialKDE().fit_evaluate(e, Support(places(spark, [(0, 0)]).df, ("x", "z")))


def test_grid_keeps_the_remainder(spark):
    g = Support.grid(spark, (0, 0, 2.5, 1), 1.0)
    assert g.shape == (1, 3) and [r.measure for r in g.df.orderBy("support_id").collect()] == [1.0, 1.0, 0.5]


def test_nearest_neighbour_bandwidths(spark):
    line = events(spark, [(0,), (1,), (3,), (6,)])
    assert values(KNNBandwidth(1).resolve(line), "bandwidth", "event_id") == [1, 1, 2, 3]
    assert values(KNNBandwidth(2).resolve(line), "bandwidth", "event_id") == [3, 2, 3, 5]
    twice = events(spark, [(0,), (0,), (1,)])
    with pytest.raises(ValueError):
        KNNBandwidth(1).resolve(twice)
    assert values(KNNBandwidth(1, minimum=0.1).resolve(twice), "bandwidth", "event_id") == [0.1, 0.1, 1.0]
    assert values(BalloonKNNBandwidth(2).resolve(events(spark, [(0,), (2,), (5,)]), places(spark, [(1,), (4,)])), "bandwidth") == [1, 2]
    assert len(values(AbramsonBandwidth(1.0).resolve(line), "bandwidth", "event_id")) == 4


def test_nearest_neighbours_by_cells_equal_all_pairs(spark):
    r = random.Random(6)
    pts = [(r.gauss(0, 1), r.gauss(0, 9)) for _ in range(120)] + [(0.5, 0.5)] * 5 + [(400.0, 0.0)]
    e = events(spark, pts)
    a = e.df.select("event_id", F.col("x").alias("t_x"), F.col("y").alias("t_y"))
    b = e.df.select(F.col("event_id").alias("other_id"), "x", "y")
    for k in (1, 4):
        both = [
            {q.event_id: q.distance for q in kth_distances(a, b, ["t_x", "t_y"], ["x", "y"], "event_id", k, other="other_id", brute_rows=n).collect()} for n in (0, 5000)
        ]
        assert both[0] == pytest.approx(both[1]) and len(both[0]) == len(pts)


def test_adaptive_bucket_join_equals_all_pairs(spark):
    e = events(spark, [((i * 7) % 13 / 3, (i * 5) % 11 / 2) for i in range(40)])
    p = places(spark, [(i / 4, i / 5) for i in range(20)])
    h = KNNBandwidth(3, minimum=0.2)
    got = values(SpatialKDE("quartic", h).fit_evaluate(e, p))
    hs = {r.event_id: r.bandwidth for r in h.resolve(e).collect()}
    pts = {r.event_id: (r.x, r.y) for r in e.df.collect()}

    def k(u):
        return 3 / math.pi * (1 - u * u) ** 2 if u <= 1 else 0.0

    want = [sum(k(math.dist((i / 4, i / 5), pts[j]) / hs[j]) / hs[j] ** 2 for j in pts) / 40 for i in range(20)]
    assert got == pytest.approx(want, rel=1e-9)


def test_matrix_bandwidth(spark):
    h = BandwidthMatrix(((1.2, 0.35), (0.35, 0.6)))
    got = values(SpatialKDE("gaussian", h).fit_evaluate(events(spark, [(0.2, -0.1)]), places(spark, [(0.5, 0.4)])))[0]
    det = 1.2 * 0.6 - 0.35**2
    q = (0.6 * 0.3**2 - 2 * 0.35 * 0.3 * 0.5 + 1.2 * 0.5**2) / det
    assert got == pytest.approx(math.exp(-q / 2) / (2 * math.pi * math.sqrt(det)), rel=1e-12)
    with pytest.raises(ValueError):
        BandwidthMatrix(((1.0, 2.0), (2.0, 1.0)))


def test_leave_one_out_of_two(spark):
    pair = events(spark, [(0,), (2,)])
    got = selection.likelihood_scores(pair, get_kernel("gaussian"), [1.25]).first().score
    assert got == pytest.approx(-math.log(math.exp(-0.5 * 1.6**2) / math.sqrt(2 * math.pi) / 1.25), rel=1e-12)


def test_bounded_minimum():
    h, s, trace = selection.minimise_log(lambda h: (math.log(h) - 0.3) ** 2, (0.1, 10.0), 1e-6)
    assert h == pytest.approx(math.exp(0.3), rel=1e-4) and trace[0][0] > 0.1 and s < 1e-8


def test_boundaries(spark):
    square = Boundary.rectangle((0, 0, 1, 1))
    near = events(spark, [(0.04, 0.5)])
    grid = Support.grid(spark, (0, 0, 1, 1), 0.02)
    plain = SpatialKDE("gaussian", 0.12).fit_evaluate(near, grid)
    fixed = SpatialKDE("gaussian", 0.12, boundary=square, boundary_correction="renorm").fit_evaluate(near, grid)
    assert integral(plain, "density") < 0.7 and integral(fixed, "density") == pytest.approx(1.0, abs=2e-3)
    mirrored = SpatialKDE("gaussian", 0.08, boundary=square, boundary_correction="reflect").fit_evaluate(near, grid)
    assert integral(mirrored, "density") == pytest.approx(1.0, abs=3e-3)
    triangle = Boundary((((((0, 0), (1, 0), (0, 1))),),))
    df = spark.createDataFrame([(0.1, 0.1), (0.5, 0.5), (0.9, 0.9), (0.0, 0.0)], "x double, y double")
    assert [r[0] for r in df.select(triangle.covers(F.col("x"), F.col("y"))).collect()] == [True, True, False, True]
    assert df.select(triangle.edge_distance(F.col("x"), F.col("y"))).first()[0] == pytest.approx(0.1)
    with pytest.raises(ValueError):
        SpatialKDE("gaussian", 0.1, boundary=square).fit(events(spark, [(2, 2)]))
    assert sum(c[2] for c in triangle.clipped_cells(80)) == pytest.approx(0.5, rel=1e-12)
    ring = Boundary(((((0, 0), (4, 0), (4, 4), (0, 4)), ((1, 1), (3, 1), (3, 3), (1, 3))),))
    assert sum(c[2] for c in ring.clipped_cells(10)) == pytest.approx(12.0) and len(ring.clipped_cells(4)) == 12
    kde = SpatialKDE("gaussian", 0.15, boundary=triangle, boundary_correction="renorm", cells_per_axis=80).fit(events(spark, [(0.08, 0.08), (0.3, 0.2)]))
    mass = [0.5 / r.a for r in kde.rows.collect()]
    assert all(0.45 < m < 1 for m in mass)


def test_space_time(spark):
    def at(times, domain):
        df = spark.createDataFrame([(i, 0.0, float(t)) for i, t in enumerate(times)], "id long, x double, t double")
        return Events.from_frame(df, ("x",), event_id="id", time="t", domain=domain), Support.points(df, ("x",), support_id="id", time="t", domain=domain)

    e, p = at([0], LinearTime())
    assert values(SpatiotemporalKDE(2.0, 3.0).evaluate(e, p))[0] == pytest.approx(1 / (12 * math.pi), rel=1e-12)
    day = CyclicTime(24.0)
    one, _ = at([0], day)
    _, three = at([1, 23, 25], day)
    got = values(SpatiotemporalKDE(1.0, 10.0).evaluate(one, three))
    nearest = math.exp(-0.5 * 0.01) / (2 * math.pi * 10)
    assert got[0] == pytest.approx(got[1]) == pytest.approx(got[2]) and got[0] > nearest
    with pytest.raises(ValueError):
        CyclicTime(0.0)


def test_rates_and_risk(spark):
    cells = Support.grid(spark, (0, 0, 2.5, 1), 1.0).df
    flat = cells.withColumn("intensity", F.lit(8.0))
    exposure = risk.exposure_from_amounts(cells, cells.select("support_id", (2 * F.col("measure")).alias("n")), "n")
    found = risk.event_rate(flat, exposure)
    assert values(found, "event_rate") == [4.0, 4.0, 4.0]
    s = risk.rate_summary(found).first()
    assert (s.event_mass, s.exposure, s.mean_rate, s.effective_mean_rate) == (20.0, 5.0, 4.0, 4.0)

    def field(v):
        return cells.join(spark.createDataFrame(list(enumerate(v)), "support_id long, density double"), "support_id")

    case, control = field([0.2, 0.4, 0.8]), field([0.4, 0.4, 0.4])
    got = risk.relative_risk(case, control)
    assert values(got, "relative_risk") == pytest.approx([0.5, 1, 2]) and values(got, "log_relative_risk") == pytest.approx([math.log(0.5), 0, math.log(2)])
    case, control = field([0.0, 0.5, 1.0]), field([0.6, 0.0, 0.8])
    with pytest.raises(ValueError):
        risk.relative_risk(case, control)
    got = risk.relative_risk(case, control, risk.DenominatorPolicy("nan"))
    r, log = values(got, "relative_risk"), values(got, "log_relative_risk")
    assert r[0] == 0 and math.isnan(r[1]) and r[2] == pytest.approx(1.25) and log[0] == -math.inf and math.isnan(log[1])
    got = risk.relative_risk(case, control, risk.DenominatorPolicy("minimum", floor=0.25))
    assert values(got, "relative_risk") == pytest.approx([0, 2, 1.25]) and values(got, "adjusted_control_density") == [False, True, False]


def test_store_round_trip(spark, tmp_path):
    df = spark.range(5).withColumn("x", F.col("id") * 0.5)
    save(str(tmp_path / "b"), {"t": df}, {"unit": "m"})
    tables, meta = load(spark, str(tmp_path / "b"))
    assert tables["t"].count() == 5 and meta == {"unit": "m"}
    spark.range(4).withColumn("x", F.col("id") * 0.5).write.mode("overwrite").parquet(str(next((tmp_path / "b").glob("version-*")) / "t"))
    with pytest.raises(ValueError):
        load(spark, str(tmp_path / "b"))


def test_streamed_field_equals_batch(spark, tmp_path):
    rows = [(float(i % 5), float(i % 3), 1.0 + i % 2) for i in range(30)]
    schema = "x double, y double, weight double"
    for i in range(3):
        spark.createDataFrame(rows[10 * i : 10 * i + 10], schema).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    support = Support.grid(spark, (0, 0, 5, 3), 1.0)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    out = str(tmp_path / "sums")
    q = stream.writeStream.foreachBatch(field_sink(out, support, "epanechnikov", 1.5)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    batch = SpatialKDE("epanechnikov", 1.5).fit_evaluate(Events.from_frame(spark.createDataFrame(rows, schema), ("x", "y"), weight="weight"), support)
    assert values(merged_field(support, out)) == pytest.approx(values(batch), abs=1e-12)


def test_whole_tables_are_covered(spark, data):
    import numpy as np

    from fieldloom.queries import QUERIES

    orders = {r[0] for r in spark.read.parquet(f"{data}/orders.parquet").select("o_orderkey").collect()}
    near, far = ({r.event_id for r in QUERIES[n](spark, data).collect()} for n in ("snap_events", "snap_rejected"))
    assert near | far == orders and not near & far
    rows = spark.read.parquet(f"{data}/embeddings.parquet").select("vec_id", "embedding").collect()
    v = np.array([r.embedding for r in rows], dtype=float)
    want = {r.vec_id: np.exp(((v - x) ** 2).sum(axis=1) / -8).mean() for r, x in zip(rows, v, strict=True)}
    got = {r.support_id: r.kernel_mean for r in QUERIES["embedding_kde_64d"](spark, data).collect()}
    assert got == pytest.approx(want, abs=2e-6)


def frame(spark, rows, schema="x double"):
    return spark.createDataFrame(rows, schema)


def test_rows_without_ids_stay_apart(spark):
    repeated = Events.from_frame(frame(spark, [(0.0,), (0.0,), (1.0,)]), ("x",))
    assert sorted(r.bandwidth for r in KNNBandwidth(1, minimum=0.1).resolve(repeated).collect()) == [0.1, 0.1, 1.0]
    rows = Events.from_frame(frame(spark, [(0.0,), (0.0,), (1.0,), (3.0,)]), ("x",))
    h = {}
    for x in (0.0, 1.0, 3.0):
        h[x] = sum(math.exp(-0.5 * (x - y) ** 2) for y in (0, 0, 1, 3)) / 4 / math.sqrt(2 * math.pi)
    g = math.exp((2 * math.log(h[0.0]) + math.log(h[1.0]) + math.log(h[3.0])) / 4)
    width = {x: min(5.0, max(0.2, (f / g) ** -0.5)) for x, f in h.items()}
    want = sum(math.exp(-0.5 * (y / width[y]) ** 2) / width[y] for y in (0.0, 0.0, 1.0, 3.0)) / 4 / math.sqrt(2 * math.pi)
    at = Support.points(frame(spark, [(0, 0.0)], "id long, x double"), ("x",), support_id="id")
    assert SpatialKDE("gaussian", AbramsonBandwidth(1.0)).fit_evaluate(rows, at).first().density == pytest.approx(want)
    same = Events.from_frame(frame(spark, [(1, 0.0), (1, 1.0)], "id long, x double"), ("x",), event_id="id")
    with pytest.raises(ValueError, match="unique"):
        KNNBandwidth(1).resolve(same)
    assert not same.check(unique_ids=True).valid


def test_missing_coordinates_end_the_search(spark):
    rows = Events.from_frame(frame(spark, [(float(i),) for i in range(50)] + [(None,)]), ("x",))
    with pytest.raises(ValueError):
        KNNBandwidth(2).resolve(rows)
    targets, sources = frame(spark, [(1, float("nan"))], "t long, tx double"), frame(spark, [(float(i),) for i in range(50)])
    with pytest.raises(ValueError, match="finite"):
        kth_distances(targets, sources, ["tx"], ["x"], "t", 2, brute_rows=1)


def test_bounds_take_each_pair_once(spark):
    rows = Events.from_frame(frame(spark, [(x,) for x in (0.0, 1.0, 3.0, 7.0, 7.5)]), ("x",))
    row = selection.bandwidth_bounds(selection.pair_distances(rows)).first()
    assert (row.lower, row.upper) == pytest.approx((0.145, 14.55))


def test_axes_of_space_and_time_end_by_their_own_rules():
    assert axis_count(499_000, 500_003, 100, close=True) == 10 and axis_count(499_000, 500_003, 100) == 11
    assert axis_count(0, 1, 0.3) == 4 and axis_count(0, 1, 0.3, close=True) == 4 and axis_count(0, 1, 5) == 1


def test_hashes_tell_nulls_columns_and_types_apart(spark):
    one = frame(spark, [(None, 1), (2, 3)], "a int, b int")
    assert fingerprint(one) == fingerprint(one.orderBy("b"))
    for other in ([(1, None), (2, 3)], [(None, 1), (3, 2)], [(None, 1)]):
        assert fingerprint(one) != fingerprint(frame(spark, other, "a int, b int"))
    assert fingerprint(one) != fingerprint(frame(spark, [(None, 1), (2, 3)], "a long, b int"))
    maps = frame(spark, [({"a": 1, "b": 2},)], "m map<string,int>")
    assert fingerprint(maps) == fingerprint(frame(spark, [({"b": 2, "a": 1},)], "m map<string,int>"))


def test_points_from_geometry(spark):
    rows = Events.from_points(frame(spark, [("POINT (1 2.5)",), ("point(-3e1 4)",)], "geometry string"))
    assert sorted((r.x, r.y) for r in rows.df.collect()) == [(-30.0, 4.0), (1.0, 2.5)]
    with pytest.raises(ValueError):
        Events.from_points(frame(spark, [("LINESTRING (0 0, 1 1)",)], "geometry string"))


def test_matrix_bandwidths_are_renormalised_by_their_mass(spark):
    h = ((9.0, 4.0), (4.0, 4.0))
    box = (0.0, 0.0, 10.0, 8.0)
    rows = Events.from_frame(frame(spark, [(1.0, 1.0), (9.0, 4.0)], "x double, y double"), ("x", "y"))
    kde = SpatialKDE("gaussian", BandwidthMatrix(h), boundary=Boundary.rectangle(box), boundary_correction="renormalization")
    assert integral(kde.fit_evaluate(rows, Support.grid(spark, box, 0.05)), "density") == pytest.approx(1.0, abs=2e-4)


def test_metrics_corrections_and_tails_can_be_given(spark):
    rows = Events.from_frame(frame(spark, [(0.0, 0.0), (2.0, 1.0)], "x double, y double"), ("x", "y"))
    at = Support.points(frame(spark, [(0, 1.0, 1.0)], "id long, x double, y double"), ("x", "y"), support_id="id")
    block = Metric("blocks", lambda a, b: (F.abs(a[0] - b[0]) + F.abs(a[1] - b[1])) ** 2, lambda a, b: (abs(a[0] - b[0]) + abs(a[1] - b[1])) ** 2)
    want = (math.exp(-2) + math.exp(-0.5)) / 2 / (2 * math.pi)
    for metric in (block, Metric("blocks", block.squared)):
        assert SpatialKDE("gaussian", 1.0, metric=metric).fit_evaluate(rows, at).first().density == pytest.approx(want)

    class Doubled:
        name = "doubled"

        def apply(self, fitted):
            return fitted.rows.withColumn("a", F.col("a") * 2)

    plain = SpatialKDE("gaussian", 1.0).fit_evaluate(rows, at).first().density
    kde = SpatialKDE("gaussian", 1.0, boundary=Boundary.rectangle((-9, -9, 9, 9)), boundary_correction=Doubled())
    assert kde.fit_evaluate(rows, at).first().density == pytest.approx(2 * plain)
    assert SpatialKDE("gaussian", 1.0, tail_tolerance=1e-12).fit_evaluate(rows, at).first().density == pytest.approx(plain, rel=1e-9)
    with pytest.raises(ValueError):
        get_kernel("gaussian").check_values(frame(spark, [(-1.0,)]), "x", 2)


def test_risk_needs_the_same_cells_and_estimators(spark):
    cells = frame(spark, [(0, 1.0, 0.5), (1, 1.0, 0.5)], "support_id long, measure double, density double")
    for other in (cells.where("support_id = 0"), cells.withColumn("measure", F.lit(2.0))):
        with pytest.raises(ValueError, match="same cells"):
            risk.relative_risk(cells, other)
    for amounts in ([(0, 1.0)], [(0, 1.0), (1, -5.0)], [(0, 1.0), (1, 1.0), (1, 1.0)], [(0, 1.0), (1, 1.0), (2, 1.0)]):
        with pytest.raises(ValueError):
            risk.exposure_from_amounts(cells, frame(spark, amounts, "support_id long, n double"), "n")
    tiny = cells.withColumn("density", F.when(F.col("support_id") == 0, 1.0 - 1e-310).otherwise(1e-310))
    with pytest.raises(ValueError, match="overflows"):
        risk.relative_risk(cells, tiny)
    one, two = (risk.FieldView.of(cells, SpatialKDE("gaussian", h)) for h in (1.0, 2.0))
    with pytest.raises(ValueError, match="bandwidths"):
        risk.relative_risk(one, two)
    found = risk.risk_summary(risk.relative_risk(one, one)).first()
    assert (found.case_integral, found.control_weighted_mean, found.invalid) == (1.0, 1.0, 0)
    grid = Support.grid(spark, (0, 0, 2, 2), 1.0)
    risk.describe_support(grid).require_same(risk.describe_support(Support.grid(spark, (0, 0, 2, 2), 1.0)))
    with pytest.raises(ValueError):
        risk.describe_support(grid).require_same(risk.describe_support(Support.grid(spark, (0, 0, 2, 2), 0.5)))


def test_pair_assets_give_the_same_scores_and_know_their_events(spark):
    rows = Events.from_frame(frame(spark, [(i, i % 5 + 0.1 * i, 3.0 * i) for i in range(12)], "id long, x double, t double"), ("x",), event_id="id", time="t")
    run = SpatiotemporalBandwidthExperiment((0.5, 1.0), (4.0, 9.0))
    asset = PairAsset.of(rows)
    a, b = ({(r.hs, r.ht): (r.score, r.spatial_score, r.temporal_score) for r in x.collect()} for x in (run.scores(rows), run.scores(rows, asset)))
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], rel=1e-9) for k in a)
    with pytest.raises(ValueError, match="other events"):
        run.scores(Events.from_frame(rows.df.where("event_id < 9"), ("x",), event_id="event_id", time="time"), asset)


def test_overlapping_polygons_are_united(spark):
    two = Boundary(((((0, 0), (2, 0), (2, 2), (0, 2)),), (((1, 1), (3, 1), (3, 3), (1, 3)),)))
    at = frame(spark, [(1.5, 1.5), (0.5, 2.5), (2.0, 2.0), (2.5, 2.5), (3.0, 1.0), (2.5, 0.5), (1.2, 1.5)], "x double, y double")
    rows = at.select(two.covers(F.col("x"), F.col("y")).alias("c"), two.edge_distance(F.col("x"), F.col("y")).alias("d")).collect()
    assert [r.c for r in rows] == [True, False, True, True, True, False, True]
    assert rows[0].d == pytest.approx(math.hypot(0.5, 0.5)) and rows[2].d == pytest.approx(1.0) and rows[6].d == pytest.approx(math.hypot(0.2, 0.5))
    assert sum(a for _, _, a in two.clipped_cells(7)) == pytest.approx(7.0, abs=1e-12)
    united = two.dissolved.polygons
    assert len(united) == 1 and len(united[0]) == 1 and len(united[0][0]) == 8


def test_unions_keep_holes_and_shared_edges():
    from fieldloom.sources.polygons import union

    def area(polygons):
        rings = [[sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(r, (*r[1:], r[0]), strict=True)) / 2 for r in polygon] for polygon in polygons]
        assert all(r[0] > 0 and all(h < 0 for h in r[1:]) for r in rings)
        return sum(map(sum, rings))

    box = lambda x, y, w, h: ((x, y), (x + w, y), (x + w, y + h), (x, y + h))
    frame_of_four = tuple((b,) for b in (box(0, 0, 4, 1), box(0, 3, 4, 1), box(0, 0, 1, 4), box(3, 0, 1, 4)))
    found = union(frame_of_four)
    assert area(found) == pytest.approx(12) and [len(p) for p in found] == [2]
    assert area(union(((box(0, 0, 1, 1),), (box(1, 0, 1, 1),)))) == 2 and len(union(((box(0, 0, 1, 1),), (box(1, 0, 1, 1),)))) == 1
    assert len(union(((box(0, 0, 1, 1),), (box(1, 1, 1, 1),)))) == 2  # they touch at a point
    assert area(union(((box(0, 0, 4, 4), box(1, 1, 2, 2)[::-1]), (box(1.5, 1.5, 1, 1),)))) == pytest.approx(13)
    assert area(union(((box(0, 0, 2, 2),), (box(0, 0, 2, 2),), (box(0.5, 0.5, 1, 1),)))) == 4


def test_a_coast_of_many_vertices(spark):
    import numpy as np

    n = 100_000
    turn = np.linspace(0, 2 * np.pi, n, endpoint=False)
    far = 1 + 0.2 * np.sin(9 * turn) + 0.001 * np.sin(5000 * turn)
    coast = Boundary((((tuple(zip((far * np.cos(turn)).tolist(), (far * np.sin(turn)).tolist(), strict=True))),),))
    rng = np.random.default_rng(1)
    at = rng.uniform(-1.3, 1.3, (2000, 2))
    rows = frame(spark, [(i, float(x), float(y)) for i, (x, y) in enumerate(at)], "i int, x double, y double")
    got = rows.select("i", coast.covers(F.col("x"), F.col("y")).alias("c"), coast.edge_distance(F.col("x"), F.col("y")).alias("d")).orderBy("i").collect()
    angle = np.arctan2(at[:, 1], at[:, 0])
    gap = np.hypot(*at.T) - (1 + 0.2 * np.sin(9 * angle) + 0.001 * np.sin(5000 * angle))
    clear = np.abs(gap) > 1e-4
    assert [r.c for r, ok in zip(got, clear, strict=True) if ok] == (gap[clear] < 0).tolist()
    vertices = np.stack([far * np.cos(turn), far * np.sin(turn)], axis=1)
    for i in range(0, 2000, 100):
        assert got[i].d == pytest.approx(np.hypot(*(vertices - at[i]).T).min(), abs=2e-4)
    assert coast.outside(rows) == sum(not r.c for r in got)


def test_large_and_small_boundaries_agree(spark):
    ring = tuple((math.cos(i / 30 * 2 * math.pi), math.sin(i / 30 * 2 * math.pi)) for i in range(30))
    hole = tuple((x / 2, y / 2) for x, y in ring)
    one = Boundary(((ring, hole),))
    rows = frame(spark, [(x / 4, y / 4) for x in range(-5, 6) for y in range(-5, 6)] + [ring[3], hole[4], (None, 0.0)], "x double, y double")
    import numpy as np

    table = rows.select("x", "y", one.covers(F.col("x"), F.col("y")).alias("c"), one.edge_distance(F.col("x"), F.col("y")).alias("d")).collect()
    x, y = (np.array([np.nan if r[i] is None else r[i] for r in table]) for i in (0, 1))
    assert one._index.covers(x, y).tolist() == [bool(r.c) for r in table]
    assert one._index.distance(x, y)[:-1].tolist() == pytest.approx([r.d for r in table[:-1]])


def test_bundles_are_swapped_as_a_whole(spark, tmp_path):
    from fieldloom.sources import store

    path, a, b = str(tmp_path / "bundle"), frame(spark, [(1.0,)]), frame(spark, [(2.0,), (3.0,)])
    store.save(path, {"a": a, "b": b}, {"n": 1}, sources={"events": fingerprint(a)})
    with pytest.raises(FileExistsError):
        store.save(path, {"a": b})
    failing = b.select(F.raise_error(F.lit("stop")).cast("double").alias("x"))
    with pytest.raises(Exception, match="stop"):
        store.save(path, {"a": b, "b": failing}, {"n": 2}, overwrite=True)
    tables, about = store.load(spark, path, sources={"events": a})
    assert about == {"n": 1} and tables["a"].count() == 1 and tables["b"].count() == 2
    with pytest.raises(ValueError, match="prepared"):
        store.load(spark, path, sources={"events": b})
    for n in (2, 3):
        store.save(path, {"a": b}, {"n": n}, overwrite=True)
    tables, about = store.load(spark, path)
    assert about == {"n": 3} and set(tables) == {"a"}
    import os

    assert len([x for x in os.listdir(path) if x.startswith("version-")]) == 3  # the last two, and the one that failed
