"""Linear networks as DataFrames: nodes and edges, lixels, and events snapped to edges."""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldloom.plans.lineage import cut
from fieldloom.sources.planar import Events, Issue, Report, bad, fingerprint

TOLERANCE = 1e-9
# Names of common geographic coordinate systems, in degrees.
GEOGRAPHIC = frozenset("EPSG:4326 EPSG:4269 EPSG:4258 EPSG:4283 EPSG:4674 EPSG:4490 OGC:CRS84 WGS84".split())


@dataclass(frozen=True)
class Network:
    """nodes (node_id, x, y); edges (edge_index, u, v, length, cost, geometry: array of (x, y)). Parallel edges and loops are
    allowed; direction counts only if `directed`."""

    nodes: DataFrame
    edges: DataFrame
    directed: bool = False
    crs: str | None = None

    @classmethod
    def from_lines(
        cls,
        df: DataFrame,
        *,
        edge_index: str,
        geometry: str = "geometry",
        u: str | None = None,
        v: str | None = None,
        length: str | None = None,
        cost: str | None = None,
        directed: bool = False,
        tolerance: float | None = None,
        crs: str | None = None,
    ) -> Network:
        """Edges from polylines. Without node columns, end points are nodes, equal exactly or when rounded to the tolerance. A
        missing length is that of the line; a missing cost is the length."""
        line = F.col(geometry)
        first, last = F.element_at(line, 1), F.element_at(line, -1)

        def node(p: Column) -> Column:
            x, y = (p["x"], p["y"]) if tolerance is None else (F.rint(p["x"] / tolerance), F.rint(p["y"] / tolerance))
            return F.concat_ws(",", (x + 0.0).cast("string"), (y + 0.0).cast("string"))

        pieces = F.transform(F.sequence(F.lit(1), F.size(line) - 1), lambda i: F.hypot(F.get(line, i)["x"] - F.get(line, i - 1)["x"], F.get(line, i)["y"] - F.get(line, i - 1)["y"]))
        drawn = F.aggregate(pieces, F.lit(0.0), lambda a, b: a + b)
        size = F.coalesce(F.col(length).cast("double"), drawn) if length else drawn
        edges = df.select(
            F.col(edge_index).cast("long").alias("edge_index"),
            (F.col(u).cast("string") if u else node(first)).alias("u"),
            (F.col(v).cast("string") if v else node(last)).alias("v"),
            size.alias("length"),
            (F.coalesce(F.col(cost).cast("double"), size) if cost else size).alias("cost"),
            line.alias("geometry"),
        )
        ends = edges.select(F.col("u").alias("node_id"), F.element_at("geometry", 1).alias("p")).union(edges.select("v", F.element_at("geometry", -1)))
        nodes = ends.groupBy("node_id").agg(F.min("p").alias("p")).select("node_id", "p.x", "p.y")
        return cls(nodes, edges, directed, crs)

    @classmethod
    def from_tables(cls, nodes: DataFrame, edges: DataFrame, *, directed: bool = False, crs: str | None = None, require_projected: bool = False) -> Network:
        """From node (node_id, x, y) and edge (edge_index, u, v [, length, cost, geometry]) tables, as a graph has them: a missing
        geometry is the straight line, a missing length the geometry's, a missing cost the length. A geographic coordinate system is refused
        if projected coordinates are required, as for graphs of streets in degrees."""
        if require_projected and (crs is None or str(crs).upper().replace(" ", "") in GEOGRAPHIC):
            raise ValueError("the network needs projected coordinates; its system is " + str(crs))
        e = edges
        if "geometry" not in e.columns:
            a = nodes.select(F.col("node_id").alias("u"), F.struct("x", "y").alias("p"))
            b = nodes.select(F.col("node_id").alias("v"), F.struct("x", "y").alias("q"))
            e = e.join(a, "u").join(b, "v").withColumn("geometry", F.array("p", "q")).drop("p", "q")
        for name in ("length", "cost"):
            if name not in e.columns:
                e = e.withColumn(name, F.lit(None).cast("double"))
        made = cls.from_lines(e, edge_index="edge_index", u="u", v="v", length="length", cost="cost", directed=directed, crs=crs)
        return cls(nodes.select(F.col("node_id").cast("string").alias("node_id"), "x", "y"), made.edges, directed, crs)

    @classmethod
    def grid(cls, spark: SparkSession, rows: int, columns: int, spacing: float = 1.0, directed: bool = False) -> Network:
        """A street grid of rows x columns blocks: horizontal edges row by row, then vertical ones."""
        across, along = (rows + 1) * columns, rows * (columns + 1)
        i = F.col("id")
        h, k = i < across, i - across
        r = F.when(h, F.floor(i / columns)).otherwise(F.floor(k / (columns + 1)))
        c = F.when(h, i % columns).otherwise(k % (columns + 1))
        r2, c2 = F.when(h, r).otherwise(r + 1), F.when(h, c + 1).otherwise(c)
        point = lambda a, b: F.struct((b * spacing).cast("double").alias("x"), (a * spacing).cast("double").alias("y"))
        name = lambda a, b: (a * (columns + 1) + b).cast("string")
        lines = spark.range(across + along).select(
            i.alias("edge_index"), name(r, c).alias("u"), name(r2, c2).alias("v"), F.array(point(r, c), point(r2, c2)).alias("geometry")
        )
        return cls.from_lines(lines, edge_index="edge_index", u="u", v="v", directed=directed)

    @classmethod
    def shape(cls, spark: SparkSession, name: str, spacing: float = 1.0) -> Network:
        """Small networks by name: t (three arms), cross (four arms), ring (four edges in a square), disconnected (two lines apart)."""
        ends = {
            "t": [((0, 0), (-1, 0)), ((0, 0), (1, 0)), ((0, 0), (0, -1))],
            "cross": [((0, 0), (1, 0)), ((0, 0), (0, 1)), ((0, 0), (-1, 0)), ((0, 0), (0, -1))],
            "ring": [((0, 0), (1, 0)), ((1, 0), (1, 1)), ((1, 1), (0, 1)), ((0, 1), (0, 0))],
            "disconnected": [((0, 0), (1, 0)), ((10, 0), (11, 0))],
        }.get(name)
        if ends is None:
            raise ValueError("the shapes are t, cross, ring and disconnected")
        rows = [(i, [(x * float(spacing), y * float(spacing)) for x, y in line]) for i, line in enumerate(ends)]
        return cls.from_lines(spark.createDataFrame(rows, "edge_index long, geometry array<struct<x:double,y:double>>"), edge_index="edge_index")

    def oriented(self, directed: bool | None = None, weight: str = "length") -> DataFrame:
        """(edge_index, direction, from_node, to_node, length, weight): each edge forward, and backward unless directed."""
        forward = self.edges.select("edge_index", F.lit(1).alias("direction"), F.col("u").alias("from_node"), F.col("v").alias("to_node"), "length", F.col(weight).alias("weight"))
        if self.is_directed(directed):
            return forward
        back = self.edges.select("edge_index", F.lit(-1).alias("direction"), F.col("v").alias("from_node"), F.col("u").alias("to_node"), "length", F.col(weight).alias("weight"))
        return forward.union(back)

    def is_directed(self, directed: bool | None = None) -> bool:
        return self.directed and (directed is None or directed)

    def adjacency(self, directed: bool | None = None, weight: str = "length") -> DataFrame:
        """(from_node, to_node, weight): the cheapest of parallel edges; loops left out."""
        return self.oriented(directed, weight).where("from_node <> to_node").groupBy("from_node", "to_node").agg(F.min("weight").alias("weight"))

    def quality(self) -> DataFrame:
        """One row: edges, loops, node pairs with parallel edges, bad lengths or costs, and end points off their node."""
        e = self.edges
        pairs = e.groupBy(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).agg(F.count(F.lit(1)).alias("n"))
        parallel = pairs.agg(F.count_if(F.col("n") > 1).alias("parallel_pairs"))
        a = self.nodes.select(F.col("node_id").alias("u"), F.struct("x", "y").alias("p"))
        b = self.nodes.select(F.col("node_id").alias("v"), F.struct("x", "y").alias("q"))
        gap = lambda p, q: F.hypot(p["x"] - q["x"], p["y"] - q["y"])
        rows = e.join(a, "u", "left").join(b, "v", "left")
        off = F.greatest(gap(F.element_at("geometry", 1), F.col("p")), gap(F.element_at("geometry", -1), F.col("q")))
        one = rows.agg(
            F.count(F.lit(1)).alias("edges"),
            F.count_if(F.col("u") == F.col("v")).alias("loops"),
            F.count_if(~(F.col("length") > 0) | ~(F.col("cost") > 0)).alias("bad_lengths"),
            F.count_if(off > 1e-6).alias("endpoint_mismatches"),
        )
        return one.crossJoin(F.broadcast(parallel))  # one row each

    def check(self) -> Report:
        r = self.quality().first()
        found = [Issue("error", "lengths", f"{r['bad_lengths']} lengths or costs are not positive")] if r["bad_lengths"] else []
        found += [Issue("warning", c, f"{r[c]} found") for c in ("loops", "parallel_pairs", "endpoint_mismatches") if r[c]]
        if self.crs is None:
            found.append(Issue("warning", "missing_crs", "no coordinate system is given"))
        return Report(tuple(found))

    def check_places(self, places: DataFrame, key: str) -> Report:
        """Errors of places (key, edge_index, offset) on the network: ids that repeat or are missing, unknown edges, offsets that are not
        finite or lie off their edge by more than 1e-9."""
        e = self.edges.select("edge_index", F.col("length").alias("__length"))
        off = F.col("offset").cast("double")
        row = places.select(key, "edge_index", "offset").join(e, "edge_index", "left").agg(
            F.count(F.lit(1)).alias("n"), F.count_distinct(key).alias("ids"), F.count_if(F.col("__length").isNull()).alias("unknown"),
            F.count_if(bad(off) | (off < -TOLERANCE) | (off > F.col("__length") + TOLERANCE)).alias("off"),
        ).first()
        found = []
        if row["ids"] < row["n"]:
            found.append(Issue("error", "duplicate_ids", f"{row['n'] - row['ids']} ids repeat or are missing"))
        if row["unknown"]:
            found.append(Issue("error", "unknown_edge", f"{row['unknown']} places name no edge of the network"))
        if row["off"]:
            found.append(Issue("error", "offset", f"{row['off']} offsets lie off their edges"))
        return Report(tuple(found))

    def check_lixels(self, lixels: DataFrame) -> Report:
        """Errors where lixels do not cover each edge from end to end without gaps, within 1e-9 or 1e-12 of the edge."""
        along = Window.partitionBy("edge_index").orderBy("start_offset")
        gap = F.abs(F.col("start_offset") - F.coalesce(F.lag("end_offset").over(along), F.lit(0.0)))
        held = lixels.select("edge_index", "lixel_id", "end_offset", gap.alias("gap"), (F.col("end_offset") <= F.col("start_offset")).alias("empty"))
        held = held.groupBy("edge_index").agg(F.max("gap").alias("gap"), F.max("end_offset").alias("end"), F.count_if("empty").alias("empty"), F.count(F.lit(1)).alias("n"))
        tol = F.greatest(F.lit(1e-9), F.col("length") * 1e-12)
        rows = self.edges.select("edge_index", "length").join(held, "edge_index", "full")
        row = rows.agg(
            F.count_if(F.col("n").isNull()).alias("bare"), F.count_if(F.col("length").isNull()).alias("unknown"),
            F.count_if((F.col("gap") > tol) | (F.abs(F.col("end") - F.col("length")) > tol) | (F.col("empty") > 0)).alias("broken"),
        ).first()
        found = [Issue("error", c, f"{row[c]} edges") for c in ("bare", "unknown", "broken") if row[c]]
        repeated = lixels.groupBy("lixel_id").count().where("count > 1").limit(1).count()
        return Report((*found, *([Issue("error", "duplicate_ids", "lixel ids repeat")] if repeated else [])))

    def fingerprint(self) -> str:
        """A hash of nodes, edges and direction."""
        return f"{fingerprint(self.nodes)}/{fingerprint(self.edges)}/{self.directed}"

    def summary(self) -> DataFrame:
        """One row: nodes, edges, total length, direction."""
        n = self.nodes.agg(F.count(F.lit(1)).alias("n_nodes"))
        return self.edges.agg(F.count(F.lit(1)).alias("n_edges"), F.sum("length").alias("total_length")).crossJoin(F.broadcast(n)).withColumn("directed", F.lit(self.directed))

    def lixels(self, target: float) -> DataFrame:
        """(lixel_id, edge_index, lixel, start_offset, end_offset, center_offset, length, center_x, center_y): edges cut into pieces of
        the target length, the last one shorter; ids are edge by edge."""
        if not (math.isfinite(target) and target > 0):
            raise ValueError("the lixel length is positive")
        n = F.greatest(F.lit(1), F.ceil(F.col("length") / target - 1e-9)).cast("int")
        # offsets of ids: a running sum over edges, by blocks so that no task orders all edges
        counted = self.edges.select("edge_index", "length", "geometry", n.alias("n"))
        block = F.floor(F.col("edge_index") / 4096).cast("long")
        blocks = counted.groupBy(block.alias("block")).agg(F.sum("n").alias("held"))
        starts = blocks.select("block", F.coalesce(F.sum("held").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
        inner = Window.partitionBy("block").orderBy("edge_index").rowsBetween(Window.unboundedPreceding, -1)
        rows = counted.withColumn("block", block).withColumn("ahead", F.coalesce(F.sum("n").over(inner), F.lit(0))).join(starts, "block")
        rows = rows.select("edge_index", F.col("length").alias("edge_length"), "geometry", (F.col("base") + F.col("ahead")).alias("first"), "n", F.posexplode(F.sequence(F.lit(0), F.col("n") - 1)).alias("lixel", "k"))
        start = F.col("lixel") * F.lit(float(target))
        end = F.when(F.col("lixel") == F.col("n") - 1, F.col("edge_length")).otherwise(start + target)
        rows = rows.withColumns({"start_offset": start, "end_offset": end}).withColumn("center_offset", (F.col("start_offset") + F.col("end_offset")) / 2)
        at = point_at(F.col("geometry"), F.col("center_offset") / F.col("edge_length"))
        return rows.select(
            (F.col("first") + F.col("lixel")).cast("long").alias("lixel_id"), "edge_index", "start_offset", "end_offset", "center_offset",
            (F.col("end_offset") - F.col("start_offset")).alias("length"), at["x"].alias("center_x"), at["y"].alias("center_y"),
        )

    def segments(self) -> DataFrame:
        """(edge_index, edge_length, drawn, before, ax, ay, bx, by): straight pieces of the geometries, with the drawn length before."""
        g = F.col("geometry")
        size = lambda i: F.hypot(F.get(g, i + 1)["x"] - F.get(g, i)["x"], F.get(g, i + 1)["y"] - F.get(g, i)["y"])
        upto = lambda n: F.aggregate(F.transform(F.sequence(F.lit(0), F.size(g) - 2), lambda i: F.when(i < n, size(i)).otherwise(0.0)), F.lit(0.0), lambda a, b: a + b)
        rows = self.edges.select("edge_index", F.col("length").alias("edge_length"), "geometry", F.explode(F.sequence(F.lit(0), F.size(g) - 2)).alias("i"))
        i = F.col("i")
        return rows.select(
            "edge_index", "edge_length", upto(F.size(g)).alias("drawn"), upto(i).alias("before"),
            F.get(g, i)["x"].alias("ax"), F.get(g, i)["y"].alias("ay"), F.get(g, i + 1)["x"].alias("bx"), F.get(g, i + 1)["y"].alias("by"),
        )


def point_at(geometry: Column, fraction: Column) -> Column:
    """The point of a polyline at a fraction of its length."""
    size = lambda i: F.hypot(F.get(geometry, i)["x"] - F.get(geometry, i - 1)["x"], F.get(geometry, i)["y"] - F.get(geometry, i - 1)["y"])
    steps = F.sequence(F.lit(1), F.size(geometry) - 1)
    total = F.aggregate(steps, F.lit(0.0), lambda a, i: a + size(i))
    start = F.struct(F.element_at(geometry, 1)["x"].alias("x"), F.element_at(geometry, 1)["y"].alias("y"), (total * fraction).alias("left"))

    def walk(acc, i):
        # zero once the point is reached; else what is left after this piece
        d = size(i)
        part = F.when(d > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), acc["left"] / d))).otherwise(0.0)
        a, b = F.get(geometry, i - 1), F.get(geometry, i)
        on = acc["left"] > 0
        return F.struct(
            F.when(on, a["x"] + part * (b["x"] - a["x"])).otherwise(acc["x"]).alias("x"),
            F.when(on, a["y"] + part * (b["y"] - a["y"])).otherwise(acc["y"]).alias("y"),
            F.when(on, acc["left"] - d).otherwise(acc["left"]).alias("left"),
        )

    return F.aggregate(steps, start, walk)


def _to_segments(pairs: DataFrame) -> DataFrame:
    """One row per event and edge with its nearest point m, the first along the edge among equals, from events paired with segments."""
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    square = dx * dx + dy * dy
    t = F.when(square > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((F.col("x") - F.col("ax")) * dx + (F.col("y") - F.col("ay")) * dy) / F.nullif(square, F.lit(0.0))))).otherwise(0.0)
    px, py = F.col("ax") + t * dx, F.col("ay") + t * dy
    near = pairs.select(
        "event_id", "x", "y", "weight", "edge_index", "edge_length", px.alias("px"), py.alias("py"), F.hypot(F.col("x") - px, F.col("y") - py).alias("d"),
        (F.when(F.col("drawn") > 0, (F.col("before") + t * F.sqrt(square)) / F.nullif(F.col("drawn"), F.lit(0.0))) * F.col("edge_length")).alias("offset"),
    )
    return near.groupBy("event_id", "x", "y", "weight", "edge_index").agg(F.min(F.struct("d", "offset", "px", "py", "edge_length")).alias("m"))


def snap(network: Network, events: Events, max_distance: float | None = None, tie_tolerance: float = 1e-9, endpoint_tolerance: float = 1e-9) -> DataFrame:
    """Every event with its nearest edge: event_id, x, y, weight, edge_index, offset, snapped_x, snapped_y, snap_distance, candidates,
    status. Of edges within the tie tolerance the lowest index wins. Status, in this precedence: beyond_max_distance (rejected),
    snapped_to_u, snapped_to_v, ambiguous_nearest, snapped.

    Segments are keyed by the cells they touch, and only neighbouring cells are compared. The search starts with the maximal distance, or
    with the mean length of a segment, and doubles for events that have found none yet, so that rejected ones know their nearest
    edge as well.
    """
    events.check().raise_for_errors()
    events.require_ids()
    pts = events.df.select("event_id", F.col(events.coords[0]).alias("x"), F.col(events.coords[1]).alias("y"), "weight")
    segs = cut(network.segments())
    longest, middle = F.greatest(F.abs(F.col("ax") - F.col("bx")), F.abs(F.col("ay") - F.col("by"))), F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by"))
    corners = [f(g).alias(n) for n, f, g in (("x0", F.min, F.least("ax", "bx")), ("x1", F.max, F.greatest("ax", "bx")), ("y0", F.min, F.least("ay", "by")), ("y1", F.max, F.greatest("ay", "by")))]
    s = segs.agg(F.max(longest).alias("longest"), F.avg(middle).alias("mean"), F.count_if(bad(middle)).alias("bad"), *corners).first()
    if s["longest"] is None or s["bad"]:
        raise ValueError("the network has no edges, or coordinates that are not finite")
    e = pts.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).first()
    across = math.hypot(max(s["x1"], e["x1"]) - min(s["x0"], e["x0"]), max(s["y1"], e["y1"]) - min(s["y0"], e["y0"]))
    reach = float(max_distance) if max_distance is not None else s["mean"]
    reach, pending, parts = max(reach, across * 1e-6, 1e-12), pts, []
    while True:
        width = max((reach + tie_tolerance) * (1 + 1e-9), s["longest"] / 16)  # ties lie as far as the tolerance beyond; a segment touches few cells
        c = lambda v: F.floor(v / width).cast("long")  # noqa: B023, E731
        span = lambda a, b: F.explode(F.sequence(c(F.least(a, b)) - 1, c(F.greatest(a, b)) + 1))  # noqa: B023, E731
        keyed = segs.withColumn("cx", span(F.col("ax"), F.col("bx"))).withColumn("cy", span(F.col("ay"), F.col("by")))
        pairs = pending.withColumn("cx", c(F.col("x"))).withColumn("cy", c(F.col("y"))).join(keyed, ["cx", "cy"])
        per_edge = _to_segments(pairs)
        low = F.min("m.d").over(Window.partitionBy("event_id"))  # a handful of near edges per event
        found = cut(per_edge.withColumn("low", low).where((F.col("low") <= reach) & (F.col("m.d") - F.col("low") <= tie_tolerance)))
        parts.append(found)
        pending = cut(pending.join(found.select("event_id").distinct(), "event_id", "left_anti"))
        if reach > across or not pending.limit(1).count():
            break
        reach *= 2
    tied = functools.reduce(DataFrame.union, parts)
    best = tied.groupBy("event_id", "x", "y", "weight").agg(F.min_by("m", "edge_index").alias("m"), F.min("edge_index").alias("edge_index"), F.count("edge_index").alias("candidates"), F.min("low").alias("snap_distance"))
    off, length = F.col("m.offset"), F.col("m.edge_length")
    at_u, at_v = off <= endpoint_tolerance, length - off <= endpoint_tolerance
    gone = F.col("snap_distance") > max_distance if max_distance is not None else F.lit(False)
    status = (
        F.when(gone, "beyond_max_distance").when(at_u, "snapped_to_u").when(at_v, "snapped_to_v").when(F.col("candidates") > 1, "ambiguous_nearest").otherwise("snapped")
    )
    return best.select(
        "event_id", "x", "y", "weight", "edge_index", F.when(at_u, 0.0).when(at_v, length).otherwise(off).alias("offset"),
        F.col("m.px").alias("snapped_x"), F.col("m.py").alias("snapped_y"), "snap_distance", "candidates", status.alias("status"),
    )


def accepted(snapped: DataFrame) -> DataFrame:
    return snapped.where("status <> 'beyond_max_distance'")


def rejected(snapped: DataFrame) -> DataFrame:
    return snapped.where("status = 'beyond_max_distance'").select(
        "event_id", "x", "y", "weight", F.col("status").alias("reason"), F.col("snap_distance").alias("nearest_distance"), F.col("candidates").alias("candidate_count")
    )


def arixels(lixels: DataFrame, cells: DataFrame, n_lixels: int) -> DataFrame:
    """Lixels times time cells (time_index, time, time_width), time slowest: arixel_id, measure = length * width."""
    return cells.crossJoin(lixels).select(
        (F.col("time_index") * n_lixels + F.col("lixel_id")).alias("arixel_id"), *lixels.columns, "time", "time_width", (F.col("length") * F.col("time_width")).alias("arixel_measure")
    )
