"""Distances, traversal, propagation and kernel fields on linear networks, as joins that advance a frontier."""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.functions.kernels import Kernel, get_kernel
from fieldloom.functions.time import TimeDomain, images, temporal_kernel
from fieldloom.operators.bandwidths import positive
from fieldloom.operators.spatial import get_target
from fieldloom.plans.lineage import cut
from fieldloom.plans.lines import tiled
from fieldloom.plans.pairs import _dealt, small
from fieldloom.sources.network import Network
from fieldloom.sources.planar import Issue, Report, bad

EPS = 1e-12
MOST_CELLS = 32  # time cells whose shares ride along with an event


def node_distances(network: Network, starts: DataFrame, cutoff: float | str | None, *, weight: str = "length", directed: bool | None = None) -> DataFrame:
    """(source, node, distance) from starts (source, node, distance): shortest paths up to the cutoff, which is a number or, for starts with a
    column cutoff, that of each source ("cutoff").

    A frontier of improved nodes is joined with the adjacency, the least distance of each (source, node) is kept, and only
    improvements go on. The work is that of the nodes within reach, for all sources at once.
    """
    adjacency = cut(network.adjacency(directed, weight))
    own = isinstance(cutoff, str)
    reach = cut(starts.groupBy("source").agg(F.max("cutoff").alias("cutoff"))) if own else None
    known = cut(starts.groupBy("source", "node").agg(F.min("distance").alias("distance")))
    frontier = known
    while True:
        step = frontier.join(adjacency, F.col("node") == F.col("from_node")).select("source", F.col("to_node").alias("node"), (F.col("distance") + F.col("weight")).alias("new"))
        if own:
            step = step.join(reach, "source").where(F.col("new") <= F.col("cutoff") + EPS)
        elif cutoff is not None:
            step = step.where(F.col("new") <= cutoff + EPS)
        step = step.groupBy("source", "node").agg(F.min("new").alias("new"))
        better = step.join(known, ["source", "node"], "left").where(F.col("distance").isNull() | (F.col("new") < F.col("distance") - EPS))
        frontier = cut(better.select("source", "node", F.col("new").alias("distance")))
        if not frontier.limit(1).count():
            return known
        known = cut(known.union(frontier).groupBy("source", "node").agg(F.min("distance").alias("distance")))


def _edge_ways(network: Network, used: DataFrame, wanted: DataFrame, cutoff: float | str | None, weight: str, directed: bool | None) -> DataFrame:
    """(es, et, uu, uv, vu, vv): distances between the ends of edges that hold sources (es [, cutoff]) and of edges that hold targets (et). The
    search starts once at each end of an edge, however many sources lie on it."""
    e = network.edges.select("edge_index", "u", "v")
    ends = used.join(e, F.col("es") == F.col("edge_index")).drop("edge_index")
    starts = ends.select(F.explode(F.array("u", "v")).alias("node"), *(["cutoff"] if cutoff == "cutoff" else []))
    starts = starts.groupBy("node").agg(F.max("cutoff").alias("cutoff")) if cutoff == "cutoff" else starts.distinct()
    starts = starts.withColumn("source", F.col("node")).withColumn("distance", F.lit(0.0))
    reach = node_distances(network, starts, cutoff, weight=weight, directed=directed).select(F.col("source").alias("from"), "node", "distance")
    leave = ends.select("es", F.explode(F.array(F.struct(F.lit("u").alias("out"), F.col("u").alias("from")), F.struct(F.lit("v").alias("out"), F.col("v").alias("from")))).alias("w")).select("es", "w.*")
    arrive = wanted.join(e, F.col("et") == F.col("edge_index"))
    arrive = arrive.select("et", F.explode(F.array(F.struct(F.lit("u").alias("in"), F.col("u").alias("node")), F.struct(F.lit("v").alias("in"), F.col("v").alias("node")))).alias("w")).select("et", "w.*")
    pairs = leave.join(reach, "from").join(arrive, "node")
    one = lambda x, y: F.min(F.when((F.col("out") == x) & (F.col("in") == y), F.col("distance"))).alias(x + y)
    return cut(pairs.groupBy("es", "et").agg(*[one(x, y) for x in "uv" for y in "uv"]))


def edge_ways(network: Network, sources: DataFrame, targets: DataFrame, cutoff: float, directed: bool | None = None) -> DataFrame:
    """What location_distances searches: distances between the ends of the edges that hold sources and targets, of the size of the network."""
    used, wanted = (cut(df.select(F.col("edge_index").alias(n)).distinct()) for df, n in ((sources, "es"), (targets, "et")))
    return _edge_ways(network, used, wanted, cutoff, "length", directed)


def _shared_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """left and right joined on keys: left is sent to every task if it is small, else crowded keys are dealt."""
    left = cut(left)
    if small(left):
        return right.join(F.broadcast(left), keys)
    return _dealt(left, right, keys, left.groupBy(*keys).agg(F.count(F.lit(1)).alias("__l")), [])


def location_distances(
    network: Network, sources: DataFrame, targets: DataFrame, cutoff: float | str | None, *, weight: str = "length", directed: bool | None = None, carry: Sequence[str] = (), ways: DataFrame | None = None
) -> DataFrame:
    """(source, target, distance, carried columns of the sources) between places (id columns source / target, each id once, edge_index,
    offset); pairs beyond the cutoff or out of reach are missing. The cutoff is a number, or "cutoff" for sources with a column of that name.

    Distances are searched between the ends of edges, once for each edge; places are then met by their edges, and the least of their up to five
    ways is taken in the row of the pair: no row is made for a pair and a way, and no pair is shuffled. ways are those of edge_ways, if they are there."""
    one_way, own = network.is_directed(directed), cutoff == "cutoff"
    e = network.edges.select("edge_index", F.col("length").alias("edge_length"), F.col(weight).alias("total"))
    tol = F.greatest(F.lit(EPS), F.col("total") * EPS)

    def placed(df: DataFrame, key: str, edge: str, at: str, by_u: str, by_v: str, leaving: bool, more: Sequence[str]) -> DataFrame:
        rows = df.select(key, "edge_index", "offset", *more).join(F.broadcast(e) if small(e) else e, "edge_index")
        rows = rows.withColumn(at, F.col("offset") / F.col("edge_length") * F.col("total"))
        p, rest = F.col(at), F.col("total") - F.col(at)
        p, rest = F.when(p <= tol, 0.0).otherwise(p), F.when(rest <= tol, 0.0).otherwise(rest)
        if one_way:  # sources go on to v, targets are come to from u
            p, rest = (F.when(p == 0, p), rest) if leaving else (p, F.when(rest == 0, rest))
        return rows.select(key, F.col("edge_index").alias(edge), at, p.alias(by_u), rest.alias(by_v), *more)

    s = placed(sources, "source", "es", "p", "a", "b", True, [*(["cutoff"] if own else []), *carry])
    t = placed(targets, "target", "et", "q", "c", "d", False, [])
    used = s.groupBy("es").agg(F.max("cutoff").alias("cutoff")) if own else s.select("es").distinct()
    ways = _edge_ways(network, cut(used), cut(t.select("et").distinct()), cutoff, weight, directed) if ways is None else ways
    through = F.least(*[F.col(x) + F.col(x2 + y2) + F.col(y) for x, x2 in (("a", "u"), ("b", "v")) for y, y2 in (("c", "u"), ("d", "v"))])
    straight = F.when(F.col("q") >= F.col("p"), F.col("q") - F.col("p")) if one_way else F.abs(F.col("q") - F.col("p"))
    out = ["source", "target", "distance", *carry]
    if cutoff is None:
        met = _shared_join(ways.join(t, "et"), s, ["es"])
        found = met.withColumn("distance", F.when(F.col("es") == F.col("et"), F.least(through, straight)).otherwise(through))
        lone = t.join(ways.select("et", "es").where("es = et").select("et"), "et", "left_anti")  # an edge that does not lead back to itself
        same = _shared_join(lone.withColumnRenamed("et", "es"), s, ["es"]).withColumn("distance", straight)
        return found.select(*out).union(same.select(*out)).where("distance is not null")
    s = s if own else s.withColumn("cutoff", F.lit(float(cutoff)))
    limit = F.col("cutoff") + EPS
    # along one edge: bins as wide as the cutoff, or as the next power of two of each source's
    s = s.withColumn("grade", F.ceil(F.log2(F.greatest(F.col("cutoff"), F.lit(1e-300)))).cast("int"))
    grades = [r["grade"] for r in s.select("grade").distinct().collect()]  # at most some 2,000 powers of two
    bin_of = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("grade"))).cast("long")
    near_t = t.withColumn("grade", F.explode(F.array(*[F.lit(g) for g in grades]) if grades else F.array().cast("array<int>")))
    near_t = near_t.withColumn("bin", F.explode(F.array(bin_of("q") - 1, bin_of("q"), bin_of("q") + 1)))
    own_ways = ways.where("es = et").drop("es")
    near_t = near_t.join(F.broadcast(own_ways) if small(own_ways) else own_ways, "et", "left").withColumnRenamed("et", "es")
    same = _shared_join(near_t, s.withColumn("bin", bin_of("p")), ["es", "grade", "bin"]).withColumn("distance", F.least(through, straight))
    # by the ends: only places within the cutoff of an end of their edge
    top = F.lit(float(cutoff)) if not own else F.lit(float(s.agg(F.max("cutoff").alias("c")).first()["c"] or 0.0))
    least_way = F.least(*[F.col(w) for w in ("uu", "uv", "vu", "vv")])
    ended = ways.join(t, "et").where(F.least("c", "d") + least_way <= top + EPS)
    met = _shared_join(ended, s.where(F.least("a", "b") <= limit), ["es"])
    met = met.where((F.col("es") != F.col("et")) | (F.abs(bin_of("p") - bin_of("q")) > 1)).withColumn("distance", through)
    return same.where(F.col("distance") <= limit).select(*out).union(met.where(F.col("distance") <= limit).select(*out))


def traversal(network: Network, node: str, cutoff: float, *, weight: str = "length", directed: bool | None = None) -> DataFrame:
    """Oriented edges reached from a node: start and end distance and the share of the edge within the cutoff."""
    start = network.edges.sparkSession.createDataFrame([(0, node, 0.0)], "source int, node string, distance double")
    d = node_distances(network, start, cutoff, weight=weight, directed=directed)
    rows = network.oriented(directed, weight).join(d, F.col("from_node") == F.col("node")).where(F.col("distance") < cutoff)
    end = F.least(F.col("distance") + F.col("weight"), F.lit(float(cutoff)))
    return rows.select(
        "edge_index", "from_node", "to_node", (F.col("direction") < 0).alias("reversed"), F.col("distance").alias("start_distance"), end.alias("end_distance"),
        ((end - F.col("distance")) / F.col("weight")).alias("reached_fraction"),
    )


def tiles(network: Network, events: DataFrame, targets: DataFrame | None, reach: float) -> tuple[DataFrame, int]:
    """Events (event_id, edge_index, offset, weight [, time]) and targets (target, edge_index, offset; None: the events) in tiles of the edges of an
    undirected network, for kernel sums along shortest paths up to the reach."""
    e = network.edges.select("edge_index", F.col("length").alias("length"))
    e = F.broadcast(e) if small(e) else e
    time = F.col("time").cast("double") if "time" in events.columns else F.lit(None).cast("double")
    p, rest = F.col("offset"), F.col("length") - F.col("offset")
    s = events.select(F.col("event_id").alias("source"), "edge_index", "offset", F.col("weight").cast("double").alias("w"), time.alias("time")).join(e, "edge_index")
    s = s.select("source", F.col("edge_index").alias("es"), p.alias("p"), p.alias("a"), rest.alias("b"), "length", "w", "time")
    t = targets.join(e, "edge_index").select("target", F.col("edge_index").alias("et"), p.alias("q"), "length") if targets is not None else None
    used = cut(s.select("es").distinct())
    ways = _edge_ways(network, used, cut(t.select("et").distinct()) if t is not None else used.select(F.col("es").alias("et")), reach, "length", False)
    return tiled(s, t, ways, reach)


@dataclass(frozen=True)
class JunctionPolicy:
    """How a coefficient splits at a node of n branches: multipliers, as columns of n, for the other branches, for the way back, and for
    a source on the node. A policy that follows paths needs a kernel with reach; the simple one takes shortest paths instead."""

    name: str
    forward: Callable[[Column], Column]
    back: Callable[[Column], Column] = lambda n: F.lit(0.0)
    start: Callable[[Column], Column] = lambda n: 2.0 / n
    undirected_only: bool = False
    path_based: bool = True


POLICIES = {
    p.name: p
    for p in (
        JunctionPolicy("simple", lambda n: F.lit(1.0), start=lambda n: F.lit(1.0), path_based=False),
        JunctionPolicy("discontinuous", lambda n: F.when(n > 1, 1.0 / F.greatest(n - 1, F.lit(1))).otherwise(0.0)),
        JunctionPolicy("continuous", lambda n: 2.0 / n, lambda n: 2.0 / n - 1.0, undirected_only=True),
    )
}


def get_policy(policy: str | JunctionPolicy) -> JunctionPolicy:
    found = policy if isinstance(policy, JunctionPolicy) else POLICIES.get(str(policy).strip().lower())
    if found is None:
        raise ValueError(f"unknown junction policy {policy!r}; one of {sorted(POLICIES)}")
    return found


def propagate(
    network: Network,
    sources: DataFrame,
    cutoff: float | None = None,
    *,
    policy: str | JunctionPolicy = "discontinuous",
    directed: bool | None = None,
    tolerance: float = 1e-12,
    max_records: int = 100_000,
    merged: bool = True,
    entering: bool = False,
) -> DataFrame:
    """Signed stretches of edges reached from each source (source, edge_index, offset [, cutoff]): source, edge_index, direction,
    start_offset, end_offset, start_distance, end_distance, coefficient, depth, include_start.

    One level of junctions per round, for all sources together. Whatever follows is linear in the coefficient, so paths that enter an
    edge the same way at the same level and distance (within 1e-11 of the cutoff) go on as one stretch with the sum of their
    coefficients: their number follows the different distances and not the paths, which double at every junction. Distances that are
    parted by the border of that tolerance stay apart, which costs a row and changes nothing. A stretch whose coefficient is
    below the tolerance, after adding up, ends. A source with more than max_records stretches fails the job. merged=False gives a
    stretch for each path. entering: sources (source, edge_index, direction, length, cutoff) stand at the end of an edge, having come along it.
    """
    rule, one_way = get_policy(policy), network.is_directed(directed)
    if one_way and rule.undirected_only:
        raise ValueError(f"the {rule.name} policy needs an undirected network")
    oriented = network.oriented(directed).select("edge_index", "direction", "from_node", "to_node", "length")
    degree = oriented.groupBy("from_node").agg(F.count(F.lit(1)).alias("degree"))
    branches = cut(oriented.join(degree, "from_node"))
    if entering:
        ends = branches.select("edge_index", "direction", "to_node", F.when(F.col("direction") > 0, F.col("length")).otherwise(0.0).alias("start_offset"))
        state = sources.join(ends, ["edge_index", "direction"]).select("source", "cutoff", "edge_index", "direction", "to_node", "length", "start_offset", F.lit(0.0).alias("start_distance"), F.lit(1.0).alias("coefficient"), F.lit(True).alias("include_start"), F.lit(0).alias("depth"))
        return _onward(cut(state), branches, rule, tolerance, max_records, merged)
    rows = sources.withColumn("cutoff", F.lit(float(cutoff))) if cutoff is not None else sources
    at = rows.select("source", "edge_index", "offset", "cutoff").join(network.edges.select("edge_index", "u", "v", "length"), "edge_index")
    tol = F.greatest(F.lit(EPS), F.col("length") * EPS)
    node = F.when(F.col("offset") <= tol, F.col("u")).when(F.col("length") - F.col("offset") <= tol, F.col("v"))
    at = at.withColumn("node", node)
    on_node = at.where("node is not null").select("source", "cutoff", "node")
    start_offset = F.when(F.col("direction") > 0, F.lit(0.0)).otherwise(F.col("length"))
    first = on_node.join(branches, F.col("node") == F.col("from_node")).select(
        "source", "cutoff", "edge_index", "direction", "to_node", "length", start_offset.alias("start_offset"), F.lit(0.0).alias("start_distance"),
        rule.start(F.col("degree")).alias("coefficient"), F.lit(True).alias("include_start"),
    )
    ways = F.array(F.lit(1)) if one_way else F.array(F.lit(1), F.lit(-1))
    inner = at.where("node is null").withColumn("direction", F.explode(ways))
    second = inner.select(
        "source", "cutoff", "edge_index", "direction", F.when(F.col("direction") > 0, F.col("v")).otherwise(F.col("u")).alias("to_node"), "length",
        F.col("offset").alias("start_offset"), F.lit(0.0).alias("start_distance"), F.lit(1.0).alias("coefficient"), (F.col("direction") > 0).alias("include_start"),
    )
    return _onward(cut(first.union(second).withColumn("depth", F.lit(0)).where(F.abs("coefficient") >= tolerance)), branches, rule, tolerance, max_records, merged)


def _onward(state: DataFrame, branches: DataFrame, rule: JunctionPolicy, tolerance: float, max_records: int, merged: bool) -> DataFrame:
    """The stretches that follow from the first ones."""
    start_offset = F.when(F.col("direction") > 0, F.lit(0.0)).otherwise(F.col("length"))
    fuzz = F.greatest(F.lit(EPS), F.col("cutoff") * EPS)
    full = F.when(F.col("direction") > 0, F.col("length") - F.col("start_offset")).otherwise(F.col("start_offset"))
    reached = F.least(full, F.greatest(F.lit(0.0), F.col("cutoff") - F.col("start_distance")))
    parts = []
    counts = None
    while True:
        kept = state.where((reached > fuzz) | ((F.col("depth") == 0) & F.col("include_start"))).select(
            "source", "edge_index", "direction", "start_offset", (F.col("start_offset") + F.col("direction") * reached).alias("end_offset"), "start_distance",
            (F.col("start_distance") + reached).alias("end_distance"), "coefficient", "depth", "include_start",
        )
        parts.append(kept)
        n = kept.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
        counts = n if counts is None else counts.union(n).groupBy("source").agg(F.sum("n").alias("n"))
        counts = cut(counts)
        if counts.where(F.col("n") > max_records).limit(1).count():
            raise RuntimeError("propagation exceeds max_records; reduce the bandwidth or raise the limit")
        arrival = F.col("start_distance") + full
        at_end = state.where((reached + fuzz >= full) & (arrival < F.col("cutoff") - fuzz)).select(
            "source", "cutoff", F.col("edge_index").alias("came_by"), F.col("direction").alias("came_in"), "to_node", arrival.alias("start_distance"), "coefficient", "depth"
        )
        back = (F.col("edge_index") == F.col("came_by")) & (F.col("direction") == -F.col("came_in"))
        share = F.when(back, rule.back(F.col("degree"))).otherwise(rule.forward(F.col("degree")))
        same = F.round(F.col("start_distance") / (F.col("cutoff") * 1e-11)).cast("long")
        b = branches.select("edge_index", "direction", "from_node", F.col("to_node").alias("next_node"), "length", "degree")
        onward = at_end.join(b, F.col("to_node") == F.col("from_node")).withColumn("coefficient", F.col("coefficient") * share)
        if merged:
            key = "source", "cutoff", "edge_index", "direction", "next_node", "length", "depth", same.alias("same")
            onward = onward.groupBy(*key).agg(F.min("start_distance").alias("start_distance"), F.sum("coefficient").alias("coefficient"))
        state = cut(
            onward.where(F.abs("coefficient") >= tolerance).select(
                "source", "cutoff", "edge_index", "direction", F.col("next_node").alias("to_node"), "length", start_offset.alias("start_offset"), "start_distance",
                "coefficient", F.lit(True).alias("include_start"), (F.col("depth") + 1).alias("depth"),
            )
        )
        if not state.limit(1).count():
            break
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def _entered(network: Network, sources: DataFrame, rule: JunctionPolicy, directed: bool | None) -> DataFrame:
    """(source, edge_index, direction, start_offset, include_start, coefficient, carried columns): the first stretches of sources (source, edge_index, offset, ...),
    along their own edge or, on a node, along each of its edges."""
    oriented = network.oriented(directed).select("edge_index", "direction", "from_node", "length")
    degree = oriented.groupBy("from_node").agg(F.count(F.lit(1)).alias("degree"))
    branches = cut(oriented.join(degree, "from_node"))
    e = network.edges.select("edge_index", "u", "v", "length")
    at = sources.join(F.broadcast(e) if small(e) else e, "edge_index")
    tol = F.greatest(F.lit(EPS), F.col("length") * EPS)
    at = at.withColumn("node", F.when(F.col("offset") <= tol, F.col("u")).when(F.col("length") - F.col("offset") <= tol, F.col("v")))
    carried = [c for c in sources.columns if c not in ("edge_index", "offset")]
    begin = F.when(F.col("direction") > 0, F.lit(0.0)).otherwise(F.col("length"))
    ways = F.array(F.lit(1)) if network.is_directed(directed) else F.array(F.lit(1), F.lit(-1))
    inner = at.where("node is null").withColumn("direction", F.explode(ways))
    inner = inner.select(*carried, "edge_index", "direction", F.col("offset").alias("start_offset"), (F.col("direction") > 0).alias("include_start"), F.lit(1.0).alias("coefficient"))
    on_node = at.where("node is not null").select(*carried, F.col("node").alias("from_node")).join(F.broadcast(branches) if small(branches) else branches, "from_node")
    return inner.union(on_node.select(*carried, "edge_index", "direction", begin.alias("start_offset"), F.lit(True).alias("include_start"), rule.start(F.col("degree")).alias("coefficient")))


def entry_kernels(network: Network, sources: DataFrame, targets: DataFrame, kernel: Kernel, rule: JunctionPolicy, directed: bool | None, tolerance: float, max_records: int) -> DataFrame:
    """(target, k, carried columns of the sources), signed parts of kernel values of sources (source, edge_index, offset, h, ...), in rows that are not yet
    added up.

    Beyond its own edge, all that a source does follows from how it enters that edge's end: paths are followed once for each edge and direction, from
    its beginning, and sources start somewhere along. Neither stretches nor pairs are stored or shuffled for a source."""
    first = _entered(network, sources, rule, directed)
    top = first.agg(F.max(F.col("h") * kernel.reach).alias("c")).first()["c"] or 0.0
    e = network.edges.select("edge_index", "length")
    roads = cut(first.groupBy("edge_index", "direction").agg(F.max(F.col("h") * kernel.reach).alias("cutoff")).join(e, "edge_index"))
    # a path from just behind the beginning of each edge: what lies on later edges is as far from its end as from the source's own way out
    stretches = propagate(network, roads.select(F.struct("edge_index", "direction").alias("source"), "edge_index", "direction", "length", "cutoff"), policy=rule, directed=directed, tolerance=tolerance, max_records=max_records, entering=True)
    hit = cut(stretches.where("depth > 0")).select(F.col("source.edge_index").alias("own"), F.col("source.direction").alias("way"), "edge_index", "direction", "start_offset", "end_offset", "start_distance", F.col("coefficient").alias("share"))
    tol = F.lit(EPS) * F.greatest(F.lit(1.0), F.lit(float(top)))
    low, high = F.least("start_offset", "end_offset") - tol, F.greatest("start_offset", "end_offset") + tol
    places = targets.select("target", "edge_index", "offset")
    hit = hit.join(places, "edge_index").where(F.col("offset").between(low, high))
    hit = hit.groupBy("own", "way", "target", (F.col("start_distance") + F.abs(F.col("offset") - F.col("start_offset"))).alias("beyond")).agg(F.sum("share").alias("share"))
    hit = cut(hit.select(F.col("own").alias("edge_index"), F.col("way").alias("direction"), "target", "beyond", "share"))
    fuzz = F.greatest(F.lit(EPS), F.col("h") * EPS)
    value = lambda d, share: F.when(d <= F.col("h") * kernel.reach + fuzz, share * kernel.scaled(F.least(d, F.col("h") * kernel.reach), F.col("h"), 1)).otherwise(0.0)
    carried = [c for c in sources.columns if c not in ("source", "edge_index", "offset", "h")]
    rest = F.when(F.col("direction") > 0, F.col("length") - F.col("start_offset")).otherwise(F.col("start_offset"))
    out = first.join(F.broadcast(e) if small(e) else e, "edge_index").withColumn("rest", rest)
    far = _shared_join(hit, out, ["edge_index", "direction"])
    far = far.where(F.col("rest") < F.col("h") * kernel.reach - fuzz).select("target", value(F.col("rest") + F.col("beyond"), F.col("coefficient") * F.col("share")).alias("k"), *carried)
    near = _shared_join(places, first, ["edge_index"])
    gap = (F.col("offset") - F.col("start_offset")) * F.col("direction")
    near = near.where((gap >= -fuzz) & (F.col("include_start") | (F.abs(gap) > fuzz))).select("target", value(F.abs(gap), F.col("coefficient")).alias("k"), *carried)
    return far.union(near).where("k <> 0")


def kernel_from_distances(distances: DataFrame, kernel: Kernel, h: Column, carry: Sequence[str] = ()) -> DataFrame:
    """(source, target, k, carried columns) from (source, target, distance [, h], carried columns)."""
    return distances.select("source", "target", kernel.scaled(F.col("distance"), h, 1).alias("k"), *carry)


def kernel_from_stretches(stretches: DataFrame, targets: DataFrame, kernel: Kernel, h: Column) -> DataFrame:
    """(source, target, k): places (target, edge_index, offset) on the stretches (with h) of each source; signs add up."""
    tol = F.greatest(F.lit(EPS), h * EPS)
    low, high = F.least("start_offset", "end_offset") - tol, F.greatest("start_offset", "end_offset") + tol
    hit = stretches.join(targets.select("target", "edge_index", "offset"), "edge_index").where(
        F.col("offset").between(low, high) & (F.col("include_start") | (F.abs(F.col("offset") - F.col("start_offset")) > tol))
    )
    d = F.col("start_distance") + F.abs(F.col("offset") - F.col("start_offset"))
    value = F.when(d <= h + tol, F.col("coefficient") * kernel.scaled(F.least(d, h), h, 1)).otherwise(0.0)
    return hit.groupBy("source", "target").agg(F.sum(value).alias("k"))


def _ranked(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """df with rank, from 0 on, in the order of these columns, which tell rows apart: parts by ranges, and a count of each part."""
    ordered = cut(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    base, rows = 0, []
    for r in ordered.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).orderBy("__part").collect():  # one row a partition
        rows.append((r["__part"], base))
        base += r["n"]
    bases = F.broadcast(df.sparkSession.createDataFrame(rows, "__part int, __base long"))
    within = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return ordered.join(bases, "__part").withColumn("rank", F.col("__base") + within - 1).drop("__part", "__base")


def _beside(df: DataFrame, order: Sequence[str], k: int, held: Sequence[str]) -> DataFrame:
    """df with before and after: the held columns of the k rows before and after each in the order, in blocks of ranks that see their ends."""
    size = max(k, 100_000)
    rows = _ranked(df, order)
    at, place = F.floor(F.col("rank") / size), F.col("rank") % size
    blocks = F.array_compact(F.array(at, F.when(place < k, at - 1), F.when(place >= size - k, at + 1)))
    rows = rows.withColumn("__own", at).withColumn("__block", F.explode(blocks))
    along = Window.partitionBy("__block").orderBy("rank")
    near = lambda a, b: F.collect_list(F.struct(*held)).over(along.rowsBetween(a, b))
    rows = rows.withColumn("before", near(-k, -1)).withColumn("after", near(1, k))
    return rows.where("__own = __block").drop("__own", "__block", "rank")


def neighbour_distances(network: Network, places: DataFrame, k: int, n: int, total: float, cutoff: float | None, directed: bool | None) -> DataFrame:
    """(source, distance) from each place (source, edge_index, offset) to its k-th nearest other one; those with fewer within the cutoff are
    missing.

    On its own edge a place looks at the k before and the k after. All others are come to by an end of the edge, and of these the k + 1 nearest
    to a node (one may be the place itself) serve every place that leaves by it. No pairs are made; nodes search in rounds of a growing reach."""
    one_way = network.is_directed(directed)
    e = network.edges.select("edge_index", "u", "v", "length")
    tol = F.greatest(F.lit(EPS), F.col("length") * EPS)
    s = places.select("source", "edge_index", "offset").join(F.broadcast(e) if small(e) else e, "edge_index")
    p, rest = F.col("offset"), F.col("length") - F.col("offset")
    p, rest = F.when(p <= tol, 0.0).otherwise(p), F.when(rest <= tol, 0.0).otherwise(rest)
    zero = lambda c: F.when(c == 0, c) if one_way else c
    s = s.select("source", "edge_index", F.col("offset").alias("p"), "u", "v", zero(p).alias("a"), rest.alias("b"), p.alias("c"), zero(rest).alias("d"))
    pending = cut(_beside(s, ["edge_index", "p", "source"], k, ["edge_index", "p", "source"]))
    # the nearest places on the edges at each node; a loop brings a place twice
    ends = pending.select("source", F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("c").alias("off")), F.struct(F.col("v").alias("node"), F.col("d").alias("off")))).alias("x"))
    ends = ends.select("x.node", "source", "x.off").where("off is not null")
    first = F.row_number().over(Window.partitionBy("node").orderBy("off", "source"))
    ends = ends.withColumn("place", first).where(F.col("place") <= 2 * (k + 1)).groupBy("node", "source").agg(F.min("off").alias("off"))
    ends = cut(ends)
    reach, parts = max(8 * total * k / n, 1e-12), []
    while True:
        last = reach >= (total if cutoff is None else cutoff)
        limit = cutoff if last else reach
        nodes = pending.select(F.explode(F.array("u", "v")).alias("node")).distinct()
        starts = nodes.select(F.col("node").alias("source"), "node", F.lit(0.0).alias("distance"))
        ways = node_distances(network, starts, limit, directed=directed).select(F.col("source").alias("from"), "node", "distance")
        met = ways.join(ends, "node").groupBy("from", "source").agg(F.min(F.col("distance") + F.col("off")).alias("way"))
        if limit is not None:
            met = met.where(F.col("way") <= limit + EPS)
        near = F.row_number().over(Window.partitionBy("from").orderBy("way", "source"))
        met = met.withColumn("place", near).where(F.col("place") <= k + 1)
        met = met.groupBy("from").agg(F.collect_list(F.struct("way", "source")).alias("others"))
        lists = cut(nodes.join(met, F.col("node") == F.col("from"), "left").select("node", "others"))
        rows = _shared_join(lists.select(F.col("node").alias("u"), F.col("others").alias("by_u")), pending, ["u"])
        rows = _shared_join(lists.select(F.col("node").alias("v"), F.col("others").alias("by_v")), rows, ["v"])
        gap = lambda x: x["p"] - F.col("p") if one_way else F.abs(x["p"] - F.col("p"))
        straight = F.transform(F.filter(F.concat("before", "after"), lambda x: (x["edge_index"] == F.col("edge_index")) & (gap(x) >= 0)), lambda x: F.struct(gap(x).alias("way"), x["source"].alias("source")))
        by = lambda c, leave: F.transform(F.coalesce(c, F.array()), lambda x: F.struct((F.col(leave) + x["way"]).alias("way"), x["source"].alias("source")))
        every = F.filter(F.concat(straight, by("by_u", "a"), by("by_v", "b")), lambda x: x["way"].isNotNull() & (x["source"] != F.col("source")))
        # in order of their ways; a place that is come to in several ways counts once, by the least
        rows = rows.withColumn("every", F.array_sort(every)).withColumn("names", F.transform("every", lambda x: x["source"]))
        kth = F.try_element_at(F.array_distinct("names"), F.lit(k))
        rows = rows.withColumn("kth", kth).withColumn("distance", F.try_element_at("every", F.array_position("names", F.col("kth")).cast("int"))["way"])
        rows = rows.where("distance is not null")
        found = cut((rows if limit is None else rows.where(F.col("distance") <= limit + EPS)).select("source", "distance"))
        parts.append(found)
        if last:
            break
        pending = cut(pending.join(found.select("source"), "source", "left_anti"))
        if not pending.limit(1).count():
            break
        reach *= 4
    return functools.reduce(DataFrame.union, parts)


@dataclass(frozen=True)
class NetworkKNNBandwidth:
    """Each event's network distance to its k-th nearest other event; too few in reach is an error."""

    k: int
    multiplier: float = 1.0
    minimum: float | None = None
    cutoff: float | None = None

    def resolve(self, network: Network, events: DataFrame, directed: bool | None = None) -> DataFrame:
        """(source, h) for events (event_id, edge_index, offset)."""
        events = cut(events)
        places = events.select(F.col("event_id").alias("source"), "edge_index", "offset")
        n, total = places.count(), network.edges.agg(F.sum("length").alias("t")).first()["t"] or 0.0
        if not 1 <= self.k <= n - 1:
            raise ValueError(f"k must be between 1 and {n - 1}")
        found = neighbour_distances(network, places, self.k, n, total, self.cutoff, directed)
        if found.count() < n:
            raise ValueError("some events have too few others in reach")
        h = F.col("distance") * self.multiplier
        if self.minimum is not None:
            h = F.greatest(h, F.lit(float(self.minimum)))
        out = cut(found.select("source", h.alias("h")))
        if out.where("h <= 0").limit(1).count():
            raise ValueError("some k-th distances are zero; set a minimum bandwidth")
        return out


@dataclass(frozen=True)
class NetworkKDE:
    """Density or intensity at lixel centres. Path policies need a kernel with reach; the simple policy takes shortest paths. The bandwidth
    is a number, the name of a column of the events, anything with resolve(network, events, directed) -> (source, h), or anything with
    select(network, events, lixels) -> Selection."""

    kernel: str | Kernel = "epanechnikov"
    bandwidth: object = 1.0
    policy: str = "discontinuous"
    target: str = "density"
    directed: bool | None = None
    tolerance: float = 1e-12
    max_records: int = 100_000

    def kernel_values(self, network: Network, events: DataFrame, lixels: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
        """(source, target, k) for events (event_id, edge_index, offset) and lixel centres; the simple policy also hands on the columns of the
        events that are to be carried."""
        kernel = get_kernel(self.kernel)
        sources = events.select(F.col("event_id").alias("source"), "edge_index", "offset", *carry)
        if hasattr(self.bandwidth, "resolve"):
            sources = sources.join(self.bandwidth.resolve(network, events, self.directed), "source")
        elif isinstance(self.bandwidth, str):
            sources = sources.join(events.select(F.col("event_id").alias("source"), F.col(self.bandwidth).alias("h")), "source")
        else:
            sources = sources.withColumn("h", F.lit(positive(self.bandwidth)))
        targets = lixels.select(F.col("lixel_id").alias("target"), "edge_index", F.col("center_offset").alias("offset"))
        if not get_policy(self.policy).path_based:
            if kernel.reach is None:
                d = location_distances(network, sources, targets, None, directed=self.directed, carry=["h", *carry])
            else:  # each source as far as its own bandwidth
                d = location_distances(network, sources.withColumn("cutoff", F.col("h") * kernel.reach), targets, "cutoff", directed=self.directed, carry=["h", *carry])
            return kernel_from_distances(d, kernel, F.col("h"), carry).where("k <> 0")
        if kernel.reach is None:
            raise ValueError("path policies need a kernel with reach")
        if carry:  # parts of sums, which nobody needs by source
            return entry_kernels(network, sources, targets, kernel, get_policy(self.policy), self.directed, self.tolerance, self.max_records)
        found = propagate(
            network, sources.withColumn("cutoff", F.col("h") * kernel.reach), policy=self.policy, directed=self.directed, tolerance=self.tolerance, max_records=self.max_records
        )
        return kernel_from_stretches(found.join(sources.select("source", "h"), "source"), targets, kernel, F.col("h"))

    def evaluate(self, network: Network, events: DataFrame, lixels: DataFrame) -> DataFrame:
        """lixels with density or intensity; events have event_id, edge_index, offset and weight."""
        events = cut(events)  # read several times; often the result of snapping
        require_events(network, events)
        if hasattr(self.bandwidth, "select") and not hasattr(self.bandwidth, "resolve"):
            chosen = self.bandwidth.select(network, events, lixels, kernel=self.kernel, policy=self.policy, directed=self.directed)
            return replace(self, bandwidth=chosen.bandwidth).evaluate(network, events, lixels)
        return self.field(events, lixels, self.kernel_values(network, events, lixels, ["weight"]))

    def field(self, events: DataFrame, lixels: DataFrame, values: DataFrame) -> DataFrame:
        """lixels with density or intensity from kernel values (source, target, k [, weight])."""
        target = get_target(self.target)
        total = (events.agg(F.sum("weight").alias("w")).first()["w"] or 0.0) if target == "density" else 1.0
        w = values if "weight" in values.columns else values.join(events.select(F.col("event_id").alias("source"), "weight"), "source")
        sums = w.withColumn("a", F.col("weight") / total).groupBy(F.col("target").alias("lixel_id")).agg(F.sum(F.col("a") * F.col("k")).alias("__f"))
        return lixels.join(sums, "lixel_id", "left").withColumn(target, F.greatest(F.lit(0.0), F.coalesce("__f", F.lit(0.0)))).drop("__f")


def require_events(network: Network, events: DataFrame) -> None:
    """Stop where events (event_id, edge_index, offset, weight) repeat an id, lie beyond their edge, name an unknown edge, or have weights
    that are negative, not finite, or all zero."""
    found = network.check_places(events, "event_id")
    w = events.agg(F.count_if(bad(F.col("weight")) | (F.col("weight") < 0)).alias("bad"), F.count_if(F.col("weight") > 0).alias("positive")).first() if "weight" in events.columns else None
    if w is not None and (w["bad"] or not w["positive"]):
        found = found.combine(Report((Issue("error", "weights", f"{w['bad']} weights are negative or not finite, {w['positive']} are positive"),)))
    found.raise_for_errors()


@dataclass(frozen=True)
class NetworkTimeBandwidths:
    """Spatial and temporal bandwidths: each a number or the name of a column of the events."""

    spatial: float | str
    temporal: float | str

    @property
    def adaptive(self) -> bool:
        return isinstance(self.spatial, str) or isinstance(self.temporal, str)

    def resolve(self, network: Network, events: DataFrame, domain: TimeDomain, directed: bool | None = None) -> DataFrame:
        """(source, h, ht)."""
        value = lambda v, n: F.col(v).cast("double") if isinstance(v, str) else F.lit(positive(v, n))
        out = events.select(F.col("event_id").alias("source"), value(self.spatial, "spatial bandwidth").alias("h"), value(self.temporal, "temporal bandwidth").alias("ht"))
        if out.where(bad(F.col("h")) | bad(F.col("ht")) | (F.col("h") <= 0) | (F.col("ht") <= 0)).limit(1).count():
            raise ValueError("bandwidths of events are positive and finite")
        return out


@dataclass(frozen=True)
class NetworkTimeKNNBandwidth:
    """Each event's network distance to its spatial_k-th, and its time to its temporal_k-th nearest other event; two ranks of their own."""

    spatial_k: int
    temporal_k: int
    spatial_multiplier: float = 1.0
    temporal_multiplier: float = 1.0
    minimum_spatial: float | None = None
    minimum_temporal: float | None = None
    cutoff: float | None = None  # how far spatial neighbours are looked for

    def resolve(self, network: Network, events: DataFrame, domain: TimeDomain, directed: bool | None = None) -> DataFrame:
        """(source, h, ht)."""
        events = cut(events)
        n = events.count()
        if not 1 <= self.spatial_k <= n - 1 or not 1 <= self.temporal_k <= n - 1:
            raise ValueError(f"k must be between 1 and {n - 1}")
        space = NetworkKNNBandwidth(self.spatial_k, self.spatial_multiplier, self.minimum_spatial, self.cutoff).resolve(network, events, directed)
        found = time_ranks(events, self.temporal_k, domain)
        ht = F.col("distance") * self.temporal_multiplier
        if self.minimum_temporal is not None:
            ht = F.greatest(ht, F.lit(float(self.minimum_temporal)))
        out = cut(space.join(found.select("source", ht.alias("ht")), "source"))
        if out.where("ht <= 0").limit(1).count():
            raise ValueError("some temporal k-th distances are zero; set a minimum")
        return out


def time_ranks(events: DataFrame, k: int, domain: TimeDomain) -> DataFrame:
    """(source, distance): time from each event to its k-th nearest other one. Events of one time count as one row; in order of time the k
    nearest are among the k times before and the k after. On a cycle the last k times are put before the first, and the first behind."""
    own = events.select(F.col("event_id").alias("source"), F.col("time").cast("double").alias("t"))
    if domain.period is not None:
        own = own.select("source", domain.canonical(F.col("t")).alias("t"))
    held = cut(own.groupBy("t").agg(F.count(F.lit(1)).alias("n")))
    rows = held.withColumn("mine", F.lit(True))
    if domain.period is not None:
        turned = lambda order, turn: held.orderBy(order).limit(k).select((F.col("t") + turn * domain.period).alias("t"), "n", F.lit(False).alias("mine"))
        rows = rows.union(turned(F.desc("t"), -1)).union(turned(F.col("t"), 1))
    rows = _beside(rows, ["t", "mine"], k, ["t", "n"]).where("mine")
    gaps = F.array_sort(F.transform(F.concat("before", "after"), lambda x: F.struct(F.abs(x["t"] - F.col("t")).alias("gap"), x["n"].alias("n"))))
    start = F.struct((F.lit(k) - (F.col("n") - 1)).cast("long").alias("left"), F.lit(0.0).alias("gap"))
    step = lambda acc, x: F.when(acc["left"] > 0, F.struct((acc["left"] - x["n"]).alias("left"), x["gap"].alias("gap"))).otherwise(acc)
    found = rows.select("t", F.aggregate(gaps, start, step)["gap"].alias("distance"))
    met = _shared_join(found, own, ["t"])
    return met.select("source", "distance" if domain.period is None else F.least("distance", F.lit(domain.period / 2)).alias("distance"))


@dataclass(frozen=True)
class TemporalNetworkKDE:
    """Network kernels times temporal kernels on lixels times time cells; the two factors meet only in the last sum. The temporal bandwidth
    is a number or the name of a column of the events; bandwidths, if given, sets both (NetworkTimeBandwidths or
    NetworkTimeKNNBandwidth)."""

    network_kde: NetworkKDE
    temporal_bandwidth: float | str | None
    domain: TimeDomain
    temporal_kernel: str | Kernel = "gaussian"
    target: str = "density"
    bandwidths: object = None

    def evaluate(self, network: Network, events: DataFrame, lixels: DataFrame, cells: DataFrame, *, values: DataFrame | None = None) -> DataFrame:
        """(lixel_id, time_index, time, density or intensity, measure); events also have time. values (source, target, k) are kernel values along
        the network that have been prepared."""
        events = cut(events)
        require_events(network, events)
        if events.where(bad(F.col("time").cast("double"))).limit(1).count():
            raise ValueError("some times are not finite")
        target, kde = get_target(self.target), self.network_kde
        total = (events.agg(F.sum("weight").alias("w")).first()["w"] or 0.0) if target == "density" else 1.0
        how = self.bandwidths
        if how is not None:
            found = how.resolve(network, events, self.domain, kde.directed).select(F.col("source").alias("event_id"), F.col("h").alias("__h"), F.col("ht").alias("__ht"))
            events, kde = cut(events.join(found, "event_id")), replace(kde, bandwidth="__h")
            ht = F.col("__ht")
        elif isinstance(self.temporal_bandwidth, str):
            events = events.withColumn("__ht", F.col(self.temporal_bandwidth).cast("double"))
            ht = F.col("__ht")
        else:
            ht = positive(self.temporal_bandwidth)
        most = None
        if isinstance(ht, Column):
            top = events.agg(F.max(ht).alias("top"), F.count_if(bad(ht) | (ht <= 0)).alias("bad")).first()
            if top["bad"]:
                raise ValueError("temporal bandwidths of events are positive and finite")
            most = images(get_kernel(self.temporal_kernel), top["top"], self.domain.period) if self.domain.period is not None else None
        extra = ["__ht"] if isinstance(ht, Column) else []
        own = events.select(F.col("event_id").alias("source"), (F.col("weight") / total).alias("a"), F.col("time").alias("s"), *extra)
        k = temporal_kernel(self.temporal_kernel, F.col("time") - F.col("s"), ht, self.domain, most=most)
        when = own.crossJoin(F.broadcast(cells)).select("source", "time_index", (F.col("a") * k).alias("b"))  # cells of one axis
        times = [r["time_index"] for r in cells.select("time_index").distinct().limit(MOST_CELLS + 1).collect()]
        if values is None and not get_policy(kde.policy).path_based and 0 < len(times) <= MOST_CELLS:
            # the shares of few time cells ride along with their event, so that no pair is joined again
            shares = when.groupBy(F.col("source").alias("event_id")).agg(F.map_from_entries(F.collect_list(F.struct("time_index", "b"))).alias("m"))
            shares = shares.select("event_id", F.array(*[F.coalesce(F.try_element_at("m", F.lit(i)), F.lit(0.0)) for i in times]).alias("__b"))
            space = kde.kernel_values(network, events.join(shares, "event_id"), lixels, ["__b"])
            wide = space.groupBy(F.col("target").alias("lixel_id")).agg(*[F.sum(F.col("k") * F.get("__b", F.lit(j))).alias(f"f{j}") for j in range(len(times))])
            sums = wide.select("lixel_id", F.explode(F.array(*[F.struct(F.lit(i).alias("time_index"), F.col(f"f{j}").alias("__f")) for j, i in enumerate(times)])).alias("r")).select("lixel_id", "r.*")
        else:
            space = (kde.kernel_values(network, events, lixels) if values is None else values).where("k <> 0")
            sums = space.join(when, "source").groupBy(F.col("target").alias("lixel_id"), "time_index").agg(F.sum(F.col("k") * F.col("b")).alias("__f"))
        grid = lixels.select("lixel_id", "length").crossJoin(F.broadcast(cells))
        out = grid.join(sums, ["lixel_id", "time_index"], "left")
        return out.select("lixel_id", "time_index", "time", F.greatest(F.lit(0.0), F.coalesce("__f", F.lit(0.0))).alias(target), (F.col("length") * F.col("time_width")).alias("measure"))


def components(network: Network) -> DataFrame:
    """(node_id, component): the smallest node id reachable, directions aside. Labels spread along edges and are then replaced by
    their own labels, so long paths shorten fast."""
    both = network.edges.select(F.col("u").alias("a"), F.col("v").alias("b"))
    both = cut(both.union(both.select("b", "a")).distinct())
    label = cut(network.nodes.select("node_id", F.col("node_id").alias("component")))
    while True:
        near = both.join(label.select(F.col("node_id").alias("b"), "component"), "b").groupBy(F.col("a").alias("node_id")).agg(F.min("component").alias("near"))
        step = label.join(near, "node_id", "left").select("node_id", F.col("component").alias("old"), F.least("component", F.coalesce("near", "component")).alias("component"))
        up = label.select(F.col("node_id").alias("component"), F.col("component").alias("up"))
        new = cut(step.join(up, "component", "left").select("node_id", "old", F.least("component", F.coalesce("up", "component")).alias("component")))
        label = new.select("node_id", "component")
        if not new.where("old <> component").limit(1).count():
            return label
