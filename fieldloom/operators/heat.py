"""Heat-equation smoothing on networks: finite elements on lixel meshes, solved tile by tile.

Mesh nodes are network nodes, lixel ends, event offsets and points of a uniform mesh. The nodes inside an edge are a chain; long chains are
cut into pieces. Each piece is eliminated for itself, in rows that Spark deals out, and leaves a few numbers about its ends. Only these meet in a group, so no
group holds event offsets. Components do not exchange heat, so each is a group of its own while it has few such ends. A larger one is cut into square tiles, each with a
margin so wide that what lies beyond it changes nothing in the tile by more than about 1e-12 of the largest value: heat kernels fall as
exp(-d^2 / 4t) on any network. Solutions at the ends go back to the pieces by a join.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.operators.bandwidths import positive
from fieldloom.operators.heat_solver import Chains, batches, contours, solve, summed
from fieldloom.operators.network import components, location_distances
from fieldloom.operators.selection import Selection, best, minimise_log
from fieldloom.operators.spatial import get_target
from fieldloom.plans.lineage import cut
from fieldloom.plans.quantiles import quantiles
from fieldloom.sources.network import Network

TILE = 2000  # ends of pieces of a component that is solved in one group
PIECE = 1024  # mesh segments of an edge that are eliminated together
NODES = 1 << 14  # mesh segments whose rows a task holds as Python objects
TAIL = 1e-12  # what a margin leaves out


def breakpoints(network: Network, lixels: DataFrame, events: DataFrame, mesh_size: float | None = None) -> DataFrame:
    """(edge_index, raw, at, node, component, u, v, edge_length): every offset that the mesh must hold (raw), the breakpoint that stands
    for it (at) and its mesh node. A breakpoint within a tolerance (1e-12, or 1e-12 of the edge) of the last one that stayed is that one, so
    none moves by more than the tolerance; the ends of the edge always stay."""
    if network.directed:
        raise ValueError("heat smoothing needs an undirected network")
    if network.edges.where("u = v").limit(1).count():
        raise ValueError("heat smoothing takes no loops")
    e = network.edges.select("edge_index", "u", "v", F.col("length").alias("edge_length"))
    ends = e.select("edge_index", F.explode(F.array(F.lit(0.0), F.col("edge_length"))).alias("raw"))
    cells = lixels.select("edge_index", F.explode(F.array("start_offset", "end_offset")).alias("raw"))
    points = ends.union(cells).union(events.select("edge_index", "offset"))
    if mesh_size is not None:
        n = F.greatest(F.lit(1), F.ceil(F.col("edge_length") / positive(mesh_size, "mesh size") - 1e-9)).cast("int")
        points = points.union(e.select("edge_index", "edge_length", F.explode(F.sequence(F.lit(0), n)).alias("i"), n.alias("n")).select("edge_index", F.col("edge_length") * F.col("i") / F.col("n")))
    tol = F.greatest(F.lit(1e-12), F.col("edge_length") * 1e-12)
    points = points.distinct().join(e, "edge_index")
    points = points.withColumn("near", F.when(F.col("raw") <= tol, 0.0).when(F.col("edge_length") - F.col("raw") <= tol, F.col("edge_length")).otherwise(F.col("raw")))
    along = Window.partitionBy("edge_index").orderBy("near", "raw")  # the breakpoints of one edge
    before = F.lag("near").over(along)
    far = (before.isNull() | (F.col("near") - before > tol)).cast("int")
    # runs of breakpoints that follow one another within the tolerance, of one or two as a rule
    points = points.withColumn("far", far).withColumn("run", F.sum("far").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    runs = points.groupBy("edge_index", "u", "v", "edge_length", "run").agg(F.array_sort(F.collect_list(F.struct("near", "raw"))).alias("held"))
    none = F.array().cast("array<struct<raw:double,at:double>>")
    last = lambda made: F.get(made, F.size(made) - 1)["at"]
    place = lambda made, x: F.when((F.size(made) > 0) & (x["near"] - last(made) <= tol), last(made)).otherwise(x["near"])
    kept = F.aggregate("held", none, lambda made, x: F.array_append(made, F.struct(x["raw"].alias("raw"), place(made, x).alias("at"))))
    points = runs.select("edge_index", "u", "v", "edge_length", F.explode(kept).alias("p")).select("edge_index", "u", "v", "edge_length", "p.raw", "p.at")
    name = F.when(F.col("at") == 0, F.concat(F.lit("n:"), F.col("u"))).when(F.col("at") == F.col("edge_length"), F.concat(F.lit("n:"), F.col("v")))
    points = points.withColumn("node", name.otherwise(F.concat(F.lit("e:"), F.col("edge_index"), F.lit(":"), F.col("at").cast("string"))))
    piece = components(network).select(F.col("node_id").alias("u"), "component")
    return points.join(piece, "u").select("edge_index", "raw", "at", "node", "component", "u", "v", "edge_length")


def segments_of(points: DataFrame) -> DataFrame:
    """(component, edge_index, u, v, edge_length, a, b, left, right): mesh segments between neighbouring breakpoints of each edge; a and b
    name the mesh nodes."""
    places = points.groupBy("component", "edge_index", "u", "v", "edge_length", "at").agg(F.min("node").alias("a"))
    along = Window.partitionBy("edge_index").orderBy("at")
    lead = places.withColumn("b", F.lead("a").over(along)).withColumn("right", F.lead("at").over(along))
    return lead.where("b is not null").select("component", "edge_index", "u", "v", "edge_length", "a", "b", F.col("at").alias("left"), "right")


def mesh(network: Network, lixels: DataFrame, events: DataFrame, mesh_size: float | None = None) -> DataFrame:
    """The mesh segments."""
    return segments_of(breakpoints(network, lixels, events, mesh_size))


def assembled(segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lumped mass (component, node, mass) and stiffness (component, row, col, value) of the mesh, for inspection."""
    size = F.col("right") - F.col("left")
    mass = segments.select("component", F.explode(F.array("a", "b")).alias("node"), (size / 2).alias("m")).groupBy("component", "node").agg(F.sum("m").alias("mass"))
    s = lambda r, c, v: F.struct(F.col(r).alias("row"), F.col(c).alias("col"), v.alias("value"))
    parts = segments.select("component", F.explode(F.array(s("a", "a", 1 / size), s("b", "b", 1 / size), s("a", "b", -1 / size), s("b", "a", -1 / size))).alias("x"))
    return mass, parts.select("component", "x.*").groupBy("component", "row", "col").agg(F.sum("value").alias("value"))


def _complex(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A column of lists of equal length, without nulls, as rows of complex numbers."""
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten().to_numpy(zero_copy_only=False)
    return np.ascontiguousarray(flat).view(complex).reshape(len(column), -1)


def _list(x: np.ndarray) -> pa.Array:
    """Rows of complex numbers as a column of lists."""
    flat = np.ascontiguousarray(x).view(float).reshape(len(x), 2 * x.shape[-1])
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * flat.shape[1]), pa.array(flat.ravel()))


def _some(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in runs of rows of about NODES mesh segments, as values of rows become Python objects."""
    for table in tables:
        ends = table.column("sizes").value_lengths().fill_null(0).to_numpy(zero_copy_only=False).cumsum()
        start = 0
        while start < len(ends):
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + NODES, "right")))
            yield table.slice(start, stop - start)
            start = stop


def pieces_of(segments: DataFrame, sources: DataFrame, most: int = PIECE) -> DataFrame:
    """(component, edge_index, piece, u, v, edge_length, start, head, tail, sizes, names, given): each edge in pieces of at most so many segments. head and tail
    name the end nodes of a piece, names its inner nodes, given holds the sources (key, pos, value) on these."""
    place = F.row_number().over(Window.partitionBy("edge_index").orderBy("left"))
    rows = segments.withColumn("piece", F.floor((place - 1) / most).cast("int"))
    s = F.array_sort(F.collect_list(F.struct("left", "right", "a", "b"))).alias("s")
    rows = rows.groupBy("component", "edge_index", "piece").agg(s, *[F.first(c).alias(c) for c in ("u", "v", "edge_length")])
    pieces = cut(
        rows.select(
            "component", "edge_index", "piece", "u", "v", "edge_length", F.col("s")[0]["left"].alias("start"), F.col("s")[0]["a"].alias("head"),
            F.element_at("s", -1)["b"].alias("tail"), F.transform("s", lambda x: x["right"] - x["left"]).alias("sizes"),
            F.transform(F.slice("s", F.lit(1), F.size("s") - 1), lambda x: x["b"]).alias("names"),
        )
    )
    inner = pieces.select("component", "edge_index", "piece", F.posexplode("names").alias("pos", "node"))
    given = sources.select("component", "node", F.col("key").cast("string").alias("key"), F.col("value").cast("double").alias("value")).join(inner, ["component", "node"])
    given = given.groupBy("edge_index", "piece").agg(F.collect_list(F.struct("key", "pos", "value")).alias("given"))
    return cut(pieces.join(given, ["edge_index", "piece"], "left"))


_CONDENSED = (
    "component string, edge_index long, piece int, u string, v string, edge_length double, start double, head string, tail string, first double, last double, "
    "uu array<double>, uv array<double>, vv array<double>, drives array<struct<key:string,pu:array<double>,pv:array<double>>>"
)
_KEEP = ["component", "edge_index", "piece", "u", "v", "edge_length", "start", "head", "tail"]


def _condense(times: list[float]):
    """Pieces to what their ends need to know of them; uu, uv and vv are missing where a piece has no inner node."""

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z, _ = contours(times)
        numbers, drive = pa.list_(pa.float64()), pa.list_(pa.struct([("key", pa.string()), ("pu", pa.list_(pa.float64())), ("pv", pa.list_(pa.float64()))]))
        for table in _some(tables):
            sizes = [np.array(x) for x in table.column("sizes").to_pylist()]
            given = [x or [] for x in table.column("given").to_pylist()]
            count = np.array([len(x) - 1 for x in sizes])
            ends = [[None] * len(sizes) for _ in range(3)]
            drives: list[list] = [[] for _ in sizes]
            inner = np.flatnonzero(count > 0)
            for at in batches(count[inner], len(z)):
                at = inner[at]
                chain = Chains.of([sizes[i] for i in at], z)
                for out, found in zip(ends, chain.ends(), strict=True):
                    for i, x in zip(at, found, strict=True):
                        out[i] = x.view(float)
                rows = [(j, i, k) for j, i in enumerate(at) for k in sorted({g["key"] for g in given[i]})]
                for start in range(0, len(rows), len(at)):
                    some = rows[start : start + len(at)]
                    which = np.array([j for j, _, _ in some])
                    source = np.zeros((len(chain.f), len(some)))
                    for r, (_, i, k) in enumerate(some):
                        for g in given[i]:
                            if g["key"] == k:
                                source[g["pos"], r] += g["value"]
                    pu, pv = chain.drives(which, chain.driven(which, source))
                    for (_, i, k), x, y in zip(some, pu, pv, strict=True):
                        drives[i].append({"key": k, "pu": x.view(float), "pv": y.view(float)})
            lengths = [pa.array([float(x[i]) for x in sizes], pa.float64()) for i in (0, -1)]
            made = [*lengths, *[pa.array(e, numbers) for e in ends], pa.array(drives, drive)]
            yield pa.RecordBatch.from_arrays([*[table.column(c) for c in _KEEP], *made], [*_KEEP, "first", "last", "uu", "uv", "vv", "drives"])

    return run


_JUNCTIONS = "tile string, component string, kind int, node string, key string, edge_index long, piece int, x array<double>, g array<double>, value array<double>, own array<double>, mine boolean"


def _junctions(times: list[float], tolerance: float, own: bool):
    """The junctions of a tile: their solutions for each key (kind 0, with heat by time), and the inverse between the ends of pieces (kind 1)."""

    def run(table: pa.Table) -> pa.Table:
        z, weight = contours(times)
        kind = table.column("kind").to_numpy()
        parts, given = table.filter(pa.array(kind == 0)), table.filter(pa.array(kind == 1))
        head, tail = (np.array(parts.column(c).to_pylist(), dtype=object) for c in ("head", "tail"))
        nodes, number = np.unique(np.concatenate([head, tail]), return_inverse=True)
        a, b = number[: len(head)], number[len(head) :]
        first, last = (parts.column(c).to_numpy() for c in ("first", "last"))
        mass = np.bincount(a, first / 2, len(nodes)) + np.bincount(b, last / 2, len(nodes))
        plain = parts.column("uu").is_null().to_numpy(zero_copy_only=False)
        ends = []
        for name, sign in (("uu", 1), ("uv", -1), ("vv", 1)):
            e = np.repeat((sign / first).astype(complex)[:, None], len(z), axis=1)
            if (~plain).any():
                e[~plain] = _complex(parts.column(name).filter(pa.array(~plain)))
            ends.append(e)
        place = {n: i for i, n in enumerate(nodes)}
        held = parts.column("drives").combine_chunks()
        owner, drives = np.repeat(np.arange(len(held)), held.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)), held.flatten()
        driven = drives.field("key").to_pylist()
        keys = sorted(set(driven) | set(given.column("key").to_pylist()))
        at = {k: i for i, k in enumerate(keys)}
        sources = np.zeros((len(nodes), len(keys), len(z)), complex)
        if len(owner):
            which = np.array([at[k] for k in driven])
            np.add.at(sources, (a[owner], which), _complex(drives.field("pu")))
            np.add.at(sources, (b[owner], which), _complex(drives.field("pv")))
        for n, k, v in zip(*(given.column(c).to_pylist() for c in ("head", "key", "value")), strict=True):
            if n in place:
                sources[place[n], at[k]] += v
        x, g, cross = solve(a, b, tuple(ends), mass, sources, z, own)
        heat = _checked(summed(x, weight), tolerance)
        back = summed(g, weight) if own else np.zeros((len(nodes), len(times)))
        mine = np.zeros(len(nodes), bool)
        mine[a] |= parts.column("own_a").to_numpy(zero_copy_only=False)
        mine[b] |= parts.column("own_b").to_numpy(zero_copy_only=False)
        tile, component = table.column("tile")[0].as_py(), table.column("component")[0].as_py()
        n, none = len(nodes), pa.nulls

        def rows(size: int, kind: int, **columns: pa.Array) -> pa.Table:
            base = {"tile": pa.array([tile] * size, pa.string()), "component": pa.array([component] * size, pa.string()), "kind": pa.array([kind] * size, pa.int32())}
            types = {"node": pa.string(), "key": pa.string(), "edge_index": pa.int64(), "piece": pa.int32(), "mine": pa.bool_()}
            numbers = pa.list_(pa.float64())
            return pa.table({c: base[c] if c in base else columns[c] if c in columns else none(size, types.get(c, numbers)) for c in _COLUMNS})

        real = lambda v: pa.array(list(v), pa.list_(pa.float64()))
        own_g = {"g": _list(g)} if own else {}
        out = [
            rows(n, 0, node=pa.array(nodes.tolist(), pa.string()), key=pa.array([k] * n, pa.string()), x=_list(x[:, i]), value=real(heat[:, i]), own=real(back), mine=pa.array(mine), **own_g)
            for i, k in enumerate(keys)
        ]
        if own:
            here = np.flatnonzero(~plain)
            take = pa.array(here)
            out.append(rows(len(here), 1, edge_index=parts.column("edge_index").take(take).combine_chunks(), piece=parts.column("piece").take(take).combine_chunks(), x=_list(cross[here])))
        return pa.concat_tables(out) if out else rows(0, 0)

    return run


_COLUMNS = [c.split()[0] for c in _JUNCTIONS.split(", ")]
_SCHEMA = "component string, key string, time double, node string, value double, own double"


def _checked(heat: np.ndarray, tolerance: float) -> np.ndarray:
    if heat.size and heat.min() < -tolerance * max(1.0, np.abs(heat).max()):
        raise ValueError("a heat field is negative beyond rounding")
    return np.maximum(heat, 0)


def _back(times: list[float], tolerance: float, own: bool):
    """Pieces with the solutions at their ends to heat at their inner nodes, for one key a row."""

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z, weight = contours(times)
        for table in _some(tables):
            sizes = [np.array(x) for x in table.column("sizes").to_pylist()]
            names, given, keys = (table.column(c).to_pylist() for c in ("names", "given", "key"))
            start, length, side = (table.column(c).to_numpy(zero_copy_only=False) for c in ("start", "edge_length", "side"))
            count = np.array([len(x) - 1 for x in sizes])
            column = {c: _complex(table.column(c)) for c in (("xu", "xv", "gu", "gv", "guv") if own else ("xu", "xv"))} if len(sizes) else {}
            for at in batches(count, len(z)):
                chain, source = Chains.of([sizes[i] for i in at], z), np.zeros((int(count[at].max()), len(at)))
                for r, i in enumerate(at):
                    for g in given[i] or []:
                        if g["key"] == keys[i]:
                            source[g["pos"], r] += g["value"]
                xu, xv = (column[c][at] for c in ("xu", "xv"))
                heat = _checked(summed(chain.driven(np.arange(len(at)), source) + chain.alpha * xu + chain.beta * xv, weight), tolerance)
                back = np.zeros(heat.shape)
                if own:
                    gu, gv, guv = (column[c][at] for c in ("gu", "gv", "guv"))
                    back = summed(chain.local + chain.alpha**2 * gu + chain.beta**2 * gv + 2 * chain.alpha * chain.beta * guv, weight)
                # a node belongs to the tile of the nearer end of its edge
                for r, i in enumerate(at):
                    n = int(count[i])
                    near_u = 2 * (start[i] + np.cumsum(sizes[i][:-1])) <= length[i]
                    mine = np.flatnonzero(near_u if side[i] == 0 else ~near_u if side[i] == 1 else np.ones(n, bool))
                    for t, time in enumerate(times):
                        m = len(mine)
                        fixed = [pa.array([table.column("component")[i].as_py()] * m, pa.string()), pa.array([keys[i]] * m, pa.string()), pa.array(np.full(m, time))]
                        yield pa.RecordBatch.from_arrays(
                            [*fixed, pa.array([names[i][j] for j in mine], pa.string()), pa.array(heat[mine, r, t]), pa.array(back[mine, r, t])],
                            ["component", "key", "time", "node", "value", "own"],
                        )

    return run


def evolve(
    segments: DataFrame, sources: DataFrame, times: Sequence[float], *, nodes: DataFrame | None = None, own: bool = False, tile: int = TILE, piece: int = PIECE, tolerance: float = 1e-9
) -> DataFrame:
    """(component, key, time, node, value, own): nodal heat after each time from sources (component, node, key, value); own is what a unit
    source at the node leaves there, if asked for.

    Each edge, in pieces of at most `piece` segments, is eliminated in its own row; groups hold the ends of pieces only, and inner nodes get their heat back from
    those by a join. nodes (node_id, x, y) allow components of more than `tile` ends to be cut into tiles; without them a
    component is one group. Nodes without heat from any source of their tile may be missing."""
    times = [positive(t, "diffusion time") for t in sorted(set(times))]
    pieces = pieces_of(segments.join(sources.select("component").distinct(), "component", "left_semi"), sources, piece)
    condensed = cut(pieces.mapInArrow(_condense(times), _CONDENSED))
    ends = condensed.select("component", F.explode(F.array("head", "tail")).alias("node")).distinct()
    at_ends = sources.join(ends, ["component", "node"], "left_semi")
    sizes = ends.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    large = cut(sizes.where(F.col("n") > tile).select("component")) if nodes is not None else None
    yes = F.lit(True)
    if large is None or not large.limit(1).count():
        homes = condensed.select("edge_index", F.col("component").alias("tile")).distinct().withColumn("side", F.lit(2))
        rows = condensed.withColumn("tile", F.col("component")).withColumn("own_a", yes).withColumn("own_b", yes)
        given = at_ends.withColumn("tile", F.col("component"))
    else:
        small = condensed.join(large, "component", "left_anti")
        homes, rows = _tiles(condensed.join(large, "component", "left_semi"), nodes, times, tile)
        homes = homes.union(small.select("edge_index", F.col("component").alias("tile")).distinct().withColumn("side", F.lit(2)))
        held = rows.select("component", "tile", F.explode(F.array("head", "tail")).alias("node")).distinct()
        # a source goes to every tile that holds its node
        given = at_ends.join(held, ["component", "node"])
        rows = rows.unionByName(small.withColumn("tile", F.col("component")).withColumn("own_a", yes).withColumn("own_b", yes))
        given = given.unionByName(at_ends.join(large, "component", "left_anti").withColumn("tile", F.col("component")))
    found = cut(_grouped(rows, given).groupBy("tile").applyInArrow(_junctions(times, tolerance, own), _JUNCTIONS))
    junction = found.where("kind = 0")
    per_time = F.explode(F.arrays_zip(F.array(*[F.lit(t) for t in times]).alias("time"), "value", "own")).alias("r")
    heat = junction.where("mine").select("component", "key", "node", per_time).select("component", "key", "r.time", "node", "r.value", "r.own")
    end = lambda n, s: junction.select("tile", F.col("node").alias(n), "key", F.col("x").alias(f"x{s}"), F.col("g").alias(f"g{s}"))
    inner = pieces.where(F.size("names") > 0).join(homes, "edge_index").join(end("head", "u"), ["tile", "head"]).join(end("tail", "v"), ["tile", "tail", "key"])
    if own:
        inner = inner.join(found.where("kind = 1").select("tile", "edge_index", "piece", F.col("x").alias("guv")), ["tile", "edge_index", "piece"])
    return heat.union(inner.mapInArrow(_back(times, tolerance, own), _SCHEMA))


def _grouped(condensed: DataFrame, sources: DataFrame) -> DataFrame:
    """The rows of the junction groups: pieces (kind 0) and sources on their ends (kind 1)."""
    none = {n: k for n, k in (c.split() for c in "edge_index long,piece int,tail string,first double,last double".split(","))}
    parts = ["edge_index", "piece", "tail", "first", "last", "uu", "uv", "vv", "drives", "own_a", "own_b"]
    kinds = dict(condensed.dtypes)
    rows = condensed.select("tile", "component", F.lit(0).alias("kind"), "head", *parts, F.lit(None).cast("string").alias("key"), F.lit(None).cast("double").alias("value"))
    empty = [F.lit(None).cast(none.get(c, kinds[c])).alias(c) for c in parts]
    return rows.union(sources.select("tile", "component", F.lit(1), F.col("node"), *empty, F.col("key").cast("string"), F.col("value").cast("double")))


def _tiles(condensed: DataFrame, nodes: DataFrame, times: list[float], tile: int) -> tuple[DataFrame, DataFrame]:
    """Large components in tiles. homes (edge_index, tile, side): the tiles that give an edge its heat, one for the half at u (side 0) and one at
    v (1), or one for both (2). And the pieces with tile, own_a and own_b: each edge goes to all tiles from whose nodes it is within the
    margin; an end of a piece belongs to the tile of the nearer end of its edge."""
    at = lambda n: nodes.select(F.col("node_id").alias(n), F.col("x").alias(f"{n}x"), F.col("y").alias(f"{n}y"))
    edges = condensed.groupBy("component", "edge_index", "u", "v", "edge_length").agg(F.count(F.lit(1)).alias("pieces")).join(at("u"), "u").join(at("v"), "v")
    edges = cut(edges)
    chord = F.hypot(F.col("ux") - F.col("vx"), F.col("uy") - F.col("vy"))
    row = edges.agg(
        F.min(F.when(chord > 0, F.col("edge_length") / chord)).alias("ratio"), F.max("ux").alias("x1"), F.min("ux").alias("x0"), F.max("uy").alias("y1"), F.min("uy").alias("y0"),
        (F.count_distinct("u") + F.sum(F.col("pieces") - 1)).alias("n"),
    ).first()
    reach = math.sqrt(4 * max(times) * math.log(1 / TAIL)) / min(1.0, row["ratio"] or 1.0)
    margin = 2 * reach  # a node nearer to one end of an edge may be reached by way of the other
    side = math.sqrt(max(row["x1"] - row["x0"], 1e-300) * max(row["y1"] - row["y0"], 1e-300) * tile / 4 / row["n"])
    side = max(side, 2 * reach)
    cell = lambda c: F.floor(c / side).cast("long")
    name = lambda x, y: F.concat_ws(":", "component", x.cast("string"), y.cast("string"))
    span = lambda c: F.sequence(cell(F.col(c) - margin), cell(F.col(c) + margin))
    near = edges.select("component", "edge_index", F.explode(span("ux")).alias("cx"), "uy").withColumn("cy", F.explode(span("uy"))).drop("uy")
    near = near.union(edges.select("component", "edge_index", F.explode(span("vx")).alias("cx"), "vy").withColumn("cy", F.explode(span("vy"))).drop("vy")).distinct()
    near = near.select("edge_index", name(F.col("cx"), F.col("cy")).alias("tile"))
    home = edges.select("edge_index", name(cell(F.col("ux")), cell(F.col("uy"))).alias("hu"), name(cell(F.col("vx")), cell(F.col("vy"))).alias("hv"))
    one = F.array(F.struct(F.col("hu").alias("tile"), F.lit(2).alias("side")))
    two = F.array(F.struct(F.col("hu").alias("tile"), F.lit(0).alias("side")), F.struct(F.col("hv").alias("tile"), F.lit(1).alias("side")))
    homes = home.select("edge_index", F.explode(F.when(F.col("hu") == F.col("hv"), one).otherwise(two)).alias("h")).select("edge_index", "h.tile", "h.side")
    busy = homes.select("tile").distinct()
    rows = condensed.join(home, "edge_index").join(near.join(busy, "tile", "left_semi"), "edge_index")
    ends = condensed.select("edge_index", "piece", F.col("start").alias("stop"))
    after = Window.partitionBy("edge_index").orderBy("piece")
    ends = ends.withColumn("stop", F.lead("stop").over(after))
    rows = rows.join(ends, ["edge_index", "piece"])
    nearer = lambda c: F.when(c * 2 <= F.col("edge_length"), F.col("hu")).otherwise(F.col("hv")) == F.col("tile")
    own = {"own_a": nearer(F.col("start")), "own_b": nearer(F.coalesce("stop", "edge_length"))}
    return cut(homes), cut(rows.withColumns(own).select(*condensed.columns, "tile", "own_a", "own_b"))


def event_nodes(points: DataFrame, events: DataFrame) -> DataFrame:
    """(event_id, weight, component, node): the mesh node of each event."""
    at = points.select("edge_index", F.col("raw").alias("offset"), "component", "node")
    return events.join(at, ["edge_index", "offset"]).select("event_id", "weight", "component", "node")


@dataclass(frozen=True)
class HeatNetworkExperiment:
    """Cell averages of the heat field on lixels for several diffusion times; equivalent Gaussian bandwidth is sqrt(2 t)."""

    times: Sequence[float]
    mesh_size: float | None = None
    target: str = "density"
    tile: int = TILE

    def evaluate(self, network: Network, events: DataFrame, lixels: DataFrame) -> DataFrame:
        """(batch_index, diffusion_time, lixel columns, density or intensity) for events (event_id, edge_index, offset, weight).
        Times keep their order; repeated times give repeated batches."""
        events = cut(events)  # read several times; often the result of snapping
        target = get_target(self.target)
        total = (events.agg(F.sum("weight").alias("w")).first()["w"] or 0.0) if target == "density" else 1.0
        points = cut(breakpoints(network, lixels, events, self.mesh_size))
        segments = cut(segments_of(points))
        sources = event_nodes(points, events).groupBy("component", "node").agg((F.sum("weight") / total).alias("value")).withColumn("key", F.lit("all"))
        heat = cut(evolve(segments, sources, self.times, nodes=network.nodes, tile=self.tile).select("time", "node", "value"))
        area = lixel_areas(segments, heat, lixels)
        batches = lixels.sparkSession.createDataFrame([(i, float(t)) for i, t in enumerate(self.times)], "batch_index int, diffusion_time double")
        grid = lixels.crossJoin(F.broadcast(batches))
        out = grid.join(area.withColumnRenamed("time", "diffusion_time"), ["lixel_id", "diffusion_time"], "left")
        return out.withColumn(target, F.coalesce(F.col("area") / F.col("length"), F.lit(0.0))).drop("area")


def with_ends(segments: DataFrame, heat: DataFrame) -> DataFrame:
    """segments with the nodal values l and r of their ends, by time; heat has time, node and value, one source."""
    left = heat.select(F.col("node").alias("a"), "time", F.col("value").alias("l"))
    return segments.join(left, "a").join(heat.select(F.col("node").alias("b"), "time", F.col("value").alias("r")), ["b", "time"])


def lixel_areas(segments: DataFrame, heat: DataFrame, lixels: DataFrame) -> DataFrame:
    """(lixel_id, time, area): trapezoids of the field over each lixel. A segment lies in the last lixel that starts at or before its
    middle, found in one ordered pass over the edge."""
    starts = lixels.select("edge_index", F.col("start_offset").alias("at"), F.lit(0).alias("kind"), "lixel_id", *[F.lit(None).cast("double").alias(c) for c in ("left", "right")])
    middles = segments.select("edge_index", ((F.col("left") + F.col("right")) / 2).alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("lixel_id"), "left", "right")
    along = Window.partitionBy("edge_index").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    of = starts.union(middles).withColumn("lixel_id", F.last("lixel_id", True).over(along)).where("kind = 1 and lixel_id is not null").select("edge_index", "left", "right", "lixel_id")
    return (
        with_ends(segments, heat).join(of, ["edge_index", "left", "right"])
        .groupBy("lixel_id", "time").agg(F.sum((F.col("right") - F.col("left")) * (F.col("l") + F.col("r")) / 2).alias("area"))
    )


def squared_integral(segments: DataFrame, heat: DataFrame) -> DataFrame:
    """(time, square): the exact integral of the squared field, which is linear on each segment."""
    l, r = F.col("l"), F.col("r")
    return with_ends(segments, heat).groupBy("time").agg(F.sum((F.col("right") - F.col("left")) * (l * l + l * r + r * r) / 3).alias("square"))


def equivalent_bandwidth(diffusion_time: float) -> float:
    """The Gaussian bandwidth that spreads as heat does on a line."""
    return math.sqrt(2 * positive(diffusion_time, "diffusion time"))


def heat_scores(
    network: Network, events: DataFrame, lixels: DataFrame, times: Sequence[float], *, objective: str = "likelihood", mesh_size: float | None = None, floor: float = 1e-300,
    tile: int = TILE, prepared: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """(h, score) for each diffusion time h: the negative leave-one-out log likelihood, or least squares with the exact integral of the
    squared field. The others' heat at an event is all of it less its own, so the work does not grow with the pairs of events."""
    if objective not in ("likelihood", "least_squares"):
        raise ValueError("objective is likelihood or least_squares")
    events = cut(events)
    points, segments = prepared or _prepared(network, events, lixels, mesh_size)
    at = cut(event_nodes(points, events))
    total = events.agg(F.sum("weight").alias("w")).first()["w"]
    if events.where(total - F.col("weight") <= 0).limit(1).count():
        raise ValueError("leave-one-out needs weight besides each event")
    sources = at.groupBy("component", "node").agg(F.sum("weight").alias("value")).withColumn("key", F.lit("all"))
    heat = cut(evolve(segments, sources, times, nodes=network.nodes, own=True, tile=tile).select("time", "node", "value", "own"))
    others = F.greatest(F.lit(0.0), F.col("value") - F.col("weight") * F.col("own"))
    loo = at.join(heat, "node").select("time", "weight", (others / (total - F.col("weight"))).alias("f"))
    w = F.col("weight")
    if objective == "likelihood":
        score = -F.sum(w * F.log(F.greatest(F.col("f"), F.lit(floor)))) / F.sum("weight")
        return loo.groupBy(F.col("time").alias("h")).agg(score.alias("score"))
    cross = loo.groupBy("time").agg((F.sum(w * F.col("f")) / F.sum("weight")).alias("cross"))
    density = heat.select("time", "node", (F.col("value") / total).alias("value"))
    return squared_integral(segments, density).join(cross, "time").select(F.col("time").alias("h"), (F.col("square") - 2 * F.col("cross")).alias("score"))


def heat_likelihood(network: Network, events: DataFrame, lixels: DataFrame, times: Sequence[float], mesh_size: float | None = None, floor: float = 1e-300) -> DataFrame:
    """heat_scores by likelihood."""
    return heat_scores(network, events, lixels, times, mesh_size=mesh_size, floor=floor)


def _prepared(network: Network, events: DataFrame, lixels: DataFrame, mesh_size: float | None) -> tuple[DataFrame, DataFrame]:
    points = cut(breakpoints(network, lixels, events, mesh_size))
    return points, cut(segments_of(points))


def best_heat_time(scores: DataFrame) -> DataFrame:
    return best(scores)


def heat_time_bounds(network: Network, events: DataFrame) -> tuple[float, float]:
    """Half the squares of distances between events: from a fifth of the 5th percentile (or 1e-6 of the median) to twice the 95th."""
    places = events.select(F.col("event_id").alias("source"), "edge_index", "offset")
    d = location_distances(network, places, places.withColumnRenamed("source", "target"), None, directed=False).where("source < target and distance > 0")
    q = quantiles(d.select("distance"), (0.05, 0.5, 0.95))
    if q is None:
        raise ValueError("automatic bounds need two events a positive distance apart")
    low = max(0.2 * q[0], 1e-6 * q[1])
    high = max(2 * q[2], low * math.sqrt(10))
    return low * low / 2, high * high / 2


@dataclass(frozen=True)
class _HeatCV:
    bounds: tuple[float, float] | None = None
    mesh_size: float | None = None
    tolerance: float = 1e-5
    most: int = 200
    floor: float = 1e-300

    method = ""

    def select(self, network: Network, events: DataFrame, lixels: DataFrame) -> Selection:
        """The diffusion time of the smallest score; the mesh is built once, each evaluation is a job."""
        events = cut(events)
        prepared = _prepared(network, events, lixels, self.mesh_size)
        bounds = self.bounds or heat_time_bounds(network, events)

        def score(t: float) -> float:
            return float(heat_scores(network, events, lixels, [t], objective=self.method, floor=self.floor, prepared=prepared).first()["score"])

        t, s, trace = minimise_log(score, bounds, self.tolerance, self.most)
        return Selection(t, s, tuple(trace), bounds, f"heat_{self.method}")


@dataclass(frozen=True)
class HeatLikelihoodCV(_HeatCV):
    """Leave-one-out likelihood of a diffusion time."""

    method = "likelihood"


@dataclass(frozen=True)
class HeatLeastSquaresCV(_HeatCV):
    """Least squares of a diffusion time."""

    method = "least_squares"


def get_heat_time(value: object, network: Network, events: DataFrame, lixels: DataFrame) -> tuple[float, Selection | None]:
    """A positive number, or the choice of anything with select(network, events, lixels)."""
    if hasattr(value, "select"):
        found = value.select(network, events, lixels)
        return found.bandwidth, found
    return positive(value, "diffusion time"), None


@dataclass(frozen=True)
class HeatNetworkKDE:
    """One diffusion time: a number or a selector."""

    diffusion_time: object = 1.0
    mesh_size: float | None = None
    target: str = "density"

    def evaluate(self, network: Network, events: DataFrame, lixels: DataFrame) -> DataFrame:
        t, _ = get_heat_time(self.diffusion_time, network, events, lixels)
        return HeatNetworkExperiment((t,), self.mesh_size, self.target).evaluate(network, events, lixels).drop("batch_index", "diffusion_time")
