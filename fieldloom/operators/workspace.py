"""Workspaces: a network, its lixels and its events, with what was prepared from them, checked and kept as one.

Distances and stretches are the dear part of a field on a network. A workspace holds them as tables (assets), each with the content hashes
of what it was made from. Distances are kept as those between the ends of edges, from which pairs are made where they are added up. Fields of any bandwidth within an asset's cutoff, at one time or over time cells, are then one join and one
sum. An asset that was made from other content is refused. Workspaces are saved as bundles, which are swapped as a whole.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions.kernels import get_kernel
from fieldloom.operators.bandwidths import positive
from fieldloom.operators.network import NetworkKDE, TemporalNetworkKDE, edge_ways, get_policy, kernel_from_distances, kernel_from_stretches, location_distances, propagate, require_events
from fieldloom.plans.lineage import cut
from fieldloom.sources import store
from fieldloom.sources.network import Network
from fieldloom.sources.planar import Issue, Report, fingerprint

VERSION = 1


@dataclass(frozen=True)
class Asset:
    """A table prepared from events and lixels: distances (source, target, distance), or stretches of one junction policy; up to a cutoff. With
    ways (distances between the ends of edges), which are kept in its place, the distances are made of them each time."""

    kind: str
    table: DataFrame
    cutoff: float
    directed: bool
    made_from: Mapping[str, str]
    policy: str = "simple"
    ways: DataFrame | None = None

    def n_pairs(self) -> int:
        """Rows: pairs within the cutoff, or stretches."""
        return self.table.count()

    def density(self, n_sources: int, n_targets: int) -> float:
        """The share of all pairs that lie within the cutoff."""
        return self.n_pairs() / (n_sources * n_targets) if n_sources and n_targets else 0.0

    def neighbors(self, source: object) -> DataFrame:
        """The rows of one source, the nearest first."""
        return self.table.where(F.col("source") == F.lit(source)).orderBy("distance" if self.kind == "distances" else "start_distance")

    def counts(self) -> DataFrame:
        """(source, n): rows of each source."""
        return self.table.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@dataclass(frozen=True)
class NetworkWorkspace:
    """events have event_id, edge_index, offset, weight and, for fields over time, time. Made by of() or load()."""

    network: Network
    events: DataFrame
    lixels: DataFrame
    prints: Mapping[str, str]
    assets: Mapping[str, Asset] = field(default_factory=dict)

    @classmethod
    def of(cls, network: Network, events: DataFrame, lixels: DataFrame) -> NetworkWorkspace:
        events = cut(events)
        require_events(network, events)
        parts = {"nodes": network.nodes, "edges": network.edges, "events": events, "lixels": lixels}
        return cls(network, events, lixels, {n: fingerprint(df) for n, df in parts.items()})

    def _sources(self) -> DataFrame:
        return self.events.select(F.col("event_id").alias("source"), "edge_index", "offset")

    def _targets(self) -> DataFrame:
        return self.lixels.select(F.col("lixel_id").alias("target"), "edge_index", F.col("center_offset").alias("offset"))

    def prepare_distances(self, cutoff: float, *, directed: bool | None = None) -> NetworkWorkspace:
        """With the distances of all events to all lixels within the cutoff."""
        ways = edge_ways(self.network, self._sources(), self._targets(), positive(cutoff, "cutoff"), directed)
        return self.attach("distances", self._distances(ways, float(cutoff), self.network.is_directed(directed), dict(self.prints)))

    def _distances(self, ways: DataFrame, cutoff: float, directed: bool, made_from: Mapping[str, str]) -> Asset:
        pairs = location_distances(self.network, self._sources(), self._targets(), cutoff, directed=directed, ways=ways)
        return Asset("distances", pairs, cutoff, directed, made_from, ways=ways)

    def prepare_stretches(self, policy: str, cutoff: float, *, directed: bool | None = None, max_records: int = 100_000) -> NetworkWorkspace:
        """With the stretches that a policy's paths take within the cutoff; a policy that follows no paths has none."""
        if not get_policy(policy).path_based:
            raise ValueError(f"the {policy} policy takes distances")
        found = propagate(self.network, self._sources(), positive(cutoff, "cutoff"), policy=policy, directed=directed, max_records=max_records)
        return self.attach(f"stretches_{policy}", Asset("stretches", cut(found), float(cutoff), self.network.is_directed(directed), dict(self.prints), policy))

    def attach(self, name: str, asset: Asset) -> NetworkWorkspace:
        """With an asset, which must have been made from this network, these events and these lixels."""
        made = replace(self, assets={**self.assets, name: asset})
        made.check().raise_for_errors()
        return made

    def check(self) -> Report:
        """An error for every asset that was made from something else."""
        found = []
        for name, asset in self.assets.items():
            other = sorted(n for n, p in self.prints.items() if asset.made_from.get(n) != p)
            if other:
                found.append(Issue("error", "stale_asset", f"{name} was made from other {', '.join(other)}"))
        return Report(tuple(found))

    def kernel_values(self, kde: NetworkKDE, carry: Sequence[str] = ()) -> DataFrame:
        """(source, target, k) of a field with one bandwidth, from the assets; with the columns of the events to be carried, if distances are kept as
        ways between edges."""
        kernel, h = get_kernel(kde.kernel), positive(kde.bandwidth)
        if kernel.reach is None:
            raise ValueError("prepared fields need a kernel with reach")
        name = f"stretches_{kde.policy}" if get_policy(kde.policy).path_based else "distances"
        asset = self.assets.get(name)
        if asset is None or asset.cutoff < h * kernel.reach or asset.directed != self.network.is_directed(kde.directed):
            raise ValueError(f"no prepared {name} reach as far as {h * kernel.reach}, or they have another direction")
        if asset.ways is not None:
            sources = self.events.select(F.col("event_id").alias("source"), "edge_index", "offset", *carry)
            d = location_distances(self.network, sources, self._targets(), h * kernel.reach, directed=asset.directed, carry=carry, ways=asset.ways)
            return kernel_from_distances(d, kernel, F.lit(h), carry).where("k <> 0")
        if asset.kind == "distances":
            return kernel_from_distances(asset.table, kernel, F.lit(h)).where("k <> 0")
        return kernel_from_stretches(asset.table.withColumn("h", F.lit(h)), self._targets(), kernel, F.col("h"))

    def evaluate(self, kde: NetworkKDE) -> DataFrame:
        """lixels with density or intensity."""
        return kde.field(self.events, self.lixels, self.kernel_values(kde, ["weight"]))

    def evaluate_over_time(self, kde: TemporalNetworkKDE, cells: DataFrame) -> DataFrame:
        """(lixel_id, time_index, time, density or intensity, measure); the distances serve every time cell and bandwidth of time."""
        return kde.evaluate(self.network, self.events, self.lixels, cells, values=self.kernel_values(kde.network_kde))

    def save(self, path: str, *, overwrite: bool = False) -> None:
        """As a bundle; readers see the old one or the new one."""
        tables = {"nodes": self.network.nodes, "edges": self.network.edges, "events": self.events, "lixels": self.lixels}
        about = {n: {"kind": a.kind, "cutoff": a.cutoff, "directed": a.directed, "made_from": dict(a.made_from), "policy": a.policy, "ways": a.ways is not None} for n, a in self.assets.items()}
        metadata = {"workspace": VERSION, "directed": self.network.directed, "crs": self.network.crs, "assets": about}
        store.save(path, {**tables, **{f"asset_{n}": a.table if a.ways is None else a.ways for n, a in self.assets.items()}}, metadata, overwrite=overwrite, sources=self.prints)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> NetworkWorkspace:
        """A saved workspace, with every table compared with its content hash and every asset with what it was made from."""
        tables, about = store.load(spark, path)
        if about.get("workspace") != VERSION:
            raise ValueError("this is no workspace")
        network = Network(tables["nodes"], tables["edges"], about["directed"], about["crs"])
        made = cls(network, tables["events"], tables["lixels"], {n: fingerprint(tables[n]) for n in ("nodes", "edges", "events", "lixels")})
        for name, a in about["assets"].items():
            if a.get("ways"):
                made = made.attach(name, made._distances(tables[f"asset_{name}"], a["cutoff"], a["directed"], a["made_from"]))
                continue
            made = made.attach(name, Asset(a["kind"], tables[f"asset_{name}"], a["cutoff"], a["directed"], a["made_from"], a["policy"]))
        return made
