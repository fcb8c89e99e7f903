"""Saving and loading bundles of tables: Parquet directories and a manifest of content hashes.

Every save writes a version of its own and, when all of it is there, a manifest that names it. Readers take the newest manifest that
is complete, so they see the old version or the new one, never a mixture, and a save that fails in between changes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.sources.planar import fingerprint

VERSION = 2


def _files(spark: SparkSession, path: str):
    """The folder by the file system that Spark reads it with."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _manifests(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete manifests, ascending: those whose write Spark has marked as done."""
    files, where = _files(spark, f"{path}/manifests")
    if not files.exists(where):
        return []
    names = [s.getPath().getName() for s in files.listStatus(where)]
    return sorted(int(n) for n in names if n.isdigit() and files.exists(_files(spark, f"{path}/manifests/{n}/_SUCCESS")[1]))


def save(
    path: str, tables: Mapping[str, DataFrame], metadata: Mapping[str, object] | None = None, *, overwrite: bool = False, sources: Mapping[str, str] | None = None
) -> None:
    """Write the tables as a new version below path, then its manifest. sources are content hashes (fingerprint) of the tables that these were
    prepared from. Without overwrite a bundle that exists is an error; versions before the last one are deleted once the new one can be read,
    so that a reader who has begun finishes.
    All files go through Spark's writers, so any store that Spark can write will do."""
    if not tables:
        raise ValueError("there is nothing to save")
    spark = next(iter(tables.values())).sparkSession
    before = _manifests(spark, path)
    if before and not overwrite:
        raise FileExistsError(f"{path} holds a bundle")
    version, hashes = f"version-{uuid.uuid4().hex}", {}
    for name, df in tables.items():
        df.write.parquet(f"{path}/{version}/{name}")
        hashes[name] = fingerprint(spark.read.parquet(f"{path}/{version}/{name}"))
    body = {"version": VERSION, "folder": version, "tables": hashes, "metadata": dict(metadata or {}), "sources": dict(sources or {})}
    row = spark.range(1).select(F.lit("manifest").alias("kind"), F.lit(json.dumps(body, sort_keys=True)).alias("body"))
    row.coalesce(1).write.json(f"{path}/manifests/{(before[-1] if before else 0) + 1}")
    for n in before[:-1]:
        old = _body(spark, path, n)["folder"]
        for gone in (f"{path}/manifests/{n}", f"{path}/{old}"):
            files, where = _files(spark, gone)
            files.delete(where, True)


def _body(spark: SparkSession, path: str, number: int) -> dict:
    return json.loads(spark.read.schema("kind string, body string").json(f"{path}/manifests/{number}").first()["body"])


def load(spark: SparkSession, path: str, *, verify: bool = True, sources: Mapping[str, DataFrame] | None = None) -> tuple[dict[str, DataFrame], dict]:
    """The tables and metadata of a bundle. A table whose content hash differs is an error, and so is one of sources that is not what the bundle was
    prepared from: the bundle is stale."""
    found = _manifests(spark, path)
    if not found:
        raise FileNotFoundError(f"{path} holds no complete bundle")
    body = _body(spark, path, found[-1])
    if body["version"] != VERSION:
        raise ValueError(f"unknown version {body['version']}")
    for name, df in (sources or {}).items():
        if fingerprint(df) != body["sources"].get(name):
            raise ValueError(f"the bundle was not prepared from this {name}")
    tables = {name: spark.read.parquet(f"{path}/{body['folder']}/{name}") for name in body["tables"]}
    if verify:
        for name, df in tables.items():
            if fingerprint(df) != body["tables"][name]:
                raise ValueError(f"table {name} is not what was saved")
    return tables, body["metadata"]
