"""Versioned snapshots of tables: written whole, committed at once, checked when read.

A snapshot is a folder of Parquet tables and a manifest with its version and
each table's row count and checksum. Data is written first; the manifest is
renamed into place last, and only if no other writer has taken its version.
A writer names the version it started from, so of two writers one wins.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Manifests of these formats can be read.
FORMAT, READABLE = 1, (1,)


class SnapshotError(RuntimeError):
    """A snapshot that is missing, torn, of an unknown format, or older than asked for."""


class StaleWrite(SnapshotError):
    """The snapshot that a writer started from is no longer the last."""


@dataclass(frozen=True)
class Table:
    path: str
    rows: int
    checksum: str


@dataclass(frozen=True)
class Manifest:
    version: int
    format: int
    built_at: str
    tables: dict[str, Table]


def _metrics(columns: list[str]) -> list[Column]:
    """Row count and a checksum that does not depend on the order of rows."""
    return [F.count(F.lit(1)).alias("rows"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).alias("checksum")]


def _files(spark: SparkSession, root: str):
    """(file context, path class) for the file system of root."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    uri = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toUri()
    return jvm.org.apache.hadoop.fs.FileContext.getFileContext(uri, spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def versions(spark: SparkSession, root: str) -> list[int]:
    """Committed versions, in order."""
    files, path = _files(spark, root)
    folder = path(f"{root}/manifests")
    if not files.util().exists(folder):
        return []
    names = [s.getPath().getName() for s in files.util().listStatus(folder)]
    return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json") and n[1:-5].isdigit())


def publish(spark: SparkSession, tables: dict[str, DataFrame], root: str, based_on: int, built_at: str) -> Manifest:
    """Write the tables as version based_on + 1 and commit it; 0 is the version before the first.

    Counts and checksums are gathered in the pass that writes. StaleWrite is
    raised, and what was written deleted, where `based_on` is not the last
    version, before or after writing.
    """
    _require_last(spark, root, based_on)
    version, folder = based_on + 1, f"{root}/data/v{based_on + 1}-{uuid.uuid4().hex}"
    found = {}
    for name, rows in tables.items():
        seen = Observation()
        rows.observe(seen, *_metrics(rows.columns)).write.parquet(f"{folder}/{name}")
        found[name] = Table(f"{folder}/{name}", int(seen.get["rows"]), str(seen.get["checksum"]))
    manifest = Manifest(version, FORMAT, built_at, found)
    files, path = _files(spark, root)
    try:
        _commit(spark, root, manifest)
    except StaleWrite:
        files.delete(path(folder), True)
        raise
    return manifest


def _require_last(spark: SparkSession, root: str, based_on: int) -> None:
    last = (versions(spark, root) or [0])[-1]
    if last != based_on:
        raise StaleWrite(f"version {based_on} is not the last: {last} is")


def _commit(spark: SparkSession, root: str, manifest: Manifest) -> None:
    """Put the manifest in place, unless its version is taken."""
    jvm, (files, path) = spark._jvm, _files(spark, root)
    folder, draft = path(f"{root}/manifests"), path(f"{root}/manifests/.{uuid.uuid4().hex}")
    files.mkdir(folder, None, True)
    flags = jvm.java.util.EnumSet.of(jvm.org.apache.hadoop.fs.CreateFlag.CREATE)
    out = files.create(draft, flags, spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.CreateOpts, 0))
    out.write(json.dumps(asdict(manifest), sort_keys=True).encode())
    out.hsync()
    out.close()
    none = spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    none[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    try:
        files.rename(draft, path(f"{root}/manifests/v{manifest.version}.json"), none)
    except Exception as e:
        files.delete(draft, False)
        if "FileAlreadyExistsException" in str(e):
            raise StaleWrite(f"version {manifest.version} was committed by another writer") from e
        raise


def manifest_of(spark: SparkSession, root: str, version: int | None = None) -> Manifest:
    """The manifest of a version, or of the last."""
    known = versions(spark, root)
    if not known or version is not None and version not in known:
        raise SnapshotError(f"no version {version or ''} in {root}")
    text = spark.read.text(f"{root}/manifests/v{version or known[-1]}.json", wholetext=True).first()[0]
    try:
        raw = json.loads(text)
        found = Manifest(raw["version"], raw["format"], raw["built_at"], {n: Table(**t) for n, t in raw["tables"].items()})
    except (ValueError, KeyError, TypeError) as e:
        raise SnapshotError(f"unreadable manifest of version {version or known[-1]}") from e
    if found.format not in READABLE:
        raise SnapshotError(f"format {found.format} is not one of {READABLE}")
    return found


def load(spark: SparkSession, root: str, version: int | None = None, at_least: int = 0, verify: bool = True) -> tuple[Manifest, dict[str, DataFrame]]:
    """The manifest and tables of a version, or of the last.

    SnapshotError is raised for a version below `at_least`, so that a reader
    never goes back, and with `verify` for a table whose rows or checksum
    differ from the manifest; that is one pass over each table.
    """
    manifest = manifest_of(spark, root, version)
    if manifest.version < at_least:
        raise SnapshotError(f"version {manifest.version} is older than {at_least}")
    tables = {}
    for name, table in manifest.tables.items():
        try:
            rows = spark.read.parquet(table.path)
            if verify:
                found = rows.agg(*_metrics(rows.columns)).first()
                if (found["rows"], str(found["checksum"])) != (table.rows, table.checksum):
                    raise SnapshotError(f"table {name} of version {manifest.version} is torn: {found['rows']} rows for {table.rows}")
        except SnapshotError:
            raise
        except Exception as e:
            raise SnapshotError(f"table {name} of version {manifest.version} cannot be read") from e
        tables[name] = rows
    return manifest, tables
