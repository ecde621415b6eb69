"""Stages whose tables are kept and used again: each has a manifest with a fingerprint of its inputs and settings.

A source is known by its rows: their number and the sum of their hashes. The tables of a stage are known by the fingerprint of the stage,
which is made from its name, its settings and the fingerprints of its inputs. A stage whose manifest has its fingerprint is read; any other
is run: its manifest goes first, its tables are written over, and the new manifest is moved into its place when all of them are there. So a
change reruns what depends on it and nothing else, and a run that was cut short leaves nothing that looks finished.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Table:
    df: DataFrame
    fingerprint: str


def rows_fingerprint(df: DataFrame) -> str:
    """Of schema and rows, whatever their order: one pass over the rows."""
    columns = sorted(df.columns)
    row = F.xxhash64(*(F.col(f"`{c}`") for c in columns)) if columns else F.lit(0)
    n, total = df.select(row.alias("h")).agg(F.count("*"), F.sum(F.col("h").cast("decimal(20,0)"))).first()
    return _digest([[c, df.schema[c].dataType.simpleString()] for c in columns], n, str(total))


def _digest(*parts: object) -> str:
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()


class Store:
    """Stages under one folder, a folder for each."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        #: names of the stages that were run, in order; the others were read
        self.ran: list[str] = []

    def source(self, df: DataFrame) -> Table:
        return Table(df, rows_fingerprint(df))

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def manifest(self, name: str) -> dict | None:
        path, fs = self._path(f"{self.root}/{name}/_manifest.json")
        if not fs.exists(path):
            return None
        stream = fs.open(path)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, name: str, manifest: dict) -> None:
        """The manifest is written beside its place and moved there, which is one step."""
        (draft, fs), (path, _) = self._path(f"{self.root}/{name}/_draft.json"), self._path(f"{self.root}/{name}/_manifest.json")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(manifest, indent=1, sort_keys=True).encode()))
        out.close()
        if not fs.rename(draft, path):
            raise OSError(f"the manifest of {name} could not be moved to its place")

    def stage(self, name: str, run: Callable[..., dict[str, DataFrame]], inputs: dict[str, Table], settings: dict | None = None, write: Callable[[dict[str, DataFrame]], None] | None = None) -> dict[str, Table]:
        """The tables that run(**inputs) gives, by name, read from the store. `write` puts them at root/name/table, if Parquet there is not enough."""
        fingerprint = _digest(name, settings or {}, {k: t.fingerprint for k, t in inputs.items()})
        found = self.manifest(name)
        if found is None or found["fingerprint"] != fingerprint:
            path, fs = self._path(f"{self.root}/{name}/_manifest.json")
            if fs.exists(path):
                fs.delete(path, False)
            tables = run(**{k: t.df for k, t in inputs.items()})
            if write:
                write(tables)
            else:
                for table, df in tables.items():
                    df.write.mode("overwrite").parquet(f"{self.root}/{name}/{table}")
            found = {"fingerprint": fingerprint, "tables": sorted(tables), "settings": settings or {}, "inputs": {k: t.fingerprint for k, t in inputs.items()}}
            self._commit(name, found)
            self.ran.append(name)
        return {t: Table(self.spark.read.parquet(f"{self.root}/{name}/{t}"), _digest(fingerprint, t)) for t in found["tables"]}
