"""A versioned store on Parquet: immutable segments and a manifest that names the live ones.

    store/segments/000001/*.parquet     rows (key, ts, op, value), sorted by key, then ts descending
    store/manifest/000001.json          one line of JSON for each live segment

A manifest version is written under a temporary name and renamed: that is the commit point, so a reader sees
all of a flush or compaction or none of it, and files that no manifest names are ignored. One writer.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import compaction
from ..operators.snapshot import merged


class SegmentStore:
    """Flush, read and compact segments under a path that the driver and all executors share."""

    def __init__(self, spark: SparkSession, path: str, trigger: int = compaction.TRIGGER):
        self.spark, self.path, self.trigger = spark, path.rstrip("/"), max(2, trigger)
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.path}/manifest"))

    def _versions(self) -> list[int]:
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path(f"{self.path}/manifest"))]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> list[dict]:
        """Live segments, oldest first; an earlier version of the manifest can be asked for."""
        known = self._versions()
        if not known:
            return []
        source = self._fs.open(self._path(f"{self.path}/manifest/{version or known[-1]:06d}.json"))
        try:
            text = bytes(source.readAllBytes()).decode()
        finally:
            source.close()
        return [json.loads(x) for x in text.splitlines()]

    def _commit(self, entries: list[dict]) -> int:
        version = (self._versions() or [0])[-1] + 1
        temporary, final = (self._path(f"{self.path}/manifest/{n}") for n in (f"_{version:06d}.tmp", f"{version:06d}.json"))
        sink = self._fs.create(temporary, True)
        sink.write(bytearray("\n".join(json.dumps(e, sort_keys=True) for e in entries).encode()))
        sink.close()
        if not self._fs.rename(temporary, final):
            raise OSError(f"manifest {version} exists: another writer committed it")
        return version

    def _write(self, rows: DataFrame, folder: str) -> dict:
        path = f"{self.path}/segments/{folder}"
        rows.repartitionByRange("key").sortWithinPartitions("key", F.desc("ts")).write.option("parquet.bloom.filter.enabled#key", "true").parquet(path)
        stats = self.spark.read.parquet(path).agg(F.count("*"), F.min("ts"), F.max("ts")).first()
        return {"folder": folder, "n_rows": stats[0], "min_ts": stats[1], "max_ts": stats[2]}

    def flush(self, rows: DataFrame, applied_index: int = 0) -> int:
        """Add rows as the newest segment; returns its id."""
        live = self.manifest()
        new = max((e["id"] for e in live), default=0) + 1
        entry = {"id": new, "applied_index": applied_index} | self._write(rows, f"{new:06d}-{len(self._versions()):06d}")
        self._commit([*live, entry])
        return new

    def _rows(self, entry: dict) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/segments/{entry['folder']}")

    def read(self, snapshot: int | None = None) -> DataFrame:
        """All versions; segments that begin after the snapshot are not opened."""
        live = [e for e in reversed(self.manifest()) if snapshot is None or e["min_ts"] is None or e["min_ts"] <= snapshot]
        if not live:
            return self.spark.createDataFrame([], "key binary, ts bigint, op int, value binary")
        return merged(*map(self._rows, live)).drop("layer")

    def compact(self, watermark: int) -> list[int]:
        """Merge the oldest segments while there are `trigger` or more; returns the ids that were merged."""
        done: list[int] = []
        while len(live := self.manifest()) >= self.trigger:
            inputs, rest = live[: self.trigger], live[self.trigger :]
            rows = compaction.compacted([self._rows(e) for e in reversed(inputs)], watermark, bottom=True)
            out = max(e["id"] for e in inputs)
            kept = {k: next((e[k] for e in reversed(inputs) if e.get(k)), None) for k in ("members", "sessions")}
            entry = {"id": out, "applied_index": max(e["applied_index"] for e in inputs)} | kept | self._write(rows, f"{out:06d}-{len(self._versions()):06d}")
            self._commit([entry, *rest])
            done += [e["id"] for e in inputs]
        return done

    def replace(self, rows: DataFrame, applied_index: int, sessions: DataFrame | None = None, members: list[int] | None = None) -> None:
        """Install a snapshot: its rows are all there is from now on, so deletes need no tombstones. The session
        table (session, last_seq) and the voters of the snapshot come with it, under the same manifest."""
        new = max((e["id"] for e in self.manifest()), default=0) + 1
        folder = f"{new:06d}-{len(self._versions()):06d}"
        entry = {"id": new, "applied_index": applied_index, "members": members, "sessions": None} | self._write(rows, folder)
        if sessions is not None:
            entry["sessions"] = folder
            sessions.select("session", "last_seq").write.parquet(f"{self.path}/sessions/{folder}")
        self._commit([entry])

    def _installed(self) -> dict:
        return next((e for e in reversed(self.manifest()) if e.get("sessions") or e.get("members")), {})

    def sessions(self) -> DataFrame:
        """The session table that the newest installed snapshot brought."""
        if folder := self._installed().get("sessions"):
            return self.spark.read.parquet(f"{self.path}/sessions/{folder}")
        return self.spark.createDataFrame([], "session bigint, last_seq bigint")

    def members(self) -> list[int] | None:
        """The voters that the newest installed snapshot brought."""
        return self._installed().get("members")
