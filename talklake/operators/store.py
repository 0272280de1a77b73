"""Tables kept in buckets of files under a manifest: only touched buckets are read and replaced, all at once.

A generation is written into folders whose names nobody has used, and becomes visible by the rename of its manifest. A
writer that dies leaves folders that no manifest names; they are in nobody's way, and sweep() deletes them. Manifests are
numbered and never overwritten: of two writers over the same generation, the rename of the second fails.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import children, publish_text, read_text, remove


class Conflict(RuntimeError):
    """Another writer has published since this one read the manifest."""


class BucketStore:
    """Base of the stores: numbered manifests, hashed buckets, paths of generations.

    parts: kind -> bucket -> paths that hold its rows now. The number of buckets follows the rows: it doubles when
    the rows of a bucket pass BUCKET_ROWS on average. Doubling moves no file; the files of a bucket then serve both halves
    until these are next replaced.
    """

    BUCKET_ROWS = 200_000
    #: Manifests kept for readers of older generations.
    KEPT = 3

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int | None = None):
        self.spark, self.path, self.keys, self.wanted = spark, path.rstrip("/"), keys, buckets
        m = self._last()
        self.generation: int = m.get("generation", 0)
        self.buckets: int = m.get("buckets", 0)
        self.held: int = m.get("rows", 0)
        self.schemas: dict[str, str] = m.get("schemas", {})
        self.parts: dict[str, dict[str, list[str]]] = m.get("parts", {})

    def _manifests(self) -> list[str]:
        return [n for n in children(self.spark, f"{self.path}/manifests") if n.endswith(".json")]

    def _last(self) -> dict:
        names = self._manifests()
        return json.loads(read_text(self.spark, f"{self.path}/manifests/{names[-1]}") or "{}") if names else {}

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def plan_buckets(self, rows: int) -> None:
        """Number of buckets for `rows` more rows than the store has."""
        self.held += rows
        if not self.buckets:
            most = self.wanted or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            self.buckets = 1 << max(0, (most - 1).bit_length())
        while self.held > self.buckets * self.BUCKET_ROWS:
            for kind, by in self.parts.items():
                self.parts[kind] = by | {str(int(b) + self.buckets): paths for b, paths in by.items()}
            self.buckets *= 2

    def read(self, kind: str, buckets: list[int] | None = None) -> DataFrame | None:
        """Rows of the buckets, or of all, as of the generation at hand; None if there are none."""
        by = self.parts.get(kind, {})
        chosen = [int(b) for b in by] if buckets is None else [b for b in buckets if str(b) in by]
        paths = sorted({p for b in chosen for p in by[str(b)]})
        if not paths:
            return None
        # a path from when there were fewer buckets holds rows of others too, some of which may have been replaced since
        coarse = {p for p in paths if int(p.rsplit("-of-", 1)[1].split("/")[0]) != self.buckets}
        fine = [p for p in paths if p not in coarse]
        out = self.read_paths(kind, fine) if fine else None
        for p in sorted(coarse):
            mine = [b for b in chosen if p in by[str(b)]]
            part = self.read_paths(kind, [p]).where(self.bucket().isin(mine))
            out = part if out is None else out.unionByName(part)
        return out

    def read_paths(self, kind: str, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schemas[kind]).parquet(*paths)

    def write(self, df: DataFrame, kind: str, replace: bool, placed: bool = False) -> list[int]:
        """Write df into its buckets and return those that got rows; their old rows are replaced or kept beside.

        Unless df is placed by bucket already, its rows are moved so that a bucket has few files; a large one is split.
        """
        home = f"{self.path}/{kind}/{self.generation + 1:08d}-{uuid.uuid4().hex[:10]}-of-{self.buckets}"
        self.schemas[kind] = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
        df = df.withColumn("_bucket", self.bucket())
        (df if placed else df.hint("rebalance", "_bucket")).write.partitionBy("_bucket").parquet(home)
        got = [int(n.split("=")[1]) for n in children(self.spark, home) if n.startswith("_bucket=")]
        by = self.parts.setdefault(kind, {})
        for b in got:
            by[str(b)] = [*([] if replace else by.get(str(b), [])), f"{home}/_bucket={b}"]
        return got

    def forget(self, kind: str, buckets: list[int]) -> None:
        """Leave the buckets' rows out of the next generation."""
        for b in buckets:
            self.parts.get(kind, {}).pop(str(b), None)

    def files(self, kind: str) -> dict[int, list[str]]:
        return {int(b): paths for b, paths in self.parts.get(kind, {}).items()}

    def publish(self) -> None:
        """Make what was written the state; Conflict if another writer was faster, and nothing has changed then."""
        fields = {"generation": self.generation + 1, "buckets": self.buckets, "rows": self.held, "schemas": self.schemas, "parts": self.parts}
        if not publish_text(self.spark, f"{self.path}/manifests/{self.generation + 1:08d}.json", json.dumps(fields)):
            raise Conflict(f"generation {self.generation} of {self.path} isn't the last one any more")
        self.generation += 1

    def sweep(self) -> int:
        """Delete old manifests and folders that none of the kept ones names. Not while another writer is at work."""
        names = self._manifests()
        kept = [json.loads(read_text(self.spark, f"{self.path}/manifests/{n}") or "{}") for n in names[-self.KEPT :]]
        used = {p.rsplit("/", 1)[0] for m in kept for by in m["parts"].values() for paths in by.values() for p in paths}
        gone = 0
        for n in names[: -self.KEPT]:
            remove(self.spark, f"{self.path}/manifests/{n}")
        for kind in {k for m in kept for k in m["parts"]}:
            for n in children(self.spark, f"{self.path}/{kind}"):
                if f"{self.path}/{kind}/{n}" not in used:
                    remove(self.spark, f"{self.path}/{kind}/{n}")
                    gone += 1
        return gone

    def drop(self) -> None:
        remove(self.spark, self.path)
