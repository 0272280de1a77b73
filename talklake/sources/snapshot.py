"""Snapshots of tables as gzipped JSON lines with a manifest, and the read-only SQL door."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.publish import merge_plan, merge_snapshot
from ..session import read_text, write_text

#: Version of the manifests that are written and read.
VERSION = 1

_READ = re.compile(r"^(?:\s|--[^\n]*\n|/\*[\s\S]*?\*/)*(select|with|explain|show|describe)\b", re.I)


def export(spark: SparkSession, tables: dict[str, DataFrame], path: str, shard_bytes: int = 64 << 20) -> dict:
    """Write each table as gzipped shards of about shard_bytes of JSON at most, and publish the manifest last.

    The folder of a table's shards is new for every export, so a reader of the old manifest keeps its files.
    """
    manifest: dict = {"version": VERSION, "tables": {}}
    generation = uuid.uuid4().hex[:10]
    for name, df in tables.items():
        at = f"{path}/generations/{generation}/{name}"
        line = F.to_json(F.struct(*[F.col(c) for c in df.columns]), {"ignoreNullFields": "false"})
        size = df.agg(F.max(F.octet_length(line)).alias("most"), F.avg(F.octet_length(line)).alias("mean"), F.count(F.lit(1)).alias("rows")).first()
        each = max(1, int(shard_bytes / max(1.0, float(size["mean"] or 1))))
        df.write.option("compression", "gzip").option("maxRecordsPerFile", each).option("ignoreNullFields", "false").json(at)
        manifest["tables"][name] = {"rows": size["rows"], "schema": ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), "path": f"generations/{generation}/{name}"}
    write_text(spark, f"{path}/manifest.json", json.dumps(manifest))
    return manifest


def read_manifest(spark: SparkSession, path: str) -> dict:
    """The published manifest; a missing one, another version, or paths that lead out of the snapshot or clash are errors."""
    text = read_text(spark, f"{path}/manifest.json")
    if text is None:
        raise ValueError("no manifest")
    manifest = json.loads(text)
    if manifest.get("version") != VERSION:
        raise ValueError(f"version {manifest.get('version')} isn't known")
    paths = [t["path"] for t in manifest["tables"].values()]
    if len(set(paths)) != len(paths) or any(p.startswith("/") or ".." in p.split("/") for p in paths):
        raise ValueError("paths of tables clash or lead out of the snapshot")
    return manifest


def load(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table of a published snapshot; unreadable lines fail the read."""
    tables = read_manifest(spark, path)["tables"]
    if name not in tables:
        raise ValueError(f"no published table {name}")
    return spark.read.schema(tables[name]["schema"]).option("mode", "FAILFAST").json(f"{path}/{tables[name]['path']}")


def import_tables(spark: SparkSession, path: str, local: dict[str, DataFrame], keys: dict[str, list[str]], previous: dict | None = None, replace: bool = False) -> dict[str, DataFrame]:
    """The local tables after taking in a snapshot. Tables that its manifest leaves as they were aren't read.

    replace: a table is the snapshot's, but for local-only rows of guild `@me`. Otherwise rows are merged by their keys,
    the later revision first; tables without keys only get the rows they don't have. Columns that one side lacks are null.
    """
    manifest = read_manifest(spark, path)
    out = dict(local)
    for name, what in merge_plan(previous, manifest).items():
        if what == "skip":
            continue
        new, old = load(spark, path, name), local.get(name)
        if old is None:
            out[name] = new
        elif replace:
            mine = old.where("guild_id = '@me'") if "guild_id" in old.columns else old.limit(0)
            out[name] = new.unionByName(mine, allowMissingColumns=True)
        else:
            names = list(dict.fromkeys([*old.columns, *new.columns]))
            types = {f.name: f.dataType for f in [*old.schema, *new.schema]}
            wide = lambda df: df.select(*[F.col(c) if c in df.columns else F.lit(None).cast(types[c]).alias(c) for c in names])
            out[name] = merge_snapshot(wide(old), wide(new), keys[name]).drop("kept") if name in keys else wide(old).unionByName(wide(new)).distinct()
    return out


def read_only_sql(spark: SparkSession, query: str, most: int = 50_000) -> DataFrame:
    """Result of a reading statement over registered views; other statements and results above `most` rows are errors."""
    if not _READ.match(query):
        raise ValueError("only select, with, explain, show and describe are allowed")
    df = spark.sql(query)
    if df.limit(most + 1).count() > most:
        raise ValueError(f"the result has more than {most} rows")
    return df
