"""Size-tiered compaction: small immutable shards, merged by size into target-sized files under a versioned manifest."""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barlight.llm.common import fresh_path, maybe_broadcast, tidy

#: Runs that one job merges, a task each.
JOB_RUNS = 64
#: Versions that readers replay at most behind a whole listing.
MOST_TAIL = 50


@dataclass(frozen=True)
class Shard:
    path: str
    bytes: int
    rows: int
    level: int  # merges that it went through


def own_name(names: list[str], stem: str) -> str:
    """A column name that the table doesn't have."""
    taken = {n.lower() for n in names}
    return next(x for k in range(len(names) + 1) if (x := f"{stem}_{k}") not in taken)


class ShardTable:
    """Parquet shards under a folder; `_manifest/<version>.json` has what each version adds and removes.

    A version appears by one rename that fails if another writer took the number, so readers see all of a commit
    or none; shards are never changed. A version that follows MOST_TAIL others, or as many changed entries as the
    table has shards, lists them whole, so that readers replay a bounded tail and writers write little more than changed.
    Entries are a line a file, not rows, and with the schema are the driver's only data. Tables may be empty and may
    have columns of any names; null, empty and long values and equal rows are rows like others.
    """

    def __init__(self, spark: SparkSession, path: str, target: int = 64 << 20, fanout: int = 4):
        self.spark, self.path, self.target, self.fanout = spark, path.rstrip("/"), target, fanout
        self._fs = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self._fs.Path(path)
        return p, p.getFileSystem(self._conf)

    def versions(self) -> list[int]:
        p, store = self._at(f"{self.path}/_manifest")
        names = [x.getPath().getName() for x in store.listStatus(p)] if store.exists(p) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _entry(self, version: int) -> dict:
        p, store = self._at(f"{self.path}/_manifest/{version:08d}.json")
        stream = store.open(p)
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def _replayed(self, version: int | None) -> tuple[int, dict[str, Shard], str | None, int, int]:
        """Version, shards by path, schema, and the entries and versions since the last whole listing."""
        version = max(self.versions(), default=0) if version is None else version
        tail, schema, changed = [], None, 0
        for v in range(version, 0, -1):
            entry = self._entry(v)
            schema = schema or entry["schema"]
            tail.append(entry)
            if entry["whole"]:
                break
            changed += len(entry["add"]) + len(entry["remove"])
        shards: dict[str, Shard] = {}
        for entry in reversed(tail):
            for path in entry["remove"]:
                del shards[path]
            shards |= {x["path"]: Shard(**x) for x in entry["add"]}
        return version, shards, schema, changed, len(tail)

    def manifest(self, version: int | None = None) -> tuple[int, list[Shard]]:
        """The given or newest version (0 if there is none) and its shards."""
        version, shards, *_ = self._replayed(version)
        return version, list(shards.values())

    def schema(self, version: int | None = None) -> T.StructType | None:
        found = self._replayed(version)[2]
        return T.StructType.fromJson(json.loads(found)) if found else None

    def commit(self, base: int, add: list[Shard], remove: list[str] = (), schema: T.StructType | None = None) -> int:
        """Publishes version base + 1 with shards added and removed; FileExistsError if another writer has."""
        _, shards, known, changed, tail = self._replayed(base)
        entry = {"schema": schema.json() if schema else known, "whole": False, "add": [asdict(s) for s in add], "remove": list(remove)}
        if tail >= MOST_TAIL or changed + len(add) + len(remove) > len(shards):
            gone = set(remove)
            entry |= {"whole": True, "add": [asdict(s) for s in [*(s for s in shards.values() if s.path not in gone), *add]], "remove": []}
        _, store = self._at(self.path)
        new, draft = f"{self.path}/_manifest/{base + 1:08d}.json", f"{self.path}/_manifest/{uuid.uuid4().hex}.draft"
        out = store.create(self._fs.Path(draft), False)
        try:
            out.write(bytearray(json.dumps(entry).encode()))
        finally:
            out.close()
        context = self._fs.FileContext.getFileContext(self._fs.Path(new).toUri(), self._conf)
        if store.exists(self._fs.Path(new)):
            store.delete(self._fs.Path(draft), False)
            raise FileExistsError(new)
        context.rename(self._fs.Path(draft), self._fs.Path(new), self.spark._sc._gateway.new_array(self._fs.Options.Rename, 0))
        return base + 1

    def _listed(self, folder: str, level: int) -> dict[str, list[Shard]]:
        """Shards below a folder by the name of their parent folder."""
        p, store = self._at(folder)
        files, found = store.listFiles(p, True), []
        while files.hasNext():
            f = files.next()
            if f.getPath().getName().endswith(".parquet"):
                found.append((f.getPath().toString(), f.getLen()))
        if not found:
            return {}
        counted = self.spark.read.parquet(*[x for x, _ in found]).groupBy(F.input_file_name().alias("f")).count().collect()  # a row a file
        tail = lambda x: tuple(x.rsplit("/", 2)[1:])
        rows = {tail(r.f.replace("%3D", "=")): r["count"] for r in counted}
        out: dict[str, list[Shard]] = {}
        for path, size in sorted(found):
            out.setdefault(tail(path)[0], []).append(Shard(path, size, rows.get(tail(path), 0), level))
        return out

    def append(self, df: DataFrame, arrival: str | None = None) -> list[int]:
        """Writes df as small shards, a commit for each value of the column `arrival` (dropped) or for all; the versions.
        An empty df is a commit without shards, which keeps its schema."""
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        (df.write.partitionBy(arrival) if arrival else df.write).parquet(folder)
        schema, out = df.drop(arrival).schema if arrival else df.schema, []
        for _, shards in sorted(self._listed(folder, 0).items()) or [("", [])]:
            out.append(self.commit(max(self.versions(), default=0), [s for s in shards if s.rows], schema=schema))
        return out

    def tier(self, s: Shard) -> int:
        return int(math.log(max(s.bytes, 1), self.fanout))

    def runs(self, shards: list[Shard]) -> list[list[Shard]]:
        """Shards to merge: of one size tier and below half the target, in runs of at least `fanout` up to the target."""
        tiers: dict[int, list[Shard]] = {}
        for s in shards:
            if s.bytes < self.target / 2:
                tiers.setdefault(self.tier(s), []).append(s)
        out = []
        for _, own in sorted(tiers.items()):
            run: list[Shard] = []
            for s in own:
                if run and sum(x.bytes for x in run) + s.bytes > self.target:
                    out.append(run)
                    run = []
                run.append(s)
            out.append(run)
        return [r for r in out if len(r) >= self.fanout]

    def _merged(self, runs: list[list[Shard]]) -> list[Shard]:
        """One new shard for each run, by one job with a task a run; nothing is shuffled."""
        folder, schema = f"{self.path}/data/{uuid.uuid4().hex}", self.schema()
        run = own_name(schema.names, "run")
        parts = [self.spark.read.schema(schema).parquet(*[s.path for s in r]).coalesce(1).withColumn(run, F.lit(k)) for k, r in enumerate(runs)]
        reduce(DataFrame.union, parts).write.partitionBy(run).parquet(folder)
        new = [s for _, own in sorted(self._listed(folder, 1 + max(s.level for r in runs for s in r)).items()) for s in own]
        merged, old = sum(s.rows for s in new), sum(s.rows for r in runs for s in r)
        if merged != old:
            raise RuntimeError(f"merged {merged} rows of {old}")
        return new

    def compact(self) -> int:
        """Merges until no tier has a run to merge; the newest version. All merges of a round are one commit, and the
        rounds are logarithmic in the number of shards."""
        while True:
            base, shards = self.manifest()
            runs = self.runs(shards)
            if not runs:
                return base
            new = [s for k in range(0, len(runs), JOB_RUNS) for s in self._merged(runs[k : k + JOB_RUNS])]
            self.commit(base, new, [s.path for r in runs for s in r])

    def vacuum(self, keep: int = 1) -> int:
        """Deletes shards that none of the newest `keep` versions lists; the number of files."""
        versions = self.versions()
        alive = {s.path for v in versions[-keep:] for s in self.manifest(v)[1]}
        old = {x["path"] for v in versions for x in self._entry(v)["add"]} - alive
        deleted = 0
        for path in sorted(old):
            p, store = self._at(path)
            deleted += store.delete(p, False)
        return deleted

    def read(self, version: int | None = None, place: str | None = None) -> DataFrame:
        """Rows of a version; with `place` also a struct of that name: shard (the file's number in the manifest) and
        merges. A table without rows has its schema; FileNotFoundError where there is no version at all."""
        version, shards = self.manifest(version)
        schema = self.schema(version)
        if schema is None:
            raise FileNotFoundError(f"{self.path} has no version")
        if place is not None and place.lower() in {n.lower() for n in schema.names}:
            raise ValueError(f"the table has a column {place}")
        rows = self.spark.read.schema(schema).parquet(*[s.path for s in shards]) if shards else self.spark.createDataFrame([], schema)
        if place is None:
            return rows
        # files are joined by the end of their path
        tail = lambda x: F.regexp_replace(F.substring_index(x, "/", -2), "%3D", "=")
        file = own_name(schema.names, "file")
        listing = [("/".join(s.path.rsplit("/", 2)[1:]), k, s.level) for k, s in enumerate(shards)]
        places = self.spark.createDataFrame(listing, "f string, shard int, merges int").select(F.col("f").alias(file), F.struct("shard", "merges").alias(place))
        return rows.withColumn(file, tail(F.input_file_name())).join(maybe_broadcast(places, len(shards)), file).drop(file)


@tidy
def op6_size_tiered_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents through twelve arrivals and a compaction: doc_id, text_sha256, and the shard that holds the row."""
    table = ShardTable(spark, fresh_path(spark, "shards"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    arrival, place = own_name(docs.columns, "arrival"), own_name(docs.columns, "place")
    table.append(docs.withColumn(arrival, F.pmod(F.xxhash64("doc_id"), F.lit(12))), arrival)
    version = table.compact()
    table.vacuum()
    return table.read(place=place).select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"),
                                          F.col(f"{place}.shard").alias("shard"), F.col(f"{place}.merges").alias("merges"), F.lit(version).alias("version"))


QUERIES = {"op6_size_tiered_compaction": op6_size_tiered_compaction}
ORACLES: dict[str, str] = {}
