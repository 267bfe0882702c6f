"""An immutable, versioned lake of bars: staged writes, a manifest per generation, pinned snapshots.

Data files never change.  A generation is a manifest (JSON) that lists files,
row counts and the fingerprints of the sources they came from; publishing one
is a rename, so readers see whole generations only.  All file operations go
through Hadoop's file systems, so any store that Spark reads will do.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickforge.operators import scan

SCHEMA = "timestamp long, symbol string, open double, high double, low double, close double, volume long, year short, month byte, bucket short"


class Lake:
    def __init__(self, spark: SparkSession, root: str, buckets: int = 64, rows_per_file: int = 1_000_000):
        self.spark, self.root, self.buckets, self.rows_per_file = spark, root.rstrip("/"), buckets, rows_per_file
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(name)

    def _write(self, name: str, text: str) -> None:
        """Write beside the target, then rename: never a half-written manifest."""
        part = self._path(f"{self.root}/manifests/.{uuid.uuid4().hex}")
        out = self._fs.create(part, False)
        out.write(bytearray(text.encode()))
        out.close()
        if not self._fs.rename(part, self._path(f"{self.root}/manifests/{name}")):
            self._fs.delete(part, False)
            raise RuntimeError(f"{name} exists: another writer committed first")

    def snapshot(self, generation: int | None = None) -> dict:
        """A manifest; the latest by default, generation 0 being the empty lake."""
        folder = self._path(f"{self.root}/manifests")
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        known = sorted(int(n[4:-5]) for n in names if n.startswith("gen-"))
        if generation is None:
            generation = known[-1] if known else 0
        if generation == 0:
            return {"generation": 0, "files": [], "sources": {}}
        text = self.spark.read.text(f"{self.root}/manifests/gen-{generation:08d}.json", wholetext=True).first()[0]
        return json.loads(text)

    @staticmethod
    def fingerprint(bars: DataFrame) -> str:
        """Order-free content hash: sums of row hashes, computed where the rows are."""
        a, b = (F.xxhash64(F.lit(k), *sorted(bars.columns)) for k in (1, 2))
        row = bars.agg(F.count("*").alias("n"), F.sum(a.cast("decimal(38,0)")).alias("a"), F.sum(b.cast("decimal(38,0)")).alias("b")).first()
        return hashlib.sha256(f"{sorted(bars.columns)}|{row.n}|{row.a}|{row.b}".encode()).hexdigest()

    def ingest(self, bars: DataFrame, *more: DataFrame) -> dict:
        """Add sources in one generation; known ones (by fingerprint) are skipped.

        Bad rows, duplicate keys and keys that the lake has are errors, and
        nothing is published.
        """
        now = self.snapshot()
        sources = dict(now["sources"])
        fresh = []
        for source in (bars, *more):
            mark = self.fingerprint(source)
            if mark not in sources:
                fresh.append(scan.normalise(source, self.buckets))
                sources[mark] = now["generation"] + 1
        if not fresh:
            return now
        rows = fresh[0]
        for other in fresh[1:]:
            rows = rows.unionByName(other)
        stage = f"{self.root}/bars/ingestion-{uuid.uuid4().hex}"
        rows.repartition("year", "month", "bucket").sortWithinPartitions("timestamp", "symbol").write.option("compression", "zstd").option("maxRecordsPerFile", self.rows_per_file).partitionBy("year", "month", "bucket").parquet(stage)
        try:
            staged = self.spark.read.schema(SCHEMA).parquet(stage)
            problems = {k: v for k, v in scan.validate(staged).first().asDict().items() if k != "n_rows" and v}
            if staged.groupBy("timestamp", "symbol").count().filter("count > 1").limit(1).count():
                problems["duplicate_keys"] = 1
            if now["files"] and scan.conflicts(staged, self.scan(now)).limit(1).count():
                problems["known_keys"] = 1
            if problems:
                raise ValueError(f"not ingested: {problems}")
            found = staged.withColumn("path", F.input_file_name()).groupBy("path").agg(F.count("*").alias("rows"), F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi"), F.min("symbol").alias("first"), F.max("symbol").alias("last")).collect()
        except Exception:
            self._fs.delete(self._path(stage), True)
            raise
        files = [{"path": f"{stage}/{r.path.split('/' + stage.rsplit('/', 1)[1] + '/')[1]}", "base": stage, "rows": r.rows, "lo": r.lo, "hi": r.hi, "first": r["first"], "last": r["last"]} for r in found]
        manifest = {"schema_version": 1, "generation": now["generation"] + 1, "files": now["files"] + sorted(files, key=lambda f: f["path"]), "sources": sources}
        self._write(f"gen-{manifest['generation']:08d}.json", json.dumps(manifest, sort_keys=True))
        return manifest

    def scan(self, snapshot: dict | None = None, symbols: Iterable[str] | str | None = None, start: int | None = None, end: int | None = None, columns: list[str] | None = None, ordered: bool = False) -> DataFrame:
        """Read exactly a snapshot's files, those whose statistics can match."""
        snapshot = snapshot or self.snapshot()
        names = scan.symbol_set(symbols)

        def may(f: dict) -> bool:
            return not (start is not None and f["hi"] < start or end is not None and f["lo"] > end or names and (f["last"] < names[0] or f["first"] > names[-1]))

        bases: dict[str, list[str]] = {}
        for f in snapshot["files"]:
            if may(f):
                bases.setdefault(f["base"], []).append(f["path"])
        out = None
        for base, paths in sorted(bases.items()):
            part = self.spark.read.schema(SCHEMA).option("basePath", base).parquet(*paths)
            out = part if out is None else out.unionByName(part)
        if out is None:
            out = self.spark.createDataFrame([], SCHEMA)
        return scan.query(out, names, start, end, columns, ordered)

    def summary(self, snapshot: dict | None = None) -> dict:
        """From the manifest alone."""
        s = snapshot or self.snapshot()
        f = s["files"]
        return {"generation": s["generation"], "n_files": len(f), "n_rows": sum(x["rows"] for x in f), "first_ts": min((x["lo"] for x in f), default=None), "last_ts": max((x["hi"] for x in f), default=None)}

    def lineage(self, snapshot: dict | None = None, **query) -> str:
        """SHA-256 over the canonical JSON of the manifest and the query."""
        return hashlib.sha256(json.dumps({"manifest": snapshot or self.snapshot(), "query": query}, sort_keys=True, default=str).encode()).hexdigest()


class FeatureCache:
    """Materialised features keyed by what determines them; a key is written once."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def materialise(self, features, source: DataFrame, lineage: str, name: str, version: int = 1) -> DataFrame:
        key = hashlib.sha256(json.dumps([name, version, lineage, source.schema.simpleString()]).encode()).hexdigest()
        path = f"{self.root}/{name}-{key[:32]}"
        fs_path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        if not fs_path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(fs_path):
            features(source).write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.parquet(path)


class ResultStore:
    """Runs as fact tables; a run counts once its status row says SUCCEEDED, which is written last."""

    TABLES = ("orders", "trades", "round_trips", "daily_equity", "performance_metrics", "corporate_actions", "portfolio_risk", "data_lineage", "run_config")

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _status(self, run: str, status: str, at: int) -> None:
        self.spark.createDataFrame([(run, status, at)], "run_id string, status string, created_at long").write.mode("append").parquet(f"{self.root}/runs")

    def persist(self, run: str, at: int, **facts: DataFrame) -> None:
        if unknown := set(facts) - set(self.TABLES):
            raise ValueError(f"unknown fact tables: {sorted(unknown)}")
        self._status(run, "RUNNING", at)
        try:
            for name, rows in facts.items():
                rows.withColumn("run_id", F.lit(run)).write.mode("append").partitionBy("run_id").parquet(f"{self.root}/{name}")
        except Exception:
            self._status(run, "FAILED", at + 1)
            raise
        self._status(run, "SUCCEEDED", at + 1)

    def runs(self) -> DataFrame:
        """Each run's latest status, newest first."""
        rows = self.spark.read.parquet(f"{self.root}/runs")
        latest = rows.groupBy("run_id").agg(F.max_by("status", F.struct("created_at", "status")).alias("status"), F.max("created_at").alias("created_at"))
        return latest.orderBy(F.desc("created_at"), F.desc("run_id"))

    def save_metrics(self, at: int, rows: DataFrame) -> None:
        """Insert or replace a row a run: ``rows`` has ``run_id`` and the metrics; the latest ``at`` counts."""
        rows.withColumn("saved_at", F.lit(at).cast("long")).write.mode("append").parquet(f"{self.root}/metrics")

    def metrics(self) -> DataFrame:
        """The metrics of each run as saved last (merged on read: files never change)."""
        rows = self.spark.read.parquet(f"{self.root}/metrics")
        rest = F.struct(*(c for c in rows.columns if c != "run_id"))
        return rows.groupBy("run_id").agg(F.max_by(rest, "saved_at").alias("last")).select("run_id", "last.*")

    def read(self, name: str) -> DataFrame:
        """A fact table's rows of succeeded runs."""
        ok = self.runs().filter("status = 'SUCCEEDED'").select("run_id")
        return self.spark.read.parquet(f"{self.root}/{name}").join(ok, "run_id", "left_semi")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under the cluster's checkpoint folder; a local one where none is set and driver and executors are one process."""
    import tempfile

    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tickforge-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
