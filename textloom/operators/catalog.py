"""Catalog: sources, builds, removal with cascade, runs and their lineage. Changes are appended."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F

from textloom.functions.text import source_id
from textloom.operators.chunking import chunk_project
from textloom.operators.dedupe import new_sources
from textloom.runtime import durable
from textloom.schema import PROJECT_CHUNK, RUN, SOURCE, VECTOR, BuildConfig

TABLES = {"sources": SOURCE, "chunks": PROJECT_CHUNK, "vectors": VECTOR}


def config_hash(config: dict) -> str:
    """Hash of the whole configuration in one canonical form, nested values included."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def pending(sources: DataFrame, done: DataFrame | None = None, force: bool = False, limit: int | None = None) -> DataFrame:
    """Sources to be built: status pending or failed (any, with ``force``) and not in ``done`` (source_id); the first ``limit`` by (added_at, source_id)."""
    rows = sources if force else sources.where(F.col("status").isin("pending", "failed"))
    if done is not None:
        rows = rows.join(done.select("source_id").distinct(), "source_id", "left_anti")
    return rows if limit is None else rows.orderBy(F.col("added_at").asc_nulls_first(), "source_id").limit(limit)


def progress(sources: DataFrame) -> DataFrame:
    """One row: sources in all and by status, share done."""
    n = sources.agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in ("pending", "processing", "completed", "failed")])
    return n.withColumn("done_share", F.when(F.col("total") > 0, F.round((F.col("completed") + F.col("failed")) / F.col("total"), 6)).otherwise(0.0))


def removal(sources: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, source_id, found): which of the wanted ids or URIs (``key``) exist."""
    one = sources.groupBy("source_id").agg(F.max("uri").alias("uri"))
    by_id = wanted.join(one, wanted["key"] == one["source_id"]).select("key", "source_id")
    by_uri = wanted.join(one, wanted["key"] == one["uri"]).select("key", "source_id")
    return wanted.select("key").distinct().join(by_id.union(by_uri).distinct(), "key", "left").withColumn("found", F.col("source_id").isNotNull())


def cascade(chunks: DataFrame, vectors: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chunks left, vectors left, counts): what remains when the sources ``gone`` (source_id) go, and per source what went with it."""
    ids = gone.where(F.col("source_id").isNotNull()).select("source_id").distinct()
    lost = chunks.join(ids, "source_id", "left_semi").select("chunk_id", "source_id").distinct()
    left = chunks.join(ids, "source_id", "left_anti")
    vectors_left = vectors.join(lost.select("chunk_id"), "chunk_id", "left_anti")
    lost_vectors = vectors.select("chunk_id").join(lost, "chunk_id").groupBy("source_id").agg(F.count("*").alias("vectors_removed"))
    zero = F.lit(0).cast("bigint")
    counts = ids.join(lost.groupBy("source_id").agg(F.count("*").alias("chunks_removed")), "source_id", "left").join(lost_vectors, "source_id", "left").select("source_id", F.coalesce("chunks_removed", zero).alias("chunks_removed"), F.coalesce("vectors_removed", zero).alias("vectors_removed"))
    return left, vectors_left, counts


def run_diff(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(change, n): how many distinct keys were added, removed and unchanged from run ``a`` to run ``b``."""
    x, y = a.where(F.col(key).isNotNull()).select(key).distinct().withColumn("x", F.lit(1)), b.where(F.col(key).isNotNull()).select(key).distinct().withColumn("y", F.lit(1))
    change = F.when(F.col("x").isNull(), "added").when(F.col("y").isNull(), "removed").otherwise("unchanged")
    return x.join(y, key, "full_outer").groupBy(change.alias("change")).agg(F.count("*").alias("n"))


def list_runs(runs: DataFrame, status: str | None = None, after=None, before=None, limit: int | None = None) -> DataFrame:
    """Runs, newest first; ``after`` and ``before`` are exclusive."""
    rows = runs
    for condition in [F.col("status") == status if status else None, F.col("created_at") > F.lit(after) if after else None, F.col("created_at") < F.lit(before) if before else None]:
        rows = rows if condition is None else rows.where(condition)
    rows = rows.orderBy(F.desc("created_at"), "run_id")
    return rows.limit(limit) if limit else rows


def run_status(runs: DataFrame) -> DataFrame:
    """(run_id, phase, status, seconds, inputs, outputs, errors): one row per phase of every run."""
    rows = runs.select("run_id", F.explode("phases").alias("phase", "p"))
    return rows.select("run_id", "phase", "p.status", (F.unix_timestamp("p.completed_at") - F.unix_timestamp("p.started_at")).alias("seconds"), "p.inputs", "p.outputs", "p.errors")


def cleanup(runs: DataFrame, older_than_days: int, now) -> DataFrame:
    """Runs older than so many days: what a cleanup would remove. Nothing is removed here."""
    return runs.where(F.col("created_at") < F.date_sub(F.lit(now), older_than_days)).select("run_id", "created_at")


def run_totals(runs: DataFrame) -> DataFrame:
    """(run_id, status, phases, seconds, inputs, outputs, errors): the sums over the phases of every run; runs without phases have 0."""
    values = F.map_values(F.coalesce("phases", F.create_map().cast("map<string,struct<status:string,started_at:timestamp,completed_at:timestamp,inputs:bigint,outputs:bigint,errors:bigint>>")))
    added = lambda f: F.aggregate("v", F.lit(0).cast("bigint"), lambda a, p: a + F.coalesce(f(p), F.lit(0).cast("bigint")))
    return runs.withColumn("v", values).select(
        "run_id", "status", F.size("v").alias("phases"), added(lambda p: F.unix_timestamp(p["completed_at"]) - F.unix_timestamp(p["started_at"])).alias("seconds"),
        *[added(lambda p, c=c: p[c]).alias(c) for c in ("inputs", "outputs", "errors")],
    )


def run_report(before: dict, after: dict, uris: tuple[DataFrame, DataFrame], chunks: tuple[DataFrame, DataFrame]) -> DataFrame:
    """(what, change, n) of two runs: configuration (by hash), source ``uri``s and ``chunk_id``s added, removed and unchanged."""
    spark = uris[0].sparkSession
    same = config_hash(before) == config_hash(after)
    config = spark.createDataFrame([("config", "unchanged" if same else "changed", 1)], "what string, change string, n bigint")
    parts = [run_diff(*pair, key).select(F.lit(what).alias("what"), "change", "n") for what, key, pair in (("sources", "uri", uris), ("chunks", "chunk_id", chunks))]
    return config.unionByName(parts[0]).unionByName(parts[1])


def remaining(sources: DataFrame) -> DataFrame:
    """One row: sources left to build, mean seconds a built source took from being added, and the seconds the rest will take at that."""
    built = F.when(F.col("status").isin("completed", "failed") & F.col("processed_at").isNotNull(), F.unix_timestamp("processed_at") - F.unix_timestamp("added_at"))
    n = sources.agg(F.count_if(F.col("status").isin("pending", "processing")).alias("left"), F.round(F.avg(built), 3).alias("mean_seconds"))
    return n.withColumn("eta_seconds", F.round(F.col("left") * F.coalesce("mean_seconds", F.lit(0.0)), 3))


class _Folder:
    """File operations of Hadoop's file systems below one path."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def names(self, below: str = "") -> list[str]:
        fs, p = self._fs(f"{self.path}/{below}")
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def touch(self, name: str) -> None:
        fs, p = self._fs(f"{self.path}/{name}")
        fs.create(p, False).close()

    def remove(self, name: str = "") -> bool:
        fs, p = self._fs(f"{self.path}/{name}".rstrip("/"))
        return bool(fs.exists(p) and fs.delete(p, True))


class Project(_Folder):
    """A project's tables in one folder. Every change is appended as one numbered build; nothing is rewritten.

    A build's rows lie in ``<table>/build=<n>`` and count once ``commits/<n>`` exists, so a change is
    seen whole or not at all, readers aren't disturbed, and what a failed change left is overwritten
    by the next. A source's row in a later build replaces the earlier; ``gone`` names the sources whose
    chunks and vectors of earlier builds no longer count. compact() writes what counts as one build.
    """

    def __init__(self, spark: SparkSession, root: str, name: str) -> None:
        if not name.replace("-", "").replace("_", "").isalnum():
            raise ValueError("project names have letters, digits, hyphens and underscores only")
        super().__init__(spark, f"{root.rstrip('/')}/{name}")

    def _builds(self) -> list[int]:
        """The committed builds from the last compaction on."""
        names = self.names("commits")
        base = max([int(n.split("-")[0]) for n in names if n.endswith("-base")], default=0)
        return [k for k in (int(n.split("-")[0]) for n in names) if k >= base]

    def _rows(self, table: str, schema: str) -> DataFrame:
        kept = {f"build={k:08d}" for k in self._builds()}
        paths = [f"{self.path}/{table}/{n}" for n in self.names(table) if n in kept]
        schema = f"{schema}, build int"
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{table}").parquet(*paths)

    def read(self, table: str) -> DataFrame:
        """The rows that count of sources, chunks or vectors."""
        extra = ", source_id string" if table == "vectors" else ""
        rows = self._rows(table, TABLES[table] + extra)
        gone = self._rows("gone", "source_id string").groupBy("source_id").agg(F.max("build").alias("since"))
        if table == "sources":
            rows = rows.groupBy("source_id").agg(F.max_by(F.struct(*rows.columns), "build").alias("r")).select("r.*")
        alive = rows.join(gone, "source_id", "left").where(F.col("since").isNull() | (F.col("build") >= F.col("since")))
        return alive.select(*self.spark.createDataFrame([], TABLES[table]).columns)

    def commit(self, base: bool = False, **parts: DataFrame) -> int:
        """Append the given tables' rows (sources, chunks, vectors with source_id, gone) as one build."""
        n = max([int(x.split("-")[0]) for x in self.names("commits")], default=0) + 1
        for table, df in parts.items():
            df.write.mode("overwrite").parquet(f"{self.path}/{table}/build={n:08d}")
        self.touch(f"commits/{n:08d}{'-base' if base else ''}")
        return n

    def compact(self) -> int:
        """What counts as one build; earlier builds are no longer read (and may be deleted by their number)."""
        vectors = self.read("vectors").join(self.read("chunks").select("chunk_id", "source_id"), "chunk_id")
        return self.commit(True, sources=self.read("sources"), chunks=self.read("chunks"), vectors=vectors)

    def delete(self, confirm: bool = False) -> bool:
        return bool(confirm and self.remove())

    def stats(self) -> DataFrame:
        """One row: how many sources, chunks, vectors and builds there are."""
        one = self.read("sources").agg(F.count("*").alias("sources"))
        for table in ("chunks", "vectors"):
            one = one.crossJoin(self.read(table).agg(F.count("*").alias(table)))  # one row each
        return one.withColumn("builds", F.lit(len(self._builds())))

    def add_sources(self, items: list[dict], now=None) -> DataFrame:
        """Add up to 50 sources (type, uri, source_name?, tags?); returns (position, type, uri, source_id, added, reason)."""
        if not 1 <= len(items) <= 50:
            raise ValueError("from 1 to 50 sources at a time")
        rows = [(k, i["type"], i["uri"], i.get("source_name"), i.get("tags") or []) for k, i in enumerate(items)]
        given = self.spark.createDataFrame(rows, "position int, type string, uri string, source_name string, tags array<string>")
        judged = new_sources(given.withColumn("source_id", source_id(F.col("type"), F.col("uri"))), self.read("sources"))
        judged = self.spark.createDataFrame(judged.toArrow())  # at most 50 rows; they are judged before they are stored
        new = judged.where("added").select("source_id", "type", "uri", "source_name", "tags", (F.current_timestamp() if now is None else F.lit(now)).cast("timestamp").alias("added_at"), F.lit("pending").alias("status"))
        self.commit(sources=self.spark.createDataFrame([], SOURCE).unionByName(new, allowMissingColumns=True))
        return judged.select("position", "type", "uri", "source_id", "added", "reason").orderBy("position")

    def remove_sources(self, keys: list[str], confirm: bool = False) -> DataFrame:
        """Remove by id or URI with chunks and vectors; without ``confirm`` only the report. Refuses while one is processing."""
        sources, chunks, vectors = (self.read(t) for t in ("sources", "chunks", "vectors"))
        gone = removal(sources, self.spark.createDataFrame([(k,) for k in dict.fromkeys(keys)], "key string"))
        if not sources.join(gone.where("found"), "source_id", "left_semi").where("status = 'processing'").isEmpty():
            raise RuntimeError("a source is being processed")
        counts = cascade(chunks, vectors, gone)[2]
        report = gone.join(counts, "source_id", "left").select("key", "source_id", "found", "chunks_removed", "vectors_removed")
        kept = self.spark.createDataFrame(report.toArrow())  # one row a key
        if confirm:
            self.commit(gone=kept.where("found").select("source_id").distinct())
        return kept

    def build(self, fetch: Callable[[DataFrame], DataFrame], embed: Callable[[DataFrame], DataFrame] | None = None, cfg: BuildConfig = BuildConfig()) -> DataFrame:
        """Build the sources that are due in one job: ``fetch`` turns sources into (source_id, part, text, error), ``embed`` chunks into (chunk_id, embedding, model).

        Due are pending and failed sources, with ``force`` all, that the checkpoint doesn't name yet, at
        most max_sources of them. A rebuilt source's old chunks and vectors give way to the new ones in
        one step; if it can't be fetched it keeps them. Chunks whose content other sources hold already
        are left out. Every build adds its sources to the checkpoint, and the last one clears it. Returns
        the sources that were due, and with dry_run nothing else happens.
        """
        sources, chunks = self.read("sources"), self.read("chunks")
        due = durable(pending(sources, self.load_checkpoint(), cfg.force, cfg.max_sources), "due")
        if cfg.dry_run:
            return due
        stamp = F.current_timestamp()
        self.commit(sources=due.withColumn("status", F.lit("processing")))
        try:
            fetched = durable(fetch(due).select("source_id", "part", "text", "error"), "fetched")
            errors = fetched.groupBy("source_id").agg(F.max("error").alias("e"), F.count("text").cast("int").alias("files"))
            outcome = durable(due.select("source_id").join(errors, "source_id", "left").select("source_id", F.coalesce("files", F.lit(0)).alias("files"), "e"), "outcome")
            rebuilt = outcome.where("files > 0").select("source_id")
            seen = chunks.join(rebuilt, "source_id", "left_anti").select(F.left(F.sha2("text", 256), F.lit(16)).alias("content_hash"))
            made = chunk_project(fetched.where("text is not null"), "source_id", "part", "text", cfg.chunking.max_chars, cfg.chunking.overlap_chars, seen)
            new = made.select("chunk_id", "source_id", "text", F.struct(F.col("chunk_index").alias("index"), "start_char", "end_char").alias("position"), F.create_map(F.lit("content_hash"), F.col("content_hash")).alias("metadata"), stamp.alias("created_at"))
            done = due.join(outcome, "source_id").withColumn("status", F.when(F.col("files") > 0, "completed").otherwise("failed")).withColumn("error", F.col("e")).withColumn("processed_at", stamp).select(*due.columns)
            self.commit(sources=done, chunks=new, gone=rebuilt)
        except Exception:
            self.commit(sources=due)  # as they were, to be built again
            raise
        if embed is not None:
            missing = self.read("chunks").join(self.read("vectors").select("chunk_id"), "chunk_id", "left_anti")
            vectors = embed(missing).select("chunk_id", F.col("embedding").cast("array<float>").alias("embedding"), "model", stamp.alias("created_at"))
            self.commit(vectors=vectors.join(missing.select("chunk_id", "source_id"), "chunk_id"))
        self.save_checkpoint(due.select("source_id"))
        if pending(self.read("sources"), self.load_checkpoint(), cfg.force).isEmpty():
            self.clear_checkpoint()
        return self.read("sources").join(due.select("source_id"), "source_id", "left_semi")

    def save_checkpoint(self, done: DataFrame) -> None:
        """Note the sources (source_id) that the running series of builds is through with."""
        done.select("source_id").distinct().write.mode("append").parquet(f"{self.path}/checkpoint")

    def load_checkpoint(self) -> DataFrame:
        """(source_id) of the sources noted since the last clearing."""
        if not self.names("checkpoint"):
            return self.spark.createDataFrame([], "source_id string")
        return self.spark.read.schema("source_id string").parquet(f"{self.path}/checkpoint").distinct()

    def clear_checkpoint(self) -> bool:
        return self.remove("checkpoint")

    def build_status(self) -> str:
        """'in_progress' while a source is processing, 'checkpoint_available' if a series of builds was left unfinished, else 'idle'."""
        if not self.read("sources").where("status = 'processing'").isEmpty():
            return "in_progress"
        return "idle" if self.load_checkpoint().isEmpty() else "checkpoint_available"


class RunLog(_Folder):
    """Runs as appended revisions: the last revision of a run holds."""

    def _append(self, row: dict) -> None:
        df = self.spark.createDataFrame([tuple(row[c] for c in row)], f"{RUN}, revision bigint")
        df.write.mode("append").parquet(f"{self.path}/runs")

    def read(self) -> DataFrame:
        """All runs (see schema.RUN)."""
        if not self.names("runs"):
            return self.spark.createDataFrame([], RUN)
        rows = self.spark.read.schema(f"{RUN}, revision bigint").parquet(f"{self.path}/runs")
        return rows.groupBy("run_id").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "run_id"]), "revision").alias("r")).select("run_id", "r.*").drop("revision")

    def get(self, run_id: str) -> dict | None:
        rows = self.read().where(F.col("run_id") == run_id).collect()  # one run
        return rows[0].asDict(recursive=True) if rows else None

    def create(self, config: dict, run_id: str | None = None, now: datetime | None = None) -> str:
        """A new run with the hash of its configuration; an id that exists is refused."""
        run_id = run_id or uuid.uuid4().hex
        if self.get(run_id):
            raise ValueError(f"run {run_id} is there already")
        self._append({"run_id": run_id, "status": "running", "created_at": now or datetime.now(timezone.utc), "completed_at": None, "config_hash": config_hash(config), "phases": {}, "revision": 0})
        return run_id

    def ensure(self, run_id: str, config: dict) -> str:
        """The run of that id, created if it isn't there."""
        return run_id if self.get(run_id) else self.create(config, run_id)

    def _revise(self, run_id: str, change: Callable[[dict], None]) -> dict:
        run = self.get(run_id)
        if run is None:
            raise KeyError(run_id)
        last = self.spark.read.parquet(f"{self.path}/runs").where(F.col("run_id") == run_id).agg(F.max("revision")).first()[0]
        change(run)
        self._append(run | {"revision": last + 1})
        return run

    def phase(self, run_id: str, name: str, status: str = "running", inputs: int = 0, outputs: int = 0, errors: int = 0, now: datetime | None = None) -> dict:
        """Start or update a phase; completed and failed ones get their time of completion."""
        if status not in ("running", "completed", "failed"):
            raise ValueError("status must be running, completed or failed")
        at = now or datetime.now(timezone.utc)

        def change(run: dict) -> None:
            phases = dict(run["phases"] or {})
            started = (phases.get(name) or {}).get("started_at") or at
            phases[name] = {"status": status, "started_at": started, "completed_at": None if status == "running" else at, "inputs": inputs, "outputs": outputs, "errors": errors}
            run["phases"] = phases

        return self._revise(run_id, change)

    def complete(self, run_id: str, status: str = "completed", now: datetime | None = None) -> dict:
        """End a run; one that has ended stays as it is."""

        def change(run: dict) -> None:
            if run["completed_at"] is None:
                run["status"], run["completed_at"] = status, now or datetime.now(timezone.utc)

        return self._revise(run_id, change)

    def cleanup(self, older_than_days: int, now: datetime, dry_run: bool = True) -> list[str]:
        """Ids of the runs older than so many days; without ``dry_run`` what they stored below ``data/<run_id>`` is removed. The log keeps their rows."""
        old = [r["run_id"] for r in cleanup(self.read(), older_than_days, now).orderBy("run_id").collect()]  # a log of runs is small
        if not dry_run:
            for run_id in old:
                self.remove(f"data/{run_id}")
        return old
