"""Structured Streaming jobs over the append-only ledgers. Each equals its batch twin on the same input.

A job has a name. Its folder (stream offsets, state, output) lies in the shared checkpoint folder under that name, so
a second call goes on where the first one stopped. State is keyed: it is cut into buckets of its key, a batch reads
and rewrites only the buckets that its keys fall into, and a manifest per batch says which version of each bucket is
live. Neither grows with the number of batches, and a replayed batch overwrites its own version. Deliveries may come
in any order: what a late row changes is put out again, and the late rows themselves are put out beside.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kledger.operators.analytics import failure_streaks
from kledger.operators.changes import with_change
from kledger.operators.freshness import source_change_marks
from kledger.session import shared_folder

BUCKETS = 16
"""Buckets of a job's keyed state unless it is given another number; a job keeps the number it was started with."""


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def read_stream(spark: SparkSession, path: str, files_per_batch: int | None = 1, only: str | None = None, schema=None) -> DataFrame:
    """A stream over the Parquet files in the folder ``path`` (those named ``only``), by default with the schema of what is there.

    Without ``files_per_batch`` a batch is all that has arrived.
    """
    r = spark.readStream.schema(schema or spark.read.parquet(f"{path}/{only}" if only else path).schema)
    r = r.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else r
    return (r.option("pathGlobFilter", only) if only else r).parquet(path)


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What lies under ``path``; no rows where nothing was written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as exc:
        if "PATH_NOT_FOUND" not in str(exc):
            raise
        return spark.createDataFrame([], schema)


class Job:
    """A named streaming job: offsets, output and state under one folder that a later call finds again."""

    def __init__(self, spark: SparkSession, name: str, buckets: int = BUCKETS):
        self.spark, self.name, self.buckets, self.folder = spark, name, buckets, f"{shared_folder(spark)}/jobs/{name}"

    def run(self, stream: DataFrame, step: Callable[[DataFrame, int], None], deliver: Sequence[Callable[[], None]] = (), output: str = "append") -> None:
        """Process everything that is new, batch by batch, then stop; with ``deliver``, once after each delivery."""
        for send in deliver or [lambda: None]:
            send()
            q = stream.writeStream.queryName(f"{self.name}-{uuid.uuid4().hex[:6]}").outputMode(output).option("checkpointLocation", f"{self.folder}/offsets").foreachBatch(step).trigger(availableNow=True).start()
            q.awaitTermination()

    def put(self, df: DataFrame, batch: int, name: str = "out") -> None:
        df.write.mode("overwrite").parquet(f"{self.folder}/{name}/batch={batch}")

    def rows(self, schema: str, name: str = "out") -> DataFrame:
        """All rows put out so far, with their ``batch``."""
        return stored(self.spark, f"{self.folder}/{name}", schema + ", batch bigint")


class KeyedState:
    """A table of one row per key, cut into buckets; every batch names the live version of each bucket."""

    def __init__(self, job: Job, schema: str, *keys: str, name: str = "state"):
        self.job, self.schema, self.keys, self.folder = job, schema, keys, f"{job.folder}/{name}"

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.job.buckets)).cast("int")

    def touched(self, df: DataFrame) -> list[int]:
        """The buckets that the keys of ``df`` fall into: at most as many numbers as the job has buckets."""
        return sorted(r[0] for r in df.select(self.bucket().alias("b")).distinct().collect())

    def live(self, batch: int) -> dict[int, int]:
        """Bucket -> version after ``batch`` (its manifest has one row per bucket at most)."""
        if batch < 0:
            return {}
        return {r["bucket"]: r["version"] for r in stored(self.job.spark, f"{self.folder}/manifest/batch={batch}", "bucket int, version bigint").collect()}

    def load(self, batch: int, buckets: Sequence[int] | None = None) -> DataFrame:
        """The live rows before ``batch``, of the named buckets or of all."""
        live = self.live(batch - 1)
        paths = [f"{self.folder}/rows/version={v}/bucket={b}" for b, v in sorted(live.items()) if buckets is None or b in buckets]
        spark = self.job.spark
        return spark.read.schema(self.schema).parquet(*paths) if paths else spark.createDataFrame([], self.schema)

    def save(self, df: DataFrame, batch: int, buckets: Sequence[int]) -> None:
        """``df`` holds all rows of the named buckets after ``batch``; the other buckets keep their version."""
        before = self.live(batch - 1)
        if buckets:
            df.withColumn("bucket", self.bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/rows/version={batch}")
        kept = {r["bucket"] for r in stored(self.job.spark, f"{self.folder}/rows/version={batch}", "bucket int").distinct().collect()} if buckets else set()
        after = {b: v for b, v in before.items() if b not in buckets} | {b: batch for b in buckets if b in kept}
        self.job.spark.createDataFrame(sorted(after.items()), "bucket int, version bigint").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/manifest/batch={batch}")
        self._discard(self.live(batch - 2), before)
        self._remove(f"{self.folder}/manifest/batch={batch - 2}")

    def _discard(self, older: dict[int, int], old: dict[int, int]) -> None:
        """Versions that the last batch replaced: no replay reads them again."""
        for b, v in older.items():
            if old.get(b) != v:
                self._remove(f"{self.folder}/rows/version={v}/bucket={b}")

    def _remove(self, path: str) -> None:
        spark = self.job.spark
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)

    def table(self) -> DataFrame:
        """All live rows after the last batch."""
        batches = [r[0] for r in stored(self.job.spark, f"{self.folder}/manifest", "batch bigint").select("batch").distinct().collect()]  # the last two
        return self.load(max(batches, default=-1) + 1)


def job_of(spark: SparkSession, kind: str, name: str | None, buckets: int = BUCKETS) -> Job:
    return Job(spark, name or f"{kind}-{uuid.uuid4().hex[:12]}", buckets)


# ---- STR-01 ----------------------------------------------------------------------------------------
def token_totals(spark: SparkSession, ledger: DataFrame, name: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Daily totals per model, kept by day and model; no row is ever too late."""
    job = job_of(spark, "tokens", name, buckets)
    state = KeyedState(job, "day timestamp, model string, input_tokens bigint, output_tokens bigint, calls bigint", "day", "model")
    rows = ledger.select(F.date_trunc("day", "ts").alias("day"), "model", "input_tokens", "output_tokens")
    sums = [F.sum(c).alias(c) for c in ("input_tokens", "output_tokens", "calls")]

    def step(df: DataFrame, i: int) -> None:
        new = df.withColumn("calls", F.lit(1).cast("bigint")).groupBy("day", "model").agg(*sums)
        job.put(new, i, "sums")
        new = job.spark.read.parquet(f"{job.folder}/sums/batch={i}")
        buckets = state.touched(new)
        state.save(state.load(i, buckets).unionByName(new).groupBy("day", "model").agg(*sums), i, buckets)

    job.run(rows, step)
    return state.table()


# ---- STR-02 ----------------------------------------------------------------------------------------
FEED = "note_id string, updated timestamp, change_kind string"


def change_feed(spark: SparkSession, history: DataFrame, deliver: Sequence[Callable[[], None]] = (), name: str | None = None, after: int = -1) -> DataFrame:
    """Every changed note once, with the batch that delivered it.

    The stream's offsets, kept under ``name``, are the cursor of the feed; a reader's own cursor is the last batch
    it has seen: ``after`` leaves that batch and the earlier ones out.
    """
    job = job_of(spark, "changes", name)
    rows = with_change(history).select("note_id", "updated", "change_kind")
    job.run(rows, lambda df, i: job.put(df, i), deliver)
    return job.rows(FEED).filter(F.col("batch") > after)


# ---- STR-03 ----------------------------------------------------------------------------------------
def job_intake(spark: SparkSession, jobs: DataFrame, name: str | None = None, deliver: Sequence[Callable[[], None]] = ()) -> DataFrame:
    """First sighting of each idempotency key. Seen keys are keyed state of the stream itself, without a watermark, so none is ever forgotten."""
    job = job_of(spark, "intake", name)
    job.run(jobs.select("idempotency_key").dropDuplicates(["idempotency_key"]), lambda df, i: job.put(df, i), deliver)
    return job.rows("idempotency_key string").drop("batch")


# ---- STR-04 ----------------------------------------------------------------------------------------
def streaks(spark: SparkSession, outcomes: DataFrame, deliver: Sequence[Callable[[], None]] = (), name: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Failure streaks across batches and in any order of delivery.

    State is the last outcome and the open streak of each worker. A row at or before a worker's last one is late:
    that worker's outcomes are read again, only its own buckets of them, and the streaks from the late row on are
    put out anew. ``late_rows`` lists late rows.
    """
    job = job_of(spark, "streaks", name, buckets)
    state = KeyedState(job, "worker bigint, last bigint, carry bigint", "worker")
    schema = "worker bigint, seq bigint, status string"

    def history(buckets: list[int]) -> DataFrame:
        return stored(job.spark, f"{job.folder}/rows", schema + ", batch bigint, bucket int").filter(F.col("bucket").isin(buckets)).select("worker", "seq", "status")

    def step(df: DataFrame, i: int) -> None:
        s = job.spark
        df.select("worker", "seq", "status", state.bucket().alias("bucket")).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{job.folder}/rows/batch={i}")
        rows = stored(s, f"{job.folder}/rows/batch={i}", schema)
        buckets = state.touched(rows)
        held = state.load(i, buckets)
        known = rows.join(held, "worker", "left")
        job.put(known.filter(F.col("seq") <= F.col("last")).select("worker", "seq", "status"), i, "late")
        late = stored(s, f"{job.folder}/late/batch={i}", schema).groupBy("worker").agg(F.min("seq").alias("first_late"))
        again = state.touched(late)
        timely = rows.join(late, "worker", "left_anti")
        first_ok = timely.filter("status <> 'failed'").groupBy("worker").agg(F.min("seq").alias("first_ok"))
        now = failure_streaks(timely).join(held, "worker", "left").join(first_ok, "worker", "left")
        carried = F.when(F.col("first_ok").isNull() | (F.col("seq") < F.col("first_ok")), F.coalesce("carry", F.lit(0))).otherwise(0)
        out = now.select("worker", "seq", (F.col("streak") + carried).cast("bigint").alias("streak"))
        if again:
            whole = failure_streaks(history(again).join(late, "worker"))
            out = out.unionByName(whole.filter("seq >= first_late").select("worker", "seq", F.col("streak").cast("bigint").alias("streak")))
        job.put(out, i)
        moved = s.read.parquet(f"{job.folder}/out/batch={i}").groupBy("worker").agg(F.max("seq").alias("last"), F.max_by("streak", "seq").alias("carry"))
        state.save(moved.unionByName(held.join(moved, "worker", "left_anti")), i, buckets)

    job.run(outcomes, step, deliver)
    newest = job.rows("worker bigint, seq bigint, streak bigint").groupBy("worker", "seq").agg(F.max_by("streak", "batch").alias("streak"))
    return newest.withColumn("pause", F.col("streak") == 3)


def late_rows(spark: SparkSession, name: str, schema: str) -> DataFrame:
    """The rows that came late to the named job, with the batch they came in."""
    return Job(spark, name).rows(schema, "late")


# ---- STR-05 ----------------------------------------------------------------------------------------
def corpus_versions(spark: SparkSession, arrivals: DataFrame, deliver: Sequence[Callable[[], None]] = (), name: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """(seq, doc_id, action): a second version replaces its base, an arrival of something present is an error.

    State is the first arrival of each base. An earlier one that comes late becomes the first, and what was
    the first so far is put out again.
    """
    job = job_of(spark, "corpus", name, buckets)
    state = KeyedState(job, "base string, seq bigint, doc_id string", "base")

    def based(df: DataFrame) -> DataFrame:
        return df.select("seq", "doc_id", F.regexp_replace("doc_id", "@v2$", "").alias("base"))

    def step(df: DataFrame, i: int) -> None:
        rows = based(df)
        firsts = rows.groupBy("base").agg(F.min(F.struct("seq", "doc_id")).alias("first"))
        job.put(firsts, i, "firsts")
        firsts = job.spark.read.parquet(f"{job.folder}/firsts/batch={i}")
        buckets = state.touched(firsts)
        held = state.load(i, buckets)
        both = held.select("base", F.struct("seq", "doc_id").alias("first")).unionByName(firsts).groupBy("base").agg(F.min("first").alias("first"))
        replaced = held.join(firsts, "base").filter(F.col("first") < F.struct("seq", "doc_id"))
        affected = rows.unionByName(replaced.select("seq", "doc_id", "base"))
        action = F.when(F.col("seq") == F.col("first.seq"), "added").when(F.col("doc_id").endswith("@v2"), "replaced").otherwise("error")
        job.put(affected.join(both, "base").select("seq", "doc_id", action.alias("action")), i)
        job.put(rows.join(held.select("base", F.col("seq").alias("known")), "base").filter("seq < known").select("seq", "doc_id"), i, "late")
        state.save(both.select("base", "first.seq", "first.doc_id").unionByName(held.join(both, "base", "left_anti")), i, buckets)

    job.run(arrivals, step, deliver)
    return job.rows("seq bigint, doc_id string, action string").groupBy("seq", "doc_id").agg(F.max_by("action", "batch").alias("action"))


# ---- STR-06 ----------------------------------------------------------------------------------------
MARK = "note_id string, url string, content_hash string, marked_at string"


def source_marks(spark: SparkSession, snapshots: DataFrame, notes: DataFrame, at: str, deliver: Sequence[Callable[[], None]] = (), name: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Marks for notes that cite a URL whose content changed, as snapshots arrive; a mark is set once. Every snapshot counts, in whatever order."""
    job = job_of(spark, "marks", name, buckets)
    state = KeyedState(job, MARK, "note_id")

    def step(df: DataFrame, i: int) -> None:
        s = job.spark
        job.put(source_change_marks(notes, df.select("url", "content_hash").distinct(), s.createDataFrame([], MARK), at), i, "changed")
        changed = s.read.schema(MARK).parquet(f"{job.folder}/changed/batch={i}")
        buckets = state.touched(changed)
        held = state.load(i, buckets)
        new = changed.join(held, ["note_id", "url", "content_hash"], "left_anti")
        job.put(new, i)
        state.save(held.unionByName(s.read.schema(MARK).parquet(f"{job.folder}/out/batch={i}")), i, buckets)

    job.run(snapshots, step, deliver)
    return job.rows(MARK).drop("batch")


# ---- STR-07 ----------------------------------------------------------------------------------------
def search_view(spark: SparkSession, changed: DataFrame, deliver: Sequence[Callable[[], None]] = (), name: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """(note_id, fingerprint, writes): the search view kept by upserting only notes whose fingerprint moved.

    ``changed``: (note_id, fingerprint, version) images as they arrive. An image older than the one in the view is
    late and changes nothing.
    """
    job = job_of(spark, "view", name, buckets)
    state = KeyedState(job, "note_id string, fingerprint string, version bigint, writes bigint", "note_id")

    def step(df: DataFrame, i: int) -> None:
        newest = df.groupBy("note_id").agg(F.max_by("fingerprint", "version").alias("fingerprint"), F.max("version").cast("bigint").alias("version"))
        job.put(newest, i, "newest")
        newest = job.spark.read.parquet(f"{job.folder}/newest/batch={i}")
        buckets = state.touched(newest)
        held = state.load(i, buckets)
        old = held.select("note_id", F.col("fingerprint").alias("old"), F.col("version").alias("seen"), "writes")
        met = newest.join(old, "note_id", "left")
        job.put(met.filter(F.col("version") < F.col("seen")).select("note_id", "fingerprint", "version"), i, "late")
        ahead = met.filter(F.col("seen").isNull() | (F.col("version") >= F.col("seen")))
        moved = (~F.col("fingerprint").eqNullSafe(F.col("old"))).cast("bigint")
        upsert = ahead.select("note_id", "fingerprint", "version", (F.coalesce("writes", F.lit(0)) + moved).alias("writes"), moved.alias("moved"))
        job.put(upsert.filter("moved = 1").select("note_id", "fingerprint"), i)
        state.save(upsert.drop("moved").unionByName(held.join(upsert, "note_id", "left_anti")), i, buckets)

    job.run(changed, step, deliver)
    return state.table().select("note_id", "fingerprint", "writes")
