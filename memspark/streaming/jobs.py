"""Structured Streaming jobs over tool events, prompts, observations and the retrieval log.

Running aggregates use Spark's streaming aggregation, which combines on the map side before it shuffles. Jobs that
need more than an aggregate run the batch operators in ``foreachBatch`` against state tables. A state table has one
folder per batch, each replay of a batch rewrites its own folder, and a batch reads the folder of the batch before, so
a restart after a failure gives the same result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from memspark import vocab
from memspark.functions import text as tx
from memspark.operators import conflicts as cf, filters, patterns as pt, relations as rl, similarity as sm, stats, vector_search as vs
from memspark.operators.ordering import keep_latest
from memspark.operators.prompts import prompt_dedup
from memspark.session import durable
from memspark.sources import tables as tb


# sinks and state tables --------------------------------------------------------------------------------

def append_parquet(stream: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    writer = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def each_batch(stream: DataFrame, fn: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append",
               once: bool = True) -> StreamingQuery:
    writer = stream.writeStream.outputMode(mode).foreachBatch(fn).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


class StateTable:
    """A table with one version per micro-batch; version -1 is the empty start."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, schema
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{path}/batch=-1")

    def before(self, batch_id: int) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/batch={batch_id - 1}")

    def write(self, df: DataFrame, batch_id: int) -> None:
        write_batch(df, self.path, batch_id)


# jobs -----------------------------------------------------------------------------------------------------

def stream_ingest(events: DataFrame, at_capture: bool = False) -> DataFrame:
    """Tool events worth remembering, as they arrive."""
    return filters.tool_event_filter(events, at_capture)


def stream_sessions(events: DataFrame, gap: str = "30 minutes", lateness: str = "10 minutes") -> DataFrame:
    """Session spans that end after ``gap`` without events; emitted once the watermark has passed their end."""
    return (events.withWatermark("ts", lateness).groupBy(F.session_window("ts", gap).alias("w"), "session_id")
            .agg(F.count("*").alias("events"))
            .select("session_id", F.col("w.start").alias("started_at"), F.col("w.end").alias("ended_at"), "events"))


def stream_queue_depth(messages: DataFrame) -> DataFrame:
    """Pending messages per session from (session_id, delta) with +1 on arrival and -1 when drained."""
    return messages.groupBy("session_id").agg(F.sum("delta").alias("pending"))


def queue_totals(depth: DataFrame) -> DataFrame:
    return depth.agg(F.coalesce(F.sum("pending"), F.lit(0)).alias("total_pending"),
                     F.count_if(F.col("pending") > 0).alias("active_sessions"))


def stream_retrieval_stats(log: DataFrame, window: str | None = None, lateness: str = "10 minutes") -> DataFrame:
    """Running retrieval counters per project, or per project and tumbling window."""
    if window is None:
        return log.groupBy("project").agg(*stats.retrieval_counters())
    w = log.withWatermark("ts", lateness).groupBy(F.window("ts", window).alias("w"), "project").agg(*stats.retrieval_counters())
    return w.withColumn("window_start", F.col("w.start")).drop("w")


def drop_repeats(prompts: DataFrame, window: str = "10 seconds") -> DataFrame:
    """A cheaper approximation of the prompt rule: repeats within the watermark of the first occurrence are dropped."""
    return prompts.withWatermark("ts", window).dropDuplicatesWithinWatermark(["session_id", "prompt_text"])


def run_prompt_dedup(prompts: DataFrame, out: str, state: str, checkpoint: str,
                     window_ms: int = vocab.DUPLICATE_PROMPT_WINDOW_MS, once: bool = True) -> StreamingQuery:
    """Exact prompt de-duplication; the state keeps the last saved prompt of each session and text, while it is younger than
    the window before the newest prompt. Prompts must arrive in the order of their times."""
    spark = prompts.sparkSession
    table = StateTable(spark, state, "session_id string, text_key string, created_at_epoch long")

    def run(batch: DataFrame, batch_id: int) -> None:
        saved = table.before(batch_id)
        kept = durable(prompt_dedup(batch, window_ms, saved))
        write_batch(kept, out, batch_id)
        both = saved.unionByName(kept.select("session_id", "text_key", "created_at_epoch"))
        last = both.groupBy("session_id", "text_key").agg(F.max("created_at_epoch").alias("created_at_epoch"))
        newest = batch.agg(F.coalesce(F.max("created_at_epoch"), F.lit(0)).alias("m")).scalar()
        table.write(last.filter(F.col("created_at_epoch") > newest - window_ms), batch_id)

    return each_batch(prompts, run, checkpoint, once=once)


CANDIDATES = ("candidate_key string, frequency long, first_seen long, last_seen long, first_id long, type string, title string, "
              "signature array<string>, promoted boolean")


def _sightings(batch: DataFrame) -> DataFrame:
    rows = pt.with_signature(batch).filter(F.size("signature") > 0)
    return rows.select(
        tx.candidate_key(F.col("signature")).alias("candidate_key"), F.lit(1).cast("long").alias("frequency"),
        F.col("created_at_epoch").alias("first_seen"), F.col("created_at_epoch").alias("last_seen"), F.col("id").alias("first_id"),
        tx.pattern_type(F.col("concepts"), F.col("title"), F.col("narrative")).alias("type"), "title", "signature",
        F.lit(False).alias("promoted"))


def _merged(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(
        F.sum("frequency").alias("frequency"), F.max("last_seen").alias("last_seen"),
        F.min_by(F.struct("first_seen", "first_id", "type", "title", "signature"), F.struct("first_seen", "first_id")).alias("f"),
        F.bool_or("promoted").alias("promoted")).select(
            *keys, "frequency", F.col("f.first_seen").alias("first_seen"), "last_seen", F.col("f.first_id").alias("first_id"),
            F.col("f.type").alias("type"), F.col("f.title").alias("title"), F.col("f.signature").alias("signature"), "promoted")


def pattern_step(spark: SparkSession, out: str, state: str, min_frequency: int = 2,
                 forget_ms: int = 7 * 24 * 3600 * 1000) -> Callable[[DataFrame, int], None]:
    """What ``run_patterns`` does with each batch."""
    table = StateTable(spark, state, CANDIDATES)

    def run(batch: DataFrame, batch_id: int) -> None:
        old = table.before(batch_id)
        seen = durable(_sightings(batch))
        known = old.filter("promoted")
        again = seen.join(known.select("candidate_key"), "candidate_key", "left_semi")
        patterns = _merged(known.unionByName(_merged(again, ["candidate_key"])), ["candidate_key"])
        open_ = old.filter("not promoted").unionByName(seen.join(known.select("candidate_key"), "candidate_key", "left_anti"))
        order = W.partitionBy("candidate_key").orderBy("first_seen", "first_id")
        gap = F.col("first_seen") - F.lag("last_seen").over(order) > forget_ms
        runs = open_.withColumn("gap", F.coalesce(gap, F.lit(False)).cast("int")).withColumn("run", F.sum("gap").over(order))
        runs = durable(_merged(runs, ["candidate_key", "run"]))
        first = runs.filter(F.col("frequency") >= min_frequency).groupBy("candidate_key").agg(F.min("run").alias("from"))
        fresh = _merged(runs.join(first, "candidate_key").filter(F.col("run") >= F.col("from")), ["candidate_key"]).withColumn(
            "promoted", F.lit(True))
        waiting = runs.join(first, "candidate_key", "left_anti").groupBy("candidate_key").agg(
            F.max_by(F.struct(*[c for c in old.columns if c != "candidate_key"]), "run").alias("r")).select("candidate_key", "r.*")
        everything = durable(patterns.select(*old.columns).unionByName(fresh.select(*old.columns)).unionByName(waiting.select(*old.columns)))
        touched = everything.filter("promoted").join(seen.select("candidate_key").distinct(), "candidate_key", "left_semi")
        write_batch(touched.select(
            "candidate_key", tx.pattern_name(F.col("type"), F.col("signature"), F.col("title")).alias("name"), "type", "signature",
            "frequency", F.col("first_id").alias("first_observation_id"), "last_seen"), out, batch_id)
        newest = everything.agg(F.max("last_seen").alias("m")).scalar()
        live = F.col("promoted") | (F.col("last_seen") >= newest - forget_ms)
        table.write(everything.filter(live), batch_id)

    return run


def run_patterns(observations: DataFrame, out: str, state: str, checkpoint: str, min_frequency: int = 2,
                 forget_ms: int = 7 * 24 * 3600 * 1000, once: bool = True) -> StreamingQuery:
    """Count candidate patterns; one becomes a pattern when it reaches ``min_frequency``.

    A candidate that is not seen again within ``forget_ms`` starts anew; a pattern is never forgotten, nor promoted twice, and
    its frequency goes on. Every batch writes the patterns that it changed, with their frequencies so far; the last row of a
    key holds (``latest_patterns``). Rows that arrive in the order of their times give the same patterns in any batches.
    Sightings of known patterns are summed before they meet the state; only other candidates' sightings are ordered per key.
    """
    run = pattern_step(observations.sparkSession, out, state, min_frequency, forget_ms)
    return each_batch(observations, run, checkpoint, once=once)


def latest_patterns(written: DataFrame) -> DataFrame:
    """The current row of every pattern, from the rows that ``run_patterns`` wrote batch by batch."""
    rest = [c for c in written.columns if c not in ("candidate_key", "batch")]
    return written.groupBy("candidate_key").agg(F.max_by(F.struct(*rest), "batch").alias("r")).select("candidate_key", "r.*")


STORE = "id long, sdk_session_id string, project string, scope string, type string, title string, subtitle string, facts array<string>, " \
        "narrative string, concepts array<string>, files_read array<string>, files_modified array<string>, " \
        "created_at_epoch long, importance_score double, is_superseded boolean"


CONFLICTS = "newer_obs_id long, older_obs_id long, conflict_type string, resolution string, reason string, detected_at_epoch long, " \
            "resolved boolean, resolved_at_epoch long"
RELATIONS = "source_id long, target_id long, relation_type string, confidence double, detection_source string, reason string"
VECTORS = "doc_id string, embedding array<float>, row_id long, doc_type string, field_type string, project string, scope string, " \
          "model_version string"
MEMORY = {"observations": STORE, "conflicts": CONFLICTS, "relations": RELATIONS, "vectors": VECTORS}


def run_memory(observations: DataFrame, root: str, checkpoint: str, keep: int = vocab.KEEP_OBSERVATIONS_PER_PROJECT,
               embedder=None, once: bool = True) -> StreamingQuery:
    """Everything that follows new observations, per micro-batch: near-duplicates out, conflicts and supersession,
    relations, patterns, vectors, and retention of the newest rows per project with all that refers to the expired ones.

    The tables of ``MEMORY`` are whole after each batch, one version per batch below ``root``; retention bounds them.
    ``patterns`` has the rows changed by each batch (``latest_patterns``); patterns outlive their observations. A conflict is
    detected when its newer observation arrives, so that a replay gives the same time.
    """
    spark = observations.sparkSession
    tables = {name: StateTable(spark, f"{root}/{name}", schema) for name, schema in MEMORY.items()}
    patterns = pattern_step(spark, f"{root}/patterns", f"{root}/candidates")

    def run(batch: DataFrame, batch_id: int) -> None:
        old = {name: table.before(batch_id) for name, table in tables.items()}
        new = batch.select(*old["observations"].columns)
        fresh = durable(sm.ingest_dedup(new, old["observations"], "sdk_session_id"))
        everything = durable(old["observations"].unionByName(fresh))
        found = cf.new_conflicts(cf.detect_conflicts(cf.conflict_pairs(fresh, everything)), 0)
        times = fresh.select(F.col("id").alias("newer_obs_id"), F.col("created_at_epoch").alias("detected_at_epoch"))
        conflicts = durable(found.drop("detected_at_epoch").join(times, "newer_obs_id"))
        relations = rl.detect_relations(rl.relation_pairs(fresh, everything))
        patterns(fresh, batch_id)
        marked = cf.mark_superseded(everything, conflicts).select(*everything.columns)
        expired = durable(keep_latest(everything, keep, "project").select("id"))
        vectors = vs.rebuild_vectors(vs.observation_docs(cf.without(fresh, expired, "id")), None, embedder, full=True)
        left = cf.cascade_delete(expired, marked, old["vectors"].unionByName(vectors), old["relations"].unionByName(relations),
                                 old["conflicts"].unionByName(conflicts))
        for name, table in tables.items():
            table.write(left[name].select(*old[name].columns), batch_id)

    return each_batch(observations, run, checkpoint, once=once)


def latest_memory(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The tables that ``run_memory`` left after its last batch, and the patterns."""
    last = spark.read.parquet(f"{root}/observations").agg(F.max("batch")).first()[0]
    last = -1 if last is None else last
    out = {name: StateTable(spark, f"{root}/{name}", schema).before(last + 1) for name, schema in MEMORY.items()}
    if last >= 0:
        out["patterns"] = latest_patterns(spark.read.parquet(f"{root}/patterns"))
    return out


def run_rescore(root: str, spark: SparkSession, now_ms: int, version: int) -> DataFrame:
    """One rescoring pass over a stored table, written as a new version; run it from an outside scheduler."""
    from memspark.operators.scoring import rescored
    tb.write_table(rescored(tb.read_table(spark, root, "observations"), now_ms), f"{root}/rescored-{version}", "observations", "overwrite")
    return tb.read_table(spark, f"{root}/rescored-{version}", "observations")
