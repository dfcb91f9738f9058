"""Memory tables derived from the driver's benchmark tables, so that every operator has a whole-table input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memspark import vocab
from memspark.functions.text import str_array

NOW_MS = 1706745600000
BASE_MS = 1704067200000
PHRASES = [" caused ", " fixes ", " replaces ", " depends on ", " related to ", " evolved from ", " removed ", " plain ",
           " plain ", " was wrong ", " added ", " removed "]
TOOLS = ["Edit", "Write", "Bash", "Read", "Grep", "TodoWrite", "WebFetch", "Glob", "Edit", "Bash", "Read", "Grep"]
TOOL_INPUTS = ["src/main.go", "git status", "package-lock.json", "go test ./...", "needle"]
CURRENT_MODEL = "m1"


# key by which a table that sits in fewer files than there are cores is spread out
_SPREAD = {"events": "event_id", "documents": "doc_id", "conversations": "conv_id", "embeddings": "vec_id"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name in _SPREAD and df.rdd.getNumPartitions() < cores:
        df = df.repartition(cores, _SPREAD[name])
    return df


def _pick(values, index):
    return F.element_at(str_array(values), (index + 1).cast("int"))


def _first_words(text, n):
    """The text up to the end of its n-th word, so that the rest is not searched for words."""
    return F.regexp_extract(text, f"^(?:[^A-Za-z0-9]*+[A-Za-z0-9]++){{0,{n}}}", 0)


def _events_with_doc_key(spark, sf_dir):
    n_docs = table(spark, sf_dir, "documents").agg(F.count("*").alias("n")).scalar()
    return table(spark, sf_dir, "events").withColumn("doc_id", F.col("event_id") % n_docs)


def _ts_ms(col="ts"):
    return F.unix_millis(F.col(col).cast("timestamp"))


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "text",
        F.array_join(F.regexp_extract_all(_first_words(text, 6), F.lit("[A-Za-z0-9]+"), F.lit(0)), " ").alias("title"),
        F.concat_ws(" ", "source", "lang").alias("subtitle"),
        F.array(F.concat(F.lit("source "), F.col("source")), F.concat(F.lit("lang "), F.col("lang"))).alias("facts"),
    )
    e = F.col("event_id")
    created = _ts_ms()
    etype = (F.when(e % 6 == 5, "refactor").when(F.col("event_type") == "error", "bugfix")
             .when(F.col("event_type") == "purchase", "feature").when(F.col("event_type") == "click", "change")
             .when(F.col("event_type") == "view", "discovery").otherwise("decision"))
    modified = F.format_string("src/f%d.go", e % 40)
    return _events_with_doc_key(spark, sf_dir).join(docs, "doc_id").select(
        e.alias("id"),
        F.concat(F.lit("u"), F.col("user_id")).alias("sdk_session_id"),
        F.concat(F.lit("p"), F.col("user_id") % 8).alias("project"),
        F.when(e % 10 == 0, "global").otherwise("project").alias("scope"),
        etype.alias("type"),
        "title",
        "subtitle",
        "facts",
        F.concat(text, _pick(PHRASES, e % 12), F.lit("end")).alias("narrative"),
        F.array(_pick(vocab.CONCEPT_TYPES, e % 25), _pick(vocab.CONCEPT_TYPES, (e * 7 + 3) % 25)).alias("concepts"),
        F.array(F.format_string("src/f%d.go", (e * 5) % 40)).alias("files_read"),
        F.array(modified, F.format_string("lib/f%d.go", (e * 3) % 40)).alias("files_modified"),
        F.create_map(modified, created).alias("file_mtimes"),
        (e % 5 + 1).alias("prompt_number"),
        F.lit(0).cast("long").alias("discovery_tokens"),
        created.alias("created_at_epoch"),
        F.when(e % 23 != 0, ((e * 37) % 1000).cast("double") / 1000.0 + 0.5).alias("importance_score"),
        (e % 3 - 1).cast("int").alias("user_feedback"),
        (F.get_json_object("props", "$.k").cast("long") % 8).alias("retrieval_count"),
        F.lit(None).cast("long").alias("last_retrieved_at_epoch"),
        F.when(e % 3 != 0, created + (e % 40) * 3600000).alias("score_updated_at_epoch"),
        (e % 17 == 0).alias("is_superseded"),
    )


def prompts(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "conversations").filter(F.col("role") == "user")
    return c.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"),
        # some prompts name a session that does not exist
        F.concat(F.when(F.col("conv_id") % 7 == 3, "x").otherwise("c"), F.col("conv_id")).alias("session_id"),
        (F.col("turn") + 1).alias("prompt_number"),
        F.col("text").alias("prompt_text"),
        F.col("turn").alias("matched_observations"),
        (BASE_MS + F.col("conv_id") * 3600000 + F.col("turn") * 60000).alias("created_at_epoch"),
    )


def sessions(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    return c.select(
        F.col("conv_id").alias("id"),
        F.concat(F.lit("c"), F.col("conv_id")).alias("session_id"),
        F.concat(F.lit("c"), F.col("conv_id")).alias("sdk_session_id"),
        F.concat(F.lit("p"), F.col("conv_id") % 8).alias("project"),
        F.lit("").alias("user_prompt"),
        (BASE_MS + F.col("conv_id") * 3600000).alias("started_at_epoch"),
        F.lit(None).cast("long").alias("completed_at_epoch"),
        _pick(vocab.SESSION_STATUSES, F.col("conv_id") % 3).alias("status"),
        F.lit(0).cast("long").alias("prompt_counter"),
    )


def summaries(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    user_turn = F.when(F.col("role") == "user", F.col("turn"))
    asst_turn = F.when(F.col("role") == "assistant", F.col("turn"))
    g = c.groupBy("conv_id").agg(
        F.min_by("text", user_turn).alias("request"), F.max_by("text", asst_turn).alias("learned"),
        F.max("turn").alias("last_turn"))
    return g.select(
        F.col("conv_id").alias("id"),
        F.concat(F.when(F.col("conv_id") % 7 == 3, "x").otherwise("c"), F.col("conv_id")).alias("sdk_session_id"),
        F.concat(F.lit("p"), F.col("conv_id") % 8).alias("project"),
        "request", F.lit(None).cast("string").alias("investigated"), "learned",
        F.lit(None).cast("string").alias("completed"), F.lit(None).cast("string").alias("next_steps"),
        F.lit(None).cast("string").alias("notes"), F.lit(None).cast("long").alias("prompt_number"),
        F.lit(0).cast("long").alias("discovery_tokens"),
        (BASE_MS + F.col("conv_id") * 3600000 + F.col("last_turn") * 60000 + 30000).alias("created_at_epoch"),
    )


def vectors(spark, sf_dir) -> DataFrame:
    v = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("vec_"), v).alias("doc_id"), "embedding", v.alias("row_id"),
        _pick(["observation", "session_summary", "user_prompt"], v % 3).alias("doc_type"),
        _pick(["narrative", "learned", "prompt"], v % 3).alias("field_type"),
        F.concat(F.lit("p"), F.col("label") % 8).alias("project"),
        F.when(v % 10 == 0, "global").otherwise("project").alias("scope"),
        F.when(v % 11 == 0, None).when(v % 13 == 0, "m0").otherwise(CURRENT_MODEL).alias("model_version"),
    )


def query_vectors(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("query_id"), F.concat(F.lit("p"), F.col("label") % 8).alias("project"), "embedding")


def query_texts(spark, sf_dir) -> DataFrame:
    b = F.col("item_id")
    lead = _pick(["how does ", "fix the error in ", "implement ", "design of ", ""], b % 5)
    return table(spark, sf_dir, "benchmark").select(
        b.alias("query_id"), F.concat(F.lit("p"), b % 8).alias("project"), F.concat(lead, F.col("text")).alias("query"))


def relations(spark, sf_dir) -> DataFrame:
    events = table(spark, sf_dir, "events")
    n = events.agg(F.count("*").alias("n")).scalar()
    e = F.col("event_id")
    return events.select(
        e.alias("id"), e.alias("source_id"), ((e * 13 + 1) % n).alias("target_id"),
        _pick(vocab.RELATION_TYPES, e % 6).alias("relation_type"),
        (F.lit(0.3) + (e % 7).cast("double") * 0.1).alias("confidence"),
        _pick(vocab.DETECTION_SOURCES, (e + 1) % 6).alias("detection_source"),
        F.concat(F.lit("edge "), e).alias("reason"), _ts_ms().alias("created_at_epoch"))


def conflicts(spark, sf_dir) -> DataFrame:
    events = table(spark, sf_dir, "events")
    n = events.agg(F.count("*").alias("n")).scalar()
    e = F.col("event_id")
    return events.select(
        e.alias("id"), e.alias("newer_obs_id"), ((e * 5 + 2) % n).alias("older_obs_id"),
        _pick(vocab.CONFLICT_TYPES, e % 3).alias("conflict_type"),
        _pick(vocab.RESOLUTIONS, e % 3).alias("resolution"),
        F.concat(F.lit("conflict "), e).alias("reason"), _ts_ms().alias("detected_at_epoch"),
        (e % 2 == 0).alias("resolved"), F.lit(None).cast("long").alias("resolved_at_epoch"))


def patterns(spark, sf_dir) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        k.alias("id"), F.concat_ws(" ", "p_name", k.cast("string")).alias("name"),
        _pick(vocab.PATTERN_TYPES, k % 5).alias("type"),
        F.concat_ws(" ", "p_brand", "p_type").alias("description"),
        F.array(_pick(vocab.CONCEPT_TYPES, k % 25), _pick(vocab.CONCEPT_TYPES, (k * 7 + 3) % 25)).alias("signature"),
        F.when(k % 2 == 0, F.concat(F.lit("prefer "), F.col("p_name"))).alias("recommendation"),
        F.col("p_size").cast("long").alias("frequency"),
        F.array_distinct(F.array(F.concat(F.lit("p"), k % 8), F.concat(F.lit("p"), (k * 3) % 8))).alias("projects"),
        F.array(k, k + 1).alias("observation_ids"),
        F.when(k % 5 == 3, "deprecated").when(k % 5 == 4, "merged").otherwise("active").alias("status"),
        F.lit(None).cast("long").alias("merged_into_id"),
        (F.lit(0.3) + (k % 7).cast("double") * 0.1).alias("confidence"),
        (BASE_MS + k * 60000).alias("last_seen_at_epoch"), F.lit(BASE_MS).cast("long").alias("created_at_epoch"))


def retrieval_log(spark, sf_dir) -> DataFrame:
    """One row per retrieval request: what was asked for, how much was served, checked and deleted."""
    events, e = table(spark, sf_dir, "events"), F.col("event_id")
    n = events.agg(F.count("*").alias("n")).scalar()
    return events.select(
        e.alias("request_id"), F.concat(F.lit("p"), F.col("user_id") % 8).alias("project"),
        F.when(e % 4 == 0, "inject").otherwise("search").alias("kind"),
        (e % 11).alias("served"), (e % 3).alias("verified"), (F.when(e % 29 == 0, 1).otherwise(0)).cast("long").alias("deleted"),
        F.when(e % 5 == 0, F.floor(e / 5)).otherwise(e * 7 % n).alias("obs_id"), F.col("ts").cast("timestamp").alias("ts"))


def tool_events(spark, sf_dir) -> DataFrame:
    e = F.col("event_id")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    response = (F.when(e % 7 == 0, F.lit("No matches found in the whole of this working tree, try again later"))
                .when(e % 7 == 1, F.lit("ok")).otherwise(F.col("text")))
    return _events_with_doc_key(spark, sf_dir).join(docs, "doc_id").select(
        e.alias("event_id"), F.concat(F.lit("u"), F.col("user_id")).alias("session_id"),
        F.concat(F.lit("p"), F.col("user_id") % 8).alias("project"),
        _pick(TOOLS, e % 12).alias("tool_name"), _pick(TOOL_INPUTS, e % 5).alias("tool_input"),
        response.alias("tool_response"), F.lit("/work").alias("cwd"), F.col("ts").cast("timestamp").alias("ts"))


def responses(spark, sf_dir) -> DataFrame:
    d = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        d.alias("response_id"),
        F.concat(
            F.lit("intro <observation><type>"), _pick(["bugfix", "decision", "other", "feature", ""], d % 5),
            F.lit("</type><title> "), F.col("source"), F.lit(" </title><narrative>"),
            F.regexp_replace("text", "<", " "),
            F.lit("</narrative><facts><fact>one</fact><fact> two </fact></facts><concepts><concept> "),
            _pick(vocab.CONCEPT_TYPES, d % 25),
            F.lit(" </concept><concept>nonsense</concept><concept>Security</concept></concepts>"
                  "<files_read><file>a.go</file></files_read></observation> and <observation><title>"),
            F.col("lang"), F.lit("</title></observation>"),
        ).alias("text"))


def private_text(spark, sf_dir) -> DataFrame:
    d = F.col("doc_id") % 4
    t = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.when(d == 0, F.concat(F.lit("<private>"), t, F.lit("</private>")))
        .when(d == 1, F.concat(F.lit("keep <private>a\nb</private>"), t, F.lit("<private>c</private> ")))
        .when(d == 2, F.concat(F.lit(" <memory-context>old\n"), t, F.lit("</memory-context> new ")))
        .otherwise(t).alias("text"))


def transcript_lines(spark, sf_dir) -> DataFrame:
    """Conversations as JSON transcript lines: text content on even turns, an array of parts on odd ones."""
    c = table(spark, sf_dir, "conversations")
    plain = F.to_json(F.struct(F.col("role").alias("type"), F.struct(
        F.col("role"), F.col("text").alias("content")).alias("message")))
    parts = F.to_json(F.struct(F.col("role").alias("type"), F.struct(
        F.col("role"), F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text")),
                               F.struct(F.lit("tool_use").alias("type"), F.lit("skip").alias("text")),
                               F.struct(F.lit("text").alias("type"), F.lit("tail").alias("text"))).alias("content"),
    ).alias("message")))
    return c.select(F.concat(F.lit("c"), F.col("conv_id")).alias("path"), F.col("turn").alias("line_no"),
                    F.when(F.col("turn") % 2 == 0, plain).otherwise(parts).alias("line"))
