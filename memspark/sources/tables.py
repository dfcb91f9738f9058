"""Reading and writing the memory tables; appends, upserts and cascades as whole-table DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memspark import schemas, vocab
from memspark.functions.text import determine_scope, empty_to_null
from memspark.operators.ordering import with_positions


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.schema(schemas.TABLES[name]).parquet(f"{root}/{name}")


def write_table(df: DataFrame, root: str, name: str, mode: str = "append") -> None:
    """Write with the table's columns, texts well compressed; tables with a project are partitioned by it."""
    schema = schemas.TABLES[name]
    out = df.select(*[F.col(f.name).cast(f.dataType) for f in schema])
    writer = out.write.mode(mode).option("compression", "zstd")
    if "project" in schema.names:
        writer = writer.partitionBy("project")
    writer.parquet(f"{root}/{name}")


# JSON text columns at the boundary ---------------------------------------------------------------

def decode_json(col, dtype: str):
    """JSON text to a native array or map; NULL and '' give NULL. dtype e.g. 'array<string>'."""
    return F.from_json(empty_to_null(F.col(col)), dtype)


def encode_json(col):
    return F.to_json(F.col(col))


def decode_observation_json(rows: DataFrame) -> DataFrame:
    strings = {c: decode_json(c, "array<string>") for c in ("facts", "concepts", "files_read", "files_modified")}
    return rows.withColumns({**strings, "file_mtimes": decode_json("file_mtimes", "map<string,bigint>")})


def export_json(df: DataFrame) -> DataFrame:
    """One JSON document per row with missing fields left out."""
    return df.select(F.to_json(F.struct("*")).alias("json"))


# transcripts and tool events --------------------------------------------------------------------

_PART = "array<struct<type:string,text:string>>"


def read_transcript_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of JSONL transcripts as (path, line_no, line); line_no orders the lines of one file."""
    order = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), order.alias("line_no"),
                                        F.col("value").alias("line"))


def last_messages(lines: DataFrame) -> DataFrame:
    """Last user and last assistant text of each transcript; malformed, empty and other lines are skipped."""
    role = F.get_json_object("line", "$.type")
    content = F.get_json_object("line", "$.message.content")
    is_parts = F.startswith(content, F.lit("[")) & F.get_json_object("line", "$.message.content[0].type").isNotNull()
    parts = F.filter(F.from_json(content, _PART), lambda p: (p["type"] == "text") & p["text"].isNotNull())
    text = F.when(is_parts, F.array_join(F.transform(parts, lambda p: p["text"]), "\n")).otherwise(content)
    msgs = lines.select("path", "line_no", role.alias("role"), text.alias("text")).filter(
        F.col("role").isin("user", "assistant") & (F.coalesce("text", F.lit("")) != ""))
    return msgs.groupBy("path").agg(
        F.max_by("text", F.when(F.col("role") == "user", F.col("line_no"))).alias("last_user"),
        F.max_by("text", F.when(F.col("role") == "assistant", F.col("line_no"))).alias("last_assistant"))


def read_tool_events(spark: SparkSession, path: str, fmt: str = "parquet", stream: bool = False) -> DataFrame:
    reader = spark.readStream if stream else spark.read
    return reader.schema(schemas.TOOL_EVENTS).format(fmt).load(path)


# appends and upserts -------------------------------------------------------------------------------

UNIQUE_KEYS = {
    "sessions": ["session_id"], "prompts": ["session_id", "prompt_number"],
    "relations": ["source_id", "target_id", "relation_type"], "concept_weights": ["concept"], "vectors": ["doc_id"],
}


def first_of_key(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """The first row of each key by ``order``, as an aggregate, so that copies collapse before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    picked = df.groupBy(*key).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_r"))
    return picked.select(*key, "_r.*").select(*df.columns)


def insert_ignore(existing: DataFrame, new: DataFrame, key: list[str], order: str = "id") -> DataFrame:
    """Rows of ``new`` that are really inserted: first of each key, and only keys not present yet."""
    return first_of_key(new, key, order).join(existing.select(*key), key, "left_anti")


def with_new_ids(rows: DataFrame, existing: DataFrame, order: list[str]) -> DataFrame:
    """Give rows the ids that follow the table's largest one, in the given order."""
    top = existing.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).scalar()
    return with_positions(rows, *[F.col(c) for c in order]).withColumn("id", F.col("_pos") + 1 + top).drop("_pos")


def prepare_observations(parsed: DataFrame, now_ms: int) -> DataFrame:
    """Extracted observations to storable rows: '' becomes NULL, scope is derived, scores start fresh."""
    out = parsed
    for c, t in (("subtitle", "string"), ("scope", "string"), ("prompt_number", "long"),
                 ("discovery_tokens", "long"), ("file_mtimes", "map<string,bigint>")):
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast(t))
    positive = F.when(F.col("prompt_number") > 0, F.col("prompt_number"))
    return out.withColumns({
        "scope": determine_scope(F.col("concepts"), F.col("scope")),
        **{c: empty_to_null(F.col(c)) for c in ("title", "subtitle", "narrative")},
        "prompt_number": positive, "discovery_tokens": F.coalesce("discovery_tokens", F.lit(0).cast("long")),
        "created_at_epoch": F.lit(now_ms).cast("long"), "importance_score": F.lit(1.0),
        "user_feedback": F.lit(0), "retrieval_count": F.lit(0).cast("long"),
        "last_retrieved_at_epoch": F.lit(None).cast("long"), "score_updated_at_epoch": F.lit(None).cast("long"),
        "is_superseded": F.lit(False),
    })


def prepare_summaries(parsed: DataFrame, now_ms: int) -> DataFrame:
    fields = {f: empty_to_null(F.col(f)) for f in vocab.SUMMARY_FIELDS}
    return parsed.withColumns({
        **fields, "prompt_number": F.lit(None).cast("long"), "discovery_tokens": F.lit(0).cast("long"),
        "created_at_epoch": F.lit(now_ms).cast("long")})


def append(existing: DataFrame, rows: DataFrame, order: list[str]) -> DataFrame:
    numbered = with_new_ids(rows, existing, order)
    return existing.unionByName(numbered.select(*existing.columns))


def upsert(existing: DataFrame, changes: DataFrame, key: list[str], version: str) -> DataFrame:
    """Replace on key: the change with the greatest version wins over the stored row."""
    old = existing.withColumn("_v", F.struct(F.lit(0).alias("a"), F.lit(None).cast("long").alias("b")))
    new = changes.withColumn("_v", F.struct(F.lit(1).alias("a"), F.col(version).cast("long").alias("b")))
    rest = [c for c in existing.columns if c not in key]
    both = old.select(*existing.columns, "_v").unionByName(new.select(*existing.columns, "_v"))
    return both.groupBy(*key).agg(F.max_by(F.struct(*rest), "_v").alias("_r")).select(*key, "_r.*").select(*existing.columns)


def session_upsert(sessions: DataFrame, requests: DataFrame) -> DataFrame:
    """Insert absent sessions; a request with a project overwrites project and prompt of a present one.

    ``requests``: (session_id, project, user_prompt, at_epoch, seq); later seq wins.
    """
    named = F.when(F.col("project") != "", F.col("seq"))
    req = requests.groupBy("session_id").agg(
        F.max_by("project", named).alias("_project"), F.max_by("user_prompt", named).alias("_prompt"),
        F.min_by("project", "seq").alias("_first_project"), F.min_by("user_prompt", "seq").alias("_first_prompt"),
        F.min("at_epoch").alias("_at"))
    j = sessions.join(req, "session_id", "full")
    out = j.select(
        "id", "session_id", F.coalesce("sdk_session_id", "session_id").alias("sdk_session_id"),
        F.coalesce("_project", "project", "_first_project").alias("project"),
        F.when(F.col("_project").isNotNull(), F.col("_prompt")).otherwise(
            F.coalesce("user_prompt", "_first_prompt")).alias("user_prompt"),
        F.coalesce("started_at_epoch", "_at").alias("started_at_epoch"), "completed_at_epoch",
        F.coalesce("status", F.lit("active")).alias("status"),
        F.coalesce("prompt_counter", F.lit(0).cast("long")).alias("prompt_counter"))
    added = with_new_ids(out.filter(F.col("id").isNull()), sessions, ["session_id"])
    return out.filter(F.col("id").isNotNull()).unionByName(added.select(*out.columns))


def ensure_parent(sessions: DataFrame, children: DataFrame) -> DataFrame:
    """Session rows to add for child rows whose session does not exist, with all columns and new ids, ready to append; both
    session ids are the child's key."""
    missing = children.groupBy("sdk_session_id").agg(
        F.min("project").alias("project"), F.min("created_at_epoch").alias("started_at_epoch"))
    rows = missing.join(sessions.select("sdk_session_id"), "sdk_session_id", "left_anti").select(
        F.col("sdk_session_id").alias("session_id"), "sdk_session_id", "project", F.lit("").alias("user_prompt"),
        "started_at_epoch", F.lit(None).cast("long").alias("completed_at_epoch"), F.lit("active").alias("status"),
        F.lit(0).cast("long").alias("prompt_counter"))
    return with_new_ids(rows, sessions, ["session_id"]).select(*sessions.columns)
