"""Fixed schemas of the memory tables."""

from pyspark.sql import types as T

_S, _L, _D, _I, _B = T.StringType(), T.LongType(), T.DoubleType(), T.IntegerType(), T.BooleanType()
_AS, _AL = T.ArrayType(T.StringType()), T.ArrayType(T.LongType())


def _schema(*fields) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in fields])


SESSIONS = _schema(
    ("id", _L), ("session_id", _S), ("sdk_session_id", _S), ("project", _S), ("user_prompt", _S),
    ("started_at_epoch", _L), ("completed_at_epoch", _L), ("status", _S), ("prompt_counter", _L),
)
OBSERVATIONS = _schema(
    ("id", _L), ("sdk_session_id", _S), ("project", _S), ("scope", _S), ("type", _S), ("title", _S),
    ("subtitle", _S), ("facts", _AS), ("narrative", _S), ("concepts", _AS), ("files_read", _AS),
    ("files_modified", _AS), ("file_mtimes", T.MapType(T.StringType(), T.LongType())), ("prompt_number", _L),
    ("discovery_tokens", _L), ("created_at_epoch", _L), ("importance_score", _D), ("user_feedback", _I),
    ("retrieval_count", _L), ("last_retrieved_at_epoch", _L), ("score_updated_at_epoch", _L), ("is_superseded", _B),
)
SUMMARIES = _schema(
    ("id", _L), ("sdk_session_id", _S), ("project", _S), ("request", _S), ("investigated", _S), ("learned", _S),
    ("completed", _S), ("next_steps", _S), ("notes", _S), ("prompt_number", _L), ("discovery_tokens", _L),
    ("created_at_epoch", _L),
)
PROMPTS = _schema(
    ("id", _L), ("session_id", _S), ("prompt_number", _L), ("prompt_text", _S), ("matched_observations", _L),
    ("created_at_epoch", _L),
)
VECTORS = _schema(
    ("doc_id", _S), ("embedding", T.ArrayType(T.FloatType())), ("row_id", _L), ("doc_type", _S), ("field_type", _S),
    ("project", _S), ("scope", _S), ("model_version", _S),
)
CONCEPT_WEIGHTS = _schema(("concept", _S), ("weight", _D), ("updated_at_epoch", _L))
CONFLICTS = _schema(
    ("id", _L), ("newer_obs_id", _L), ("older_obs_id", _L), ("conflict_type", _S), ("resolution", _S),
    ("reason", _S), ("detected_at_epoch", _L), ("resolved", _B), ("resolved_at_epoch", _L),
)
PATTERNS = _schema(
    ("id", _L), ("name", _S), ("type", _S), ("description", _S), ("signature", _AS), ("recommendation", _S),
    ("frequency", _L), ("projects", _AS), ("observation_ids", _AL), ("status", _S), ("merged_into_id", _L),
    ("confidence", _D), ("last_seen_at_epoch", _L), ("created_at_epoch", _L),
)
RELATIONS = _schema(
    ("id", _L), ("source_id", _L), ("target_id", _L), ("relation_type", _S), ("confidence", _D),
    ("detection_source", _S), ("reason", _S), ("created_at_epoch", _L),
)
TOOL_EVENTS = _schema(
    ("event_id", _L), ("session_id", _S), ("project", _S), ("tool_name", _S), ("tool_input", _S),
    ("tool_response", _S), ("cwd", _S), ("ts", T.TimestampType()),
)

TABLES = {
    "sessions": SESSIONS, "observations": OBSERVATIONS, "summaries": SUMMARIES, "prompts": PROMPTS,
    "vectors": VECTORS, "concept_weights": CONCEPT_WEIGHTS, "conflicts": CONFLICTS, "patterns": PATTERNS,
    "relations": RELATIONS,
}
