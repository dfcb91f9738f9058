"""Activity feed, search-result rows and rendered context documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memspark.functions.text import truncate_text


def feed_union(obs: DataFrame, prompts: DataFrame, summaries: DataFrame) -> DataFrame:
    """Observations, prompts and summaries as one feed with an item type; columns a kind lacks are NULL."""
    def item(df, kind):
        return df.withColumn("item_type", F.lit(kind))

    return (item(obs, "observation").unionByName(item(prompts, "prompt"), allowMissingColumns=True)
            .unionByName(item(summaries, "summary"), allowMissingColumns=True))


def newest_items(feed: DataFrame, limit: int) -> DataFrame:
    return feed.orderBy(F.col("created_at_epoch").desc(), "item_type", "id").limit(limit)


def feed_filter(feed: DataFrame, kind: str | None = None, obs_type: str | None = None, concept: str | None = None) -> DataFrame:
    if kind:
        feed = feed.filter(F.col("item_type") == kind)
    if obs_type:
        feed = feed.filter((F.col("item_type") == "observation") & (F.col("type") == obs_type))
    if concept:
        feed = feed.filter((F.col("item_type") == "observation") & F.array_contains("concepts", concept))
    return feed


RESULT = ["kind_no", "result_type", "id", "title", "content", "project", "scope", "created_at_epoch", "obs_type"]


def observation_results(obs: DataFrame, full: bool = False) -> DataFrame:
    return obs.select(
        F.lit(0).alias("kind_no"), F.lit("observation").alias("result_type"), "id", "title",
        (F.col("narrative") if full else F.lit(None).cast("string")).alias("content"), "project", "scope",
        "created_at_epoch", F.col("type").alias("obs_type"), *_extra(obs))


def summary_results(summaries: DataFrame, full: bool = False) -> DataFrame:
    return summaries.select(
        F.lit(1).alias("kind_no"), F.lit("session").alias("result_type"), "id",
        truncate_text(F.col("request"), 100).alias("title"),
        (F.col("learned") if full else F.lit(None).cast("string")).alias("content"), "project",
        F.lit(None).cast("string").alias("scope"), "created_at_epoch", F.lit(None).cast("string").alias("obs_type"),
        *_extra(summaries))


def prompt_results(prompts: DataFrame, full: bool = False) -> DataFrame:
    return prompts.select(
        F.lit(2).alias("kind_no"), F.lit("prompt").alias("result_type"), "id",
        truncate_text(F.col("prompt_text"), 100).alias("title"),
        (F.col("prompt_text") if full else F.lit(None).cast("string")).alias("content"), "project",
        F.lit(None).cast("string").alias("scope"), "created_at_epoch", F.lit(None).cast("string").alias("obs_type"),
        *_extra(prompts))


def _extra(df):
    return [c for c in ("query_id", "score") if c in df.columns]


def results_union(*kinds: DataFrame) -> DataFrame:
    out = kinds[0]
    for k in kinds[1:]:
        out = out.unionByName(k)
    return out


# context documents ----------------------------------------------------------------------------------

CONTEXT_OPEN, CONTEXT_CLOSE = "<memory-context>\n", "</memory-context>\n"


def _facts_block(tail: str = ""):
    facts = F.filter(F.coalesce("facts", F.array().cast("array<string>")), lambda f: F.coalesce(f, F.lit("")) != "")
    lines = F.array_join(F.transform(facts, lambda f: F.concat(F.lit("- "), f, F.lit("\n"))), "")
    return F.when(F.size(facts) > 0, F.concat(F.lit("Key facts:\n"), lines, F.lit(tail))).otherwise(F.lit(""))


def render_entry(full_count: int):
    """Text of one observation by its rank: in full up to ``full_count``, then one line."""
    title, kind = F.coalesce("title", F.lit("")), F.upper("type")
    narrative = F.when(F.coalesce("narrative", F.lit("")) != "", F.concat("narrative", F.lit("\n"))).otherwise(F.lit(""))
    full = F.concat(F.lit("## "), F.col("rank").cast("string"), F.lit(". ["), kind, F.lit("] "), title, F.lit("\n"),
                    narrative, _facts_block(), F.lit("\n"))
    sub = F.when(F.coalesce("subtitle", F.lit("")) != "", F.concat(F.lit(": "), "subtitle")).otherwise(F.lit(""))
    line = F.concat(F.lit("- ["), kind, F.lit("] "), title, sub, F.lit("\n"))
    return F.when(F.col("rank") <= full_count, full).otherwise(line)


def render_prompt_entry():
    title = F.coalesce("title", F.lit(""))
    narrative = F.when(F.coalesce("narrative", F.lit("")) != "", F.concat("narrative", F.lit("\n\n"))).otherwise(F.lit(""))
    return F.concat(F.lit("## "), F.col("rank").cast("string"), F.lit(". ["), "type", F.lit("] "), title, F.lit("\n"),
                    _facts_block("\n"), narrative)


def _document(ranked: DataFrame, key: str, entry, head) -> DataFrame:
    lines = ranked.select(key, "rank", entry.alias("entry")).groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("rank", "entry"))).alias("e"))
    body = F.array_join(F.transform("e", lambda x: x["entry"]), "")
    return lines.select(key, F.size("e").alias("observations"), head(F.size("e")).alias("_h"), body.alias("_b"))


def context_doc(ranked: DataFrame, key: str, full_count: int = 25) -> DataFrame:
    """(key, observations, document) for bounded ranked lists of observations (at most the injection limit per key)."""
    def head(n):
        return F.concat(F.lit(CONTEXT_OPEN + "# Project Memory ("), n.cast("string"), F.lit(
            " observations)\nUse this knowledge to answer questions without re-exploring the codebase.\n\n"))

    d = _document(ranked, key, render_entry(full_count), head)
    return d.select(key, "observations", F.concat("_h", "_b", F.lit(CONTEXT_CLOSE)).alias("document"))


def prompt_context_doc(ranked: DataFrame, key: str = "query_id") -> DataFrame:
    """The variant shown with a prompt: facts first, then the narrative, all in full."""
    def head(n):
        return F.lit("<relevant-memory>\n# Relevant Knowledge From Previous Sessions\nIMPORTANT: Use this information to "
                     "answer the question directly. Do NOT explore the codebase if the answer is here.\n\n")

    d = _document(ranked, key, render_prompt_entry(), head)
    return d.select(key, "observations", F.concat("_h", "_b", F.lit("</relevant-memory>\n")).alias("document"))
