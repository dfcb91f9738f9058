"""Candidate pairs: each observation against the best rows its project can see."""

from __future__ import annotations

from bisect import insort
from collections import Counter
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from memspark import vocab
from memspark.functions import text as tx
from memspark.operators.ordering import order_columns, top_per_group, visible_top
from memspark.session import broadcast_if_small, durable

RANGES = 32  # parts of the time axis, at least, in which the best rows so far are followed
RANGE_ROWS = 100_000  # rows of such a part; larger tables get more parts
CELL = 2  # times the number of best rows: how many rows come in before the next cell of a part starts
LAST_ID = 2**63 - 1
SMALL_PROJECTS = 4_000  # rows of at most 50 slim structs each, about 40 MB


def best_visible(existing: DataFrame, fields: list[str], n: int = vocab.MAX_CANDIDATES,
                 derive: Callable[[DataFrame], DataFrame] | None = None, projects: DataFrame | None = None) -> DataFrame:
    """(viewer, best): each project's n best visible rows as one array of structs with o_* fields, best first.

    The rows are picked by their narrow sort keys; only then are their fields fetched and ``derive``d. ``fields`` should
    leave wide text out: at most n slim structs per project make one row.
    """
    rows = visible_top(existing, n, projects=projects, rank="_rank")
    rows = derive(rows) if derive else rows
    entry = F.struct("_rank", F.struct(*[F.col(c).alias(f"o_{c}") for c in fields]).alias("o"))
    return rows.groupBy("viewer").agg(F.array_sort(F.collect_list(entry)).alias("e")).select(
        "viewer", F.transform("e", lambda x: x["o"]).alias("best"))


def _time_ranges(rows: DataFrame) -> list[tuple[int, int]]:
    """Ascending (time, id) bounds that cut the rows into about equal parts of at most RANGE_ROWS rows. Rows of one time are cut
    by their ids where they fill several parts."""
    parts = max(RANGES, -(-rows.count() // RANGE_ROWS))
    shares = [i / parts for i in range(1, parts)]
    found = Counter(rows.agg(F.percentile_approx("created_at_epoch", shares, 20 * parts)).first()[0] or [])
    bounds = [(time, LAST_ID) for time in found]
    often = {time: times for time, times in found.items() if times > 1}
    if often:
        most = max(often.values())
        steps = [i / most for i in range(1, most)]
        same = rows.filter(F.col("created_at_epoch").isin(list(often))).groupBy("created_at_epoch")
        for time, ids in same.agg(F.percentile_approx("id", steps, 20 * most)).collect():
            bounds += {(time, ids[max(1, most * i // often[time]) - 1]) for i in range(1, often[time])}
    return sorted(bounds)


def _range_of(bounds: list[tuple[int, int]], time: str, row: str) -> Column:
    """How many bounds lie before a row's time and id."""
    times = np.array([b[0] for b in bounds], dtype="int64")
    within: dict[int, list[int]] = {}
    for t, i in bounds:
        if i != LAST_ID:
            within.setdefault(t, []).append(i)

    @F.pandas_udf("int")
    def at(t: pd.Series, i: pd.Series) -> pd.Series:
        t, i = t.to_numpy(), i.to_numpy()
        out = np.searchsorted(times, t, side="left")
        for same, ids in within.items():
            hit = t == same
            out[hit] += np.searchsorted(np.array(ids), i[hit], side="left")
        return pd.Series(out)

    return at(F.coalesce(time, F.lit(-LAST_ID)), F.col(row))  # rows without a time come first


_KEYS = ["viewer", "range", "id", "importance_score", "created_at_epoch"]
#: Name of the list of global rows, which every project reads beside its own list; no project's name holds a control character.
GLOBAL = "\x00global"


def _bases(n: int):
    def bases(rows: pd.DataFrame) -> pd.DataFrame:
        """The n best before each range that has rows, from the n best of every range."""
        real = rows[rows["real"]]
        held, parts, frames = real.iloc[:0], dict(list(real.groupby("range"))), []
        for at in sorted(rows["range"].unique()):
            frames.append(held.assign(range=at))
            if at in parts:
                held = parts[at] if held.empty else pd.concat([held, parts[at]])
                held = held.sort_values(["importance_score", "created_at_epoch", "id"], ascending=False).head(n)
        return pd.concat(frames)[_KEYS]

    return bases


def _spans(n: int):
    def spans(rows: pd.DataFrame) -> pd.DataFrame:
        """From when until when each row is among the n best so far, within one range of time, cut into cells.

        A row comes in when it is created, and once n better ones are there it stays out. A cell ends when CELL * n rows came
        in, so it never has more than (CELL + 1) * n spans, and all cells together have at most twice as many as rows came in,
        and n more. A line without ``o_id`` is the start of a cell, which holds later rows only.
        """
        held: list[tuple] = []  # ascending by importance, time, id
        since: dict[int, tuple] = {}
        out, cell, came = [], 0, 0
        order = rows.sort_values(["base", "created_at_epoch", "id"], ascending=[False, True, True])
        for base, score, time, row in zip(order["base"], order["importance_score"], order["created_at_epoch"], order["id"], strict=True):
            if len(held) == n and (score, time, row) < held[0]:
                continue
            if came == CELL * n:
                out += [(r, *start, None, None, cell) for r, start in since.items()]
                cell, came = cell + 1, 0
                out.append((None, time, row, None, None, cell))
            insort(held, (score, time, row))
            since[row] = (None, None) if base else (time, row)
            came += not base
            if len(held) > n:
                gone = held.pop(0)[2]
                out.append((gone, *since.pop(gone), time, row, cell))
        out += [(row, *start, None, None, cell) for row, start in since.items()]
        names = ["o_id", "from_time", "from_id", "until_time", "until_id", "cell"]
        frame = pd.DataFrame(out, columns=names, dtype=object).astype("Int64")
        return frame.assign(viewer=rows["viewer"].iloc[0], range=int(rows["range"].iloc[0]))

    return spans


def best_so_far(existing: DataFrame, n: int, wanted: DataFrame, bounds: list[tuple[int, int]]) -> DataFrame:
    """(viewer, range, cell, o_id, from_*, until_*): the spans in which each row is among the n best rows of its list so far, cut
    at the time ranges and cells, and the starts of the cells. ``wanted``: (viewer, range) of the rows that ask.

    There is one list per project and one of the global rows; what a project sees is merged from both when it is read. So
    spans grow with the rows, however many projects there are and however scores develop. The n best of the ranges before
    are merged per list, n rows per range; each range is then run through by itself, so a large list is split over as many
    tasks as there are ranges, whose number grows with the table.
    """
    score = F.coalesce("importance_score", F.lit(1.0)).alias("importance_score")
    viewer = F.when(F.coalesce("scope", F.lit("project")) == "global", F.lit(GLOBAL)).otherwise(F.col("project")).alias("viewer")
    at = _range_of(bounds, "created_at_epoch", "id").alias("range")
    keys = existing.select(viewer, at, "id", score, "created_at_epoch").filter(F.col("viewer").isNotNull())
    keys = durable(keys.join(wanted.select("viewer").distinct(), "viewer", "left_semi"))
    best = top_per_group(keys, ["viewer", "range"], order_columns("importance"), n, "_r").select(*_KEYS)
    kinds = best.schema
    asked = wanted.select("viewer", "range", F.lit(0).cast("long").alias("id"), F.lit(0.0).alias("importance_score"),
                          F.lit(0).cast("long").alias("created_at_epoch"), F.lit(False).alias("real"))
    bases = best.withColumn("real", F.lit(True)).unionByName(asked).groupBy("viewer").applyInPandas(_bases(n), kinds)
    both = bases.withColumn("base", F.lit(True)).unionByName(keys.select(*_KEYS).withColumn("base", F.lit(False)))
    return durable(both.groupBy("viewer", "range").applyInPandas(
        _spans(n), "o_id long, from_time long, from_id long, until_time long, until_id long, cell long, viewer string, range int"))


def _with_cell(newer: DataFrame, spans: DataFrame, viewer: str, cell: str) -> DataFrame:
    """New rows with the cell of list ``viewer`` (a column) that holds their time: the last one that started before them."""
    starts = spans.filter(F.col("o_id").isNull()).select(
        F.col("viewer").alias(viewer), F.col("range").alias("_range"), F.col("from_time").alias("n_created_at_epoch"),
        F.col("from_id").alias("n_id"), F.col("cell").alias("_start"))
    rows = newer.unionByName(starts, allowMissingColumns=True)
    order = W.partitionBy(viewer, "_range").orderBy("n_created_at_epoch", "n_id", F.col("_start").isNotNull())
    before = F.last("_start", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    return rows.withColumn(cell, F.coalesce(before, F.lit(0))).filter(F.col("_start").isNull()).drop("_start")


def _live(cell: Column) -> Column:
    """The rows of a cell that are in it when the new row arrives, at most n."""
    t, i = F.col("n_created_at_epoch"), F.col("n_id")
    return F.filter(F.coalesce(cell, F.array()), lambda x: (
        (x["from_time"].isNull() | (x["from_time"] < t) | ((x["from_time"] == t) & (x["from_id"] < i)))
        & (x["until_time"].isNull() | (x["until_time"] > t) | ((x["until_time"] == t) & (x["until_id"] >= i)))))


def candidate_pairs(new: DataFrame, existing: DataFrame, new_fields: list[str], old_fields: list[str],
                    max_candidates: int = vocab.MAX_CANDIDATES, older_only: bool = True,
                    derive: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(n_*, o_*) pairs of a new row and an existing one among its project's best visible rows, never itself.

    The bound belongs to the semantics: a new row is compared with the 50 most important rows that its project can see.
    With ``older_only`` these are the best of the rows created before it, as when rows arrive one by one, so that one batch
    over a whole table can stand for row-by-row arrival; otherwise the best of the whole table. Work is linear in the new rows:
    each meets one cell of its project's list and one of the global list, of at most (CELL + 1) times ``max_candidates`` slim
    structs each, and merges the rows that are live in them. ``old_fields`` should leave wide text out.
    """
    newer = new.select(*[F.col(c).alias(f"n_{c}") for c in dict.fromkeys([*new_fields, "id", "created_at_epoch", "project"])])
    fields = list(dict.fromkeys([*old_fields, "id", "created_at_epoch"]))
    if not older_only:
        best = best_visible(existing, fields, max_candidates, derive, new.select("project").distinct())
        best = broadcast_if_small(durable(best), SMALL_PROJECTS)
        fan = newer.join(best, newer["n_project"] == best["viewer"]).withColumn("_o", F.explode("best"))
        return fan.select(*newer.columns, "_o.*").filter(F.col("n_id") != F.col("o_id"))
    times = ["created_at_epoch", "id"]
    bounds = _time_ranges(existing.select(*times).unionByName(new.select(*times)))
    names = newer.columns
    newer = newer.filter(F.col("n_project").isNotNull()).withColumns({
        "_range": _range_of(bounds, "n_created_at_epoch", "n_id"), "_own": F.col("n_project"), "_all": F.lit(GLOBAL)})
    asked = durable(newer.select(F.explode(F.array("_own", "_all")).alias("viewer"), F.col("_range").alias("range")).distinct())
    spans = best_so_far(existing, max_candidates, asked, bounds)
    rows = existing.join(spans.select(F.col("o_id").alias("id")).distinct(), "id", "left_semi")
    rows = (derive(rows) if derive else rows).select(
        F.coalesce("importance_score", F.lit(1.0)).alias("_score"), F.struct(*[F.col(c).alias(f"o_{c}") for c in fields]).alias("o"),
        F.col("id").alias("o_id"), F.col("created_at_epoch").alias("_time"))
    entry = F.struct("_score", "_time", "o_id", "from_time", "from_id", "until_time", "until_id", "o")
    cells = durable(spans.join(rows, "o_id").groupBy("viewer", "range", "cell").agg(F.collect_list(entry).alias("held")))
    # new rows that share both cells get them together, so the cells meet the new rows once
    tasks = int(new.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # merging is work for all, even where rows are slim
    newer = _with_cell(_with_cell(newer, spans, "_all", "_all_cell"), spans, "_own", "_own_cell").drop("_all")
    newer = durable(newer.repartition(tasks, "n_id"))
    both = ["_own", "_range", "_own_cell", "_all_cell"]
    own = cells.select(F.col("viewer").alias("_own"), F.col("range").alias("_range"), F.col("cell").alias("_own_cell"), F.col("held").alias("_mine"))
    shared = cells.filter(F.col("viewer") == GLOBAL).select(
        F.col("range").alias("_range"), F.col("cell").alias("_all_cell"), F.col("held").alias("_theirs"))
    held = newer.select(*both).distinct().join(shared, ["_range", "_all_cell"], "left").join(own, ["_own", "_range", "_own_cell"], "left")
    # both sides dealt by number, as slim rows that fan out would else be put together into a few tasks
    fan = newer.repartition(tasks, *both).join(held.repartition(tasks, *both), both)
    live = F.concat(_live(F.col("_mine")), _live(F.col("_theirs")))
    best = tx.let(live, lambda x: F.when(F.size(x) > max_candidates, F.slice(F.sort_array(x, asc=False), 1, max_candidates)).otherwise(x))
    return fan.select(*names, F.explode(best).alias("_best")).select(*names, "_best.o.*")


def file_overlap_pairs(pairs: DataFrame) -> DataFrame:
    shared = F.size(F.array_intersect("n_files_modified", "o_files_modified"))
    reads = F.size(F.filter("n_files_read", lambda f: F.array_contains(F.col("o_files_modified"), f)))
    return pairs.withColumns({"shared_modified": shared, "reads_modified": reads}).filter(
        F.col("shared_modified") + F.col("reads_modified") > 0)


def concept_overlap_pairs(pairs: DataFrame) -> DataFrame:
    shared = F.filter("o_concepts", lambda c: F.array_contains(F.col("n_concepts"), c))
    return pairs.withColumn("shared_concepts", F.size(shared)).filter(F.col("shared_concepts") > 0)
