"""Vector documents, exact nearest neighbours and reranking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from memspark import vocab
from memspark.functions.text import key_terms, query_variants
from memspark.functions.vectors import sigmoid
from memspark.operators.models import Embedder, embed_docs, get_embedder
from memspark.session import broadcast_if_small, durable

VECTOR_BLOCK = 32_768  # two blocks meet in a task, so a vector is shuffled once per block of queries, and k rows
QUERY_BLOCK = 16_384   # per query come out of every block of vectors
QUERIES_AT_ONCE = 512
FEW_QUERIES = 2_048  # queries that go to the vectors, in one piece of at most some MB; more of them meet the vectors in blocks
CELLS_AT_ONCE = 2_000_000  # similarities that stand in a worker at once
PAIRS_AT_ONCE = 100_000    # similarities computed in double precision at once
SMALL_HITS = 500_000


# documents ------------------------------------------------------------------------------------------

_DOC = ["doc_id", "row_id", "doc_type", "field_type", "project", "scope", "content"]


def _docs(df, doc_type, field, doc_id, content, project, scope):
    return df.select(doc_id.alias("doc_id"), F.col("id").alias("row_id"), F.lit(doc_type).alias("doc_type"),
                     field.alias("field_type"), project.alias("project"), scope.alias("scope"), content.alias("content"))


def observation_docs(obs: DataFrame) -> DataFrame:
    """The narrative and each fact as a document, in one pass over the rows."""
    narrative = F.when(F.coalesce("narrative", F.lit("")) != "", F.struct(
        F.lit("narrative").alias("field"), F.lit("narrative").alias("suffix"), F.col("narrative").alias("content")))
    facts = F.transform(F.coalesce("facts", F.array().cast("array<string>")), lambda f, i: F.struct(
        F.lit("fact").alias("field"), F.concat(F.lit("fact_"), i.cast("string")).alias("suffix"), f.alias("content")))
    rows = obs.select("id", "project", F.coalesce("scope", F.lit("project")).alias("scope"),
                      F.explode(F.concat(F.array_compact(F.array(narrative)), facts)).alias("d"))
    return _docs(rows, vocab.DOC_OBSERVATION, F.col("d.field"),
                 F.concat(F.lit("obs_"), F.col("id"), F.lit("_"), F.col("d.suffix")), F.col("d.content"),
                 F.col("project"), F.col("scope"))


def summary_docs(summaries: DataFrame) -> DataFrame:
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("content")) for f in vocab.SUMMARY_FIELDS])
    kept = F.filter(fields, lambda x: F.coalesce(x["content"], F.lit("")) != "")
    rows = summaries.select("id", "project", F.explode(kept).alias("d"))
    return _docs(rows, vocab.DOC_SUMMARY, F.col("d.field"),
                 F.concat(F.lit("summary_"), F.col("id"), F.lit("_"), F.col("d.field")), F.col("d.content"),
                 F.col("project"), F.lit(""))


def prompt_docs(prompts: DataFrame) -> DataFrame:
    """Prompts joined to their session (``project`` is needed)."""
    return _docs(prompts, vocab.DOC_PROMPT, F.lit("prompt"), F.concat(F.lit("prompt_"), F.col("id")),
                 F.col("prompt_text"), F.col("project"), F.lit(""))


def pattern_docs(patterns: DataFrame) -> DataFrame:
    names = ["name", "description", "recommendation"]
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("content")) for f in names])
    kept = F.filter(fields, lambda x: F.coalesce(x["content"], F.lit("")) != "")
    rows = patterns.select("id", F.explode(kept).alias("d"))
    return _docs(rows, vocab.DOC_PATTERN, F.col("d.field"),
                 F.concat(F.lit("pattern_"), F.col("id"), F.lit("_"), F.col("d.field")), F.col("d.content"),
                 F.lit(""), F.lit("global"))


def vector_docs(obs=None, summaries=None, prompts=None, patterns=None) -> DataFrame:
    parts = [f(d) for f, d in ((observation_docs, obs), (summary_docs, summaries), (prompt_docs, prompts),
                               (pattern_docs, patterns)) if d is not None]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def rebuild_vectors(docs: DataFrame, vectors: DataFrame | None, embedder: Embedder | None = None,
                    full: bool = False) -> DataFrame:
    """The vector table for ``docs``. Unless ``full``, vectors of the current model are kept and only the rest embedded."""
    model = embedder or get_embedder()
    cols = ["doc_id", "embedding", "row_id", "doc_type", "field_type", "project", "scope", "model_version"]
    if full or vectors is None:
        return embed_docs(docs, embedder=model).select(*cols)
    current = vectors.filter(F.col("model_version").eqNullSafe(F.lit(model.version)))
    todo = docs.join(current.select("doc_id"), "doc_id", "left_anti")
    valid = current.join(docs.select("doc_id"), "doc_id", "left_semi")
    return valid.select(*cols).unionByName(embed_docs(todo, embedder=model).select(*cols))


# nearest neighbours --------------------------------------------------------------------------------

def _unit(rows) -> np.ndarray:
    m = np.stack(rows.to_numpy()).astype("float64")
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def _tops(q: np.ndarray, v: np.ndarray, q_skip: np.ndarray, v_skip: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(place of the query, place of the vector, similarity) of the k best vectors of each query; ties go to the first vector.

    Products in single precision, which is off by less than ``slack``, tell which pairs can be among the k best; only those
    are computed in double precision. A query never meets vectors with its own number in ``v_skip``.
    """
    q4, v4 = q.astype("float32"), v.astype("float32")
    slack = (q.shape[1] + 8) * 2.4e-7 + 4e-9  # of a cosine, with room for the rounding of similarities
    least, last = np.full(len(q), -np.inf), np.full(len(q), -1)
    held, rows = [(np.zeros(0, "int64"), np.zeros(0, "int64"), np.zeros(0))], 0

    def cut() -> None:
        nonlocal held, rows
        i, j, raw = (np.concatenate(x) for x in zip(*held, strict=True))
        sim = np.round(raw, 9)  # for comparisons only: ties stay ties in every block layout
        order = np.lexsort((j, -sim, i))
        i, j, raw, sim = i[order], j[order], raw[order], sim[order]
        first = np.flatnonzero(np.append(True, i[1:] != i[:-1])) if len(i) else np.zeros(0, "int64")
        place = np.arange(len(i)) - np.repeat(first, np.diff(np.append(first, len(i))))
        end = place == k - 1
        least[i[end]], last[i[end]] = sim[end], j[end]
        best = place < k
        held, rows = [(i[best], j[best], raw[best])], int(best.sum())

    step = max(k, CELLS_AT_ONCE // len(q))
    for at in range(0, len(v), step):
        cos = q4 @ v4[at:at + step].T
        if (v_skip >= 0).any():
            cos[q_skip[:, None] == v_skip[None, at:at + step]] = -np.inf
        bar = 2 * least - 1 - slack
        new = np.isneginf(bar)
        if new.any() and cos.shape[1] > k:  # what is below the k-th best here cannot be among the k best
            bar[new] = np.partition(cos[new], cos.shape[1] - k, axis=1)[:, cos.shape[1] - k] - 2 * slack
        near = np.flatnonzero(cos >= np.maximum(bar, -2)[:, None].astype("float32"))
        for part in range(0, len(near), PAIRS_AT_ONCE):
            i, j = np.divmod(near[part:part + PAIRS_AT_ONCE], cos.shape[1])
            j += at
            # similarity = 1 - distance/2 with distance = 1 - cosine
            raw = 0.5 + np.einsum("ij,ij->i", q[i], v[j]) / 2.0
            sim = np.round(raw, 9)
            good = (sim > least[i]) | ((sim == least[i]) & (j < last[i]))
            held.append((i[good], j[good], raw[good]))
            rows += int(good.sum())
            if new.any() or rows > 3 * k * len(q):
                cut()
    cut()
    return held[0]


def _block_top_k(k: int, id_type: pa.DataType):
    """Best k documents of one vector block for each query of one query block."""
    schema = pa.schema([("query_id", id_type), ("doc_id", pa.string()), ("row_id", pa.int64()), ("similarity", pa.float64())])

    def run(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        if not len(queries) or not len(vectors):
            return schema.empty_table()
        vectors = vectors.sort_by("doc_id")
        skip, asking = vectors["skip_project"].to_pylist(), queries["q_project"].to_pylist()
        number = {p: n for n, p in enumerate(dict.fromkeys(asking))}  # none is a number, too: such a query skips rows without a project
        v_skip, q_skip = np.array([number.get(p, -1) for p in skip]), np.array([number[p] for p in asking])
        v = _as_matrix(vectors["embedding"].combine_chunks())
        # of equal vectors that the same queries meet, more than k are in no list of k
        same = pd.factorize(pd.Series([(row.tobytes(), n) for row, n in zip(v, v_skip.tolist(), strict=True)], dtype=object))[0]
        seen = _first_of_equal(same, vectors["doc_id"].combine_chunks(), k)
        v, v_skip, vectors = v[seen], v_skip[seen], vectors.select(["doc_id", "row_id"]).take(pa.array(seen))
        q, parts = _as_matrix(queries["embedding"].combine_chunks()), []
        for at in range(0, len(q), QUERIES_AT_ONCE):
            i, j, raw = _tops(q[at:at + QUERIES_AT_ONCE], v, q_skip[at:at + QUERIES_AT_ONCE], v_skip, k)
            found = vectors.take(pa.array(j))
            parts.append(pa.table([queries["query_id"].take(pa.array(i + at)), found["doc_id"], found["row_id"], pa.array(raw, pa.float64())],
                                  schema=schema))
        return pa.concat_tables(parts)

    return run


def _as_matrix(column: pa.Array) -> np.ndarray:
    """Unit rows of a list column without nulls, all of one length."""
    rows = len(column)
    lengths = pc.list_value_length(column)
    if rows == 0 or column.null_count or pc.count_distinct(lengths).as_py() != 1:
        return _unit(pd.Series(column.to_numpy(zero_copy_only=False))) if rows else np.zeros((0, 0))
    m = column.flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(rows, -1)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def _first_of_equal(same: np.ndarray, names: pa.Array, k: int) -> np.ndarray:
    """Places of all rows but those that have k rows with the same vector before them by name: they are in no list of k."""
    often = np.bincount(same) > k
    many = np.flatnonzero(often[same])
    if not len(many):
        return np.arange(len(names))
    table = pa.table({"same": same[many], "name": names.take(pa.array(many))})
    rows = many[pc.sort_indices(table, sort_keys=[("same", "ascending"), ("name", "ascending")]).to_numpy()]
    first = np.flatnonzero(np.append(True, np.diff(same[rows]) != 0))
    place = np.arange(len(rows)) - np.repeat(first, np.diff(np.append(first, len(rows))))
    return np.sort(np.concatenate([np.flatnonzero(~often[same]), rows[place < k]]))


class _Best:
    """The k best documents so far of queries that see the same vectors."""

    def __init__(self, places: np.ndarray, unit: np.ndarray, k: int):
        self.places, self.unit, self.k = places, unit, k
        self.least = np.full(len(places), -np.inf)  # rounded similarity that a further document needs
        self.last = np.full(len(places), None, dtype=object)  # and the name it needs to come before, if it has no more than that
        self.held: list[pd.DataFrame] = []
        self.rows = 0

    def add(self, unit: np.ndarray, names: np.ndarray, rows: np.ndarray) -> None:
        step = max(self.k, CELLS_AT_ONCE // len(self.places))
        for at in range(0, len(names), step):
            self._add(unit[at:at + step], names[at:at + step], rows[at:at + step])

    def _add(self, unit: np.ndarray, names: np.ndarray, rows: np.ndarray) -> None:
        raw = 0.5 + self.unit @ unit.T / 2.0
        bar, first = self.least - 1e-9, np.isneginf(self.least).any()
        if first and len(names) > self.k:  # what is below the k-th best here cannot be among the k best
            bar = np.maximum(bar, np.partition(raw, len(names) - self.k, axis=1)[:, len(names) - self.k] - 2e-9)
        q, d = np.nonzero(raw >= bar[:, None])
        sim = np.round(raw[q, d], 9)  # for comparisons only, as in blocks
        keep = sim > self.least[q]
        tied = np.flatnonzero(sim == self.least[q])
        keep[tied] = names[d[tied]] < self.last[q[tied]]
        q, d, sim = q[keep], d[keep], sim[keep]
        self.held.append(pd.DataFrame({"q": q, "doc_id": names[d], "row_id": rows[d], "similarity": raw[q, d], "sim": sim}))
        self.rows += len(q)
        if first or self.rows > 4 * self.k * len(self.places):
            self.cut()

    def cut(self) -> pd.DataFrame:
        both = pd.concat(self.held) if self.held else pd.DataFrame({c: [] for c in ("q", "doc_id", "row_id", "similarity", "sim")})
        both = both.sort_values(["q", "sim", "doc_id"], ascending=[True, False, True], kind="stable")
        place = both.groupby("q").cumcount()
        both = both[place < self.k]
        worst = both[place[place < self.k] == self.k - 1]
        at = worst["q"].to_numpy(dtype="int64")
        self.least[at], self.last[at] = worst["sim"].to_numpy(), worst["doc_id"].to_numpy()
        self.held, self.rows = [both], len(both)
        return both


def _in_place(few: pa.Table, vectors: DataFrame, k: int, by_project: bool, id_type: T.DataType) -> DataFrame:
    """Top k of a few queries within each partition of the vectors, which stay where they are."""
    schema = T.StructType([T.StructField("query_id", id_type), T.StructField("doc_id", T.StringType()),
                           T.StructField("row_id", T.LongType()), T.StructField("similarity", T.DoubleType())])
    ids, unit = few["query_id"].combine_chunks(), _as_matrix(few["embedding"].combine_chunks())
    projects = np.array(few["project"].to_pylist(), dtype=object)
    groups = [(p, np.array([i for i, x in enumerate(projects) if x == p])) for p in dict.fromkeys(projects)] if by_project else [
        (None, np.arange(len(projects)))]
    groups = [(p, places) for p, places in groups if len(places)]
    names = ["query_id", "doc_id", "row_id", "similarity"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [_Best(places, unit[places], k) for _, places in groups]
        for batch in batches:
            m = _as_matrix(batch.column("embedding"))
            docs, rows = batch.column("doc_id"), batch.column("row_id").to_numpy(zero_copy_only=False)
            same = pd.factorize(pd.Series([row.tobytes() for row in m], dtype=object))[0]
            owner = batch.column("project")
            shared = pc.fill_null(pc.equal(batch.column("scope"), "global"), False).to_numpy(zero_copy_only=False)
            for (project, _), held in zip(groups, best, strict=True):
                at = np.arange(len(m))
                if by_project and project is None:  # a query without a project sees the global rows of projects
                    at = np.flatnonzero(shared & pc.is_valid(owner).to_numpy(zero_copy_only=False))
                elif by_project:
                    own = pc.fill_null(pc.equal(owner, project), False).to_numpy(zero_copy_only=False)
                    at = np.flatnonzero(own | shared)
                at = at[_first_of_equal(same[at], docs.take(pa.array(at)), k)]
                held.add(m[at], docs.take(pa.array(at)).to_numpy(zero_copy_only=False), rows[at])
        for held in best:
            top = held.cut()
            places = held.places[top["q"].to_numpy(dtype="int64")]
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(places)), pa.array(top["doc_id"].to_numpy(dtype=object), pa.string()), pa.array(top["row_id"].to_numpy(), pa.int64()),
                 pa.array(top["similarity"].to_numpy(), pa.float64())], names)

    return vectors.select("doc_id", "row_id", "project", "scope", "embedding").mapInArrow(run, schema)


def _block_count(rows: int) -> Column:
    return F.greatest(F.ceil(F.count("*") / rows), F.lit(1)).cast("int")


def _blocked(queries: DataFrame, vectors: DataFrame, k: int, group: str | None) -> DataFrame:
    """Top k within each (group, vector block, query block): sizes come from counts, so a hot group only has more blocks."""
    if group:
        sizes = vectors.groupBy(group).agg(_block_count(VECTOR_BLOCK).alias("nv")).join(
            queries.groupBy(group).agg(_block_count(QUERY_BLOCK).alias("nq")), group)
        queries, vectors = queries.join(sizes, group), vectors.join(sizes, group)
    else:
        counts = {"nv": vectors.agg(_block_count(VECTOR_BLOCK)).scalar(), "nq": queries.agg(_block_count(QUERY_BLOCK)).scalar()}
        queries, vectors = queries.withColumns(counts), vectors.withColumns(counts)
    keys = [group, "vb", "qb"] if group else ["vb", "qb"]

    def spread(df, key, own, other, own_n, other_n):
        return df.withColumn(own, F.pmod(F.xxhash64(key), F.col(own_n)).cast("int")).withColumn(
            other, F.explode(F.sequence(F.lit(0), F.col(other_n) - 1)))

    v = spread(vectors, "doc_id", "vb", "qb", "nv", "nq").select(*keys, "doc_id", "row_id", "skip_project", "embedding")
    q = spread(queries, "query_id", "qb", "vb", "nq", "nv").select(
        *keys, "query_id", F.col("project").alias("q_project"), "embedding")
    key_type = queries.schema["query_id"].dataType.simpleString()
    return q.groupBy(*keys).cogroup(v.groupBy(*keys)).applyInArrow(
        _block_top_k(k, to_arrow_type(queries.schema["query_id"].dataType)), f"query_id {key_type}, doc_id string, row_id long, similarity double")


def knn_join(queries: DataFrame, vectors: DataFrame, k: int, doc_type: str | None = None, by_project: bool = True,
             rank: str = "rank") -> DataFrame:
    """Exact k nearest vectors per query (query_id, project, embedding): (query_id, doc_id, row_id, similarity, rank).

    ``vectors`` should be a stored table: it is counted and read by both branches.
    With ``by_project`` a query sees vectors of its project and global ones, and the filter comes before the top k.
    Up to FEW_QUERIES queries, found by counting, go to the vectors: nothing but k rows per query and partition is shuffled.
    More of them and the vectors meet in bounded blocks that are matrix-multiplied in a task; only k rows per query and block
    are shuffled afterwards.
    """
    v = vectors if doc_type is None else vectors.filter(F.col("doc_type") == doc_type)
    v = v.select("doc_id", "row_id", "project", "scope", "embedding")
    q = queries.select("query_id", "project", "embedding")
    nothing = F.lit(None).cast("string")
    few = q.limit(FEW_QUERIES + 1).toArrow()
    if len(few) <= FEW_QUERIES:
        hits = _in_place(few, v, k, by_project, queries.schema["query_id"].dataType)
    elif by_project:
        own = _blocked(q, v.withColumn("skip_project", nothing), k, "project")
        shared = _blocked(q, v.filter(F.col("scope") == "global").withColumn("skip_project", F.col("project")), k, None)
        hits = own.unionByName(shared)
    else:
        # a query's project does not matter here, not even if it has none
        hits = _blocked(q.withColumn("project", F.lit("")), v.withColumn("skip_project", nothing), k, None)
    order = W.partitionBy("query_id").orderBy(F.round("similarity", 9).desc(), F.col("doc_id"))
    return hits.withColumn(rank, F.row_number().over(order)).filter(F.col(rank) <= k)


def vector_search(queries: DataFrame, vectors: DataFrame, k: int, doc_type: str | None = None,
                  embedder: Embedder | None = None, by_project: bool = True, kind: str = "float") -> DataFrame:
    """``knn_join`` for query texts (query_id, project, query). ``kind`` is the precision of the query vectors."""
    model = embedder or get_embedder()
    # stored, because the model would otherwise run again for every branch that reads the query vectors
    emb = durable(embed_docs(queries.select("query_id", "project", "query"), text="query", embedder=model, kind=kind))
    return knn_join(emb, vectors, k, doc_type, by_project)


def threshold_filter(hits: DataFrame, threshold: float, max_results: int | None = None) -> DataFrame:
    """Hits of at least the threshold, optionally the first few per query in rank order."""
    kept = hits.filter(F.col("similarity") >= threshold)
    if not max_results:
        return kept
    order = W.partitionBy("query_id").orderBy(F.col("rank"), F.col("doc_id"))
    return kept.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= max_results).drop("_n")


def ids_dedup(hits: DataFrame, vectors: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_type, row_id, first_rank): each row once per type at its best rank.

    With ``queries`` (query_id, project) only rows of the query's project remain, or global ones for observations.
    """
    v = vectors.select("doc_id", "doc_type", "project", "scope")
    # a few hits go to the stored vectors, which are not shuffled to meet them
    j = broadcast_if_small(durable(hits), SMALL_HITS).join(v, "doc_id").filter(F.col("doc_type") != vocab.DOC_PATTERN)
    if queries is not None:
        q = queries.select("query_id", F.col("project").alias("_want"))
        shared = (F.col("doc_type") == vocab.DOC_OBSERVATION) & (F.col("scope") == "global")
        j = j.join(q, "query_id").filter((F.col("_want") == "") | (F.col("project") == F.col("_want")) | shared)
    return j.groupBy("query_id", "doc_type", "row_id").agg(F.min("rank").alias("first_rank"))


# reranking ------------------------------------------------------------------------------------------

def rerank(candidates: DataFrame, alpha: float = vocab.RERANK_ALPHA, limit: int | None = 10) -> DataFrame:
    """Blend of cross-encoder and first-stage score per query. Input: (query_id, doc_id, score, logit, original_rank)."""
    alpha = alpha if 0 < alpha <= 1 else vocab.RERANK_ALPHA
    z = sigmoid(F.col("logit"))
    return _ranked(candidates.withColumns({
        "rerank_score": z, "combined_score": alpha * z + (1 - alpha) * F.col("score")}), "combined_score", limit)


def rerank_pure(candidates: DataFrame, limit: int | None = 10) -> DataFrame:
    z = sigmoid(F.col("logit"))
    return _ranked(candidates.withColumns({"rerank_score": z, "combined_score": z}), "rerank_score", limit)


def _ranked(df: DataFrame, by: str, limit: int | None) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.round(by, 9).desc(), F.col("original_rank"))
    out = df.withColumn("rerank_rank", F.row_number().over(order)).withColumn(
        "rank_improvement", F.col("original_rank") - F.col("rerank_rank"))
    return out if limit is None else out.filter(F.col("rerank_rank") <= limit)


def variant_hits(hits: DataFrame, variants: DataFrame) -> DataFrame:
    """Weight the hits of query variants (hits.query_id = variants.variant_id) and give them back to their query."""
    w = variants.select(F.col("variant_id"), F.col("query_id").alias("_q"), "weight")
    return hits.withColumnRenamed("query_id", "variant_id").join(w, "variant_id").select(
        F.col("_q").alias("query_id"), "doc_id", "row_id", (F.col("similarity") * F.col("weight")).alias("similarity"), "rank")


def expand_query(queries: DataFrame, max_variants: int = 4) -> DataFrame:
    """One row per variant of (query_id, project, query), numbered from 0; variant_id is unique."""
    rows = queries.select("query_id", "project", F.posexplode(query_variants(F.col("query"), max_variants)).alias("variant_no", "v"))
    return rows.select("query_id", "project", "variant_no",
                       F.concat_ws("#", F.col("query_id").cast("string"), F.col("variant_no").cast("string")).alias("variant_id"),
                       "v.*")


def expand_vocab(queries: DataFrame, vocabulary: DataFrame, embedder: Embedder | None = None,
                 min_similarity: float = 0.5) -> DataFrame:
    """Variants from the two vocabulary terms nearest to each query that the query does not contain yet.

    ``vocabulary``: (term, weight). The nearest two are taken first, then terms already present are left out. Short terms
    are often equally near, so vectors are doubles here and nearness counts to nine places: floats would part the ties.
    """
    model = embedder or get_embedder()
    vocabulary = durable(vocabulary)
    terms = embed_docs(vocabulary.select("term", "weight"), text="term", embedder=model, keep_text=True, kind="double").select(
        F.col("term").alias("doc_id"), F.lit(0).cast("long").alias("row_id"), F.lit("").alias("project"),
        F.lit("global").alias("scope"), "embedding")
    hits = vector_search(queries, terms, 2, embedder=model, by_project=False, kind="double")
    near = hits.withColumn("cosine", F.round("similarity", 9) * 2 - 1).filter(F.col("cosine") >= min_similarity)
    j = near.select("query_id", F.col("doc_id").alias("term"), "cosine").join(vocabulary, "term").join(queries, "query_id")
    j = j.filter(~F.contains(F.lower("query"), F.lower("term")))
    return j.select("query_id", "project", F.concat_ws(" ", F.array_join(key_terms(F.col("query")), " "), "term").alias("query"),
                    (0.7 * F.col("cosine") * F.col("weight")).alias("weight"),
                    F.concat(F.lit("vocabulary:"), F.col("term")).alias("source"), F.lit("general").alias("intent"))
