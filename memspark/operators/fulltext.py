"""Keyword search: BM25 over token postings, and the substring fallback."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type

from memspark.functions.text import keywords
from memspark.operators.ordering import top_per_group
from memspark.session import broadcast_if_small, durable

K1, B = 1.2, 0.75
MIN_IDF = 1e-6
SMALL_KEYWORDS = 200_000
AUTOMATON_CHARACTERS = 4_000_000  # of the keywords that one pass over the texts looks for, about 300 MB in a worker
KEYWORD_CHARACTERS = 16_000_000   # of the keywords that one pass counts
SCORES_AT_ONCE = 1_000_000  # of a row, a query and a word they share, in a worker
PAIRS_AT_ONCE = 200_000  # of a text and a keyword it holds, in a worker
LIST_CELLS = 4_000_000     # lists times keywords whose k-th best ranks stand in a worker

OBSERVATION_FIELDS = ["title", "subtitle", "narrative"]
PATTERN_FIELDS = ["name", "description", "recommendation"]


def search_text(fields) -> Column:
    """The searched fields as one text. Workers lower its letters, once for equal texts."""
    return F.concat_ws("\n", *[F.col(f) for f in fields])


def query_keywords(queries: DataFrame) -> DataFrame:
    """(query_id, project, term) of the distinct keywords of each query."""
    return queries.select("query_id", "project", F.explode(keywords(F.col("query"))).alias("term"))


def word_parts(terms: DataFrame, characters: int) -> Iterator[tuple[int, list[str]]]:
    """The distinct terms in numbered parts by hash, of about ``characters`` each, so that a worker can hold one part."""
    words = terms.select("term").distinct()
    parts = -(-(words.agg(F.sum(F.length("term"))).first()[0] or 0) // characters)
    for part in range(parts):
        yield part, [r[0] for r in words.filter(F.pmod(F.xxhash64("term"), F.lit(parts)) == part).toLocalIterator()]


def counted_tokens(docs: DataFrame, fields, terms: DataFrame, kept: list[str]) -> DataFrame:
    """(id, kept columns, part, len, terms), stored: the number of tokens of each document, and an array of (term, tf) of
    those that some query asks for.

    Tokens are counted where the text is: no token becomes a row, and nothing is shuffled. Query terms beyond what a
    worker should hold are split by hash, with one row per document and part.
    """
    rows = docs.select("id", *kept, search_text(fields).alias("body"))
    pair = T.StructType([T.StructField("term", T.StringType()), T.StructField("tf", T.IntegerType())])
    schema = T.StructType([*rows.drop("body").schema.fields, T.StructField("part", T.IntegerType()),
                           T.StructField("len", T.IntegerType()), T.StructField("terms", T.ArrayType(pair))])
    out = None
    for part, words in word_parts(terms, KEYWORD_CHARACTERS):
        def count(batches: Iterator[pa.RecordBatch], part: int = part, words: list[str] = words) -> Iterator[pa.RecordBatch]:
            wanted, token = set(words), re.compile("[a-z0-9_]+")
            for batch in batches:
                lengths, ends, names, counts = [], [0], [], []
                for text in batch.column(batch.num_columns - 1).to_pylist():
                    tokens = token.findall(text.lower())
                    held = Counter(t for t in tokens if t in wanted)
                    lengths.append(len(tokens))
                    names.extend(held)
                    counts.extend(held.values())
                    ends.append(len(names))
                pairs = pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int32())], ["term", "tf"])
                columns = [*batch.columns[:-1], pa.array([part] * len(lengths), pa.int32()), pa.array(lengths, pa.int32()),
                           pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)]
                yield pa.RecordBatch.from_arrays(columns, schema_names)

        schema_names = schema.names
        counted = rows.mapInArrow(count, schema)
        out = counted if out is None else out.unionByName(counted)
    return durable(out if out is not None else docs.sparkSession.createDataFrame([], schema))


def term_weights(counted: DataFrame) -> DataFrame:
    """(term, idf, avg_len), stored."""
    corpus = counted.filter(F.col("part") == 0).agg(
        F.struct(F.count("*").cast("double").alias("n"), F.avg("len").alias("avg_len")).alias("c")).scalar()
    c = counted.select(F.explode("terms.term").alias("term")).groupBy("term").agg(
        F.count("*").cast("double").alias("df")).withColumn("c", corpus)
    idf = F.log((F.col("c.n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return durable(c.select("term", F.when(idf > 0, idf).otherwise(F.lit(MIN_IDF)).alias("idf"), F.col("c.avg_len").alias("avg_len")))


def _impact() -> Column:
    """What one term adds to the score of a document."""
    return F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))


def _counted_classes(docs: DataFrame, fields, words: list[str], kept: list[str]) -> DataFrame:
    """(docs, len, codes, tfs), stored: one row per text that occurs in a batch, with the rows that have it, its number of
    tokens, and the numbers and counts of those that some query asks for. Nothing is shuffled."""
    rows = docs.select("id", *kept, search_text(fields).alias("body"))
    ints = T.ArrayType(T.IntegerType())
    schema = T.StructType([T.StructField("docs", T.ArrayType(T.StructType(rows.drop("body").schema.fields))), T.StructField("len", T.IntegerType()),
                           T.StructField("codes", ints), T.StructField("tfs", ints)])
    names = rows.columns[:-1]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, token = {word: n for n, word in enumerate(words)}, re.compile("[a-z0-9_]+")
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).dictionary_encode()
            at = texts.indices.to_numpy(zero_copy_only=False)
            lengths, ends, codes, tfs = [], [0], [], []
            for text in texts.dictionary.to_pylist():
                tokens = token.findall(text.lower())
                held = Counter(code[t] for t in tokens if t in code)
                lengths.append(len(tokens))
                codes.extend(held)
                tfs.extend(held.values())
                ends.append(len(codes))
            members = pa.StructArray.from_arrays(batch.columns[:-1], names).take(pa.array(np.argsort(at, kind="stable")))
            of = np.append(0, np.cumsum(np.bincount(at, minlength=len(lengths))))
            ends = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays([
                pa.ListArray.from_arrays(pa.array(of, pa.int32()), members), pa.array(lengths, pa.int32()),
                pa.ListArray.from_arrays(ends, pa.array(codes, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(tfs, pa.int32()))],
                ["docs", "len", "codes", "tfs"])

    return durable(rows.mapInArrow(count, schema))


def _scored_in_place(classes: DataFrame, asked: pa.Table, words: list[str], scoped: bool, carried: tuple[str, ...]) -> DataFrame:
    """``bm25_scores`` from the stored texts, scored where they are. A text is scored once for all queries; its rows take the
    scores of the queries that see them."""
    corpus = classes.agg(F.sum(F.size("docs")).alias("n"), F.sum(F.col("len").cast("long") * F.size("docs")).alias("tokens")).first()
    n, avg = float(corpus["n"] or 0), (corpus["tokens"] or 0) / (corpus["n"] or 1)
    counts = classes.select(F.explode("codes").alias("code"), F.size("docs").alias("rows")).groupBy("code").agg(F.sum("rows").alias("df")).toArrow()
    df = np.zeros(len(words))
    df[counts["code"].to_numpy()] = counts["df"].to_numpy()
    idf = np.log((n - df + 0.5) / (df + 0.5))
    idf = np.where(idf > 0, idf, MIN_IDF)
    # the queries of each word: ask[first[word]:first[word] + times[word]]
    ids = pc.unique(asked["query_id"])
    word, query = (pc.index_in(asked[c], value_set=v).to_numpy() for c, v in (("term", pa.array(words, pa.string())), ("query_id", ids)))
    order = np.argsort(word, kind="stable")
    ask, times = query[order], np.bincount(word, minlength=len(words))
    first = np.cumsum(times) - times
    # a query's rows carry its project
    one = np.zeros(len(ids), "int64")
    one[query] = np.arange(len(query))
    owner = asked["project"].take(pa.array(one)).combine_chunks()
    projects = pc.unique(owner).drop_null()
    owner = np.nan_to_num(pc.index_in(owner.cast(pa.string()), value_set=projects).to_numpy(zero_copy_only=False).astype("float64"), nan=-2).astype("int64")
    fields = {f.name: f for f in classes.schema["docs"].dataType.elementType.fields}
    out = T.StructType([T.StructField("query_id", from_arrow_type(asked["query_id"].type)), fields["id"], T.StructField("score", T.DoubleType()),
                        *[fields[c] for c in carried]])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = batch.column("docs")
            codes, tf = (batch.column(c).flatten().to_numpy() for c in ("codes", "tfs"))
            lengths = batch.column("len").to_numpy()
            held, members = (pc.list_value_length(batch.column(c)).to_numpy() for c in ("codes", "docs"))
            text = np.repeat(np.arange(len(lengths)), held)
            part = idf[codes] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[text] / avg))
            meets = np.bincount(text, times[codes], minlength=len(lengths)) * np.maximum(members, 1)
            begin = np.cumsum(members) - members
            rows = docs.flatten()
            names = {f.name: k for k, f in enumerate(rows.type)}
            if scoped:
                home = np.nan_to_num(pc.index_in(rows.field(names["project"]), value_set=projects).to_numpy(zero_copy_only=False).astype("float64"),
                                     nan=-1).astype("int64")
                shared = pc.fill_null(pc.equal(rows.field(names["scope"]), "global"), False).to_numpy(zero_copy_only=False)
            starts = np.cumsum(held) - held
            for some in np.split(np.arange(len(lengths)), np.flatnonzero(np.diff(np.cumsum(meets) // SCORES_AT_ONCE)) + 1):
                if not len(some):
                    continue
                e = np.arange(starts[some[0]], starts[some[-1]] + held[some[-1]])
                c = codes[e]
                m = times[c]
                cell = np.repeat((text[e] - some[0]) * len(ids), m) + ask[np.arange(m.sum()) - np.repeat(np.cumsum(m) - m - first[c], m)]
                cells, at = np.unique(cell, return_inverse=True)
                scores = np.bincount(at, np.repeat(part[e], m))
                of, q = np.divmod(cells, len(ids))
                of += some[0]
                k = members[of]
                pair = np.repeat(np.arange(len(cells)), k)
                row = np.arange(len(pair)) - np.repeat(np.cumsum(k) - k - begin[of], k)
                if scoped:
                    sees = shared[row] | (home[row] == owner[q[pair]])
                    pair, row = pair[sees], row[sees]
                taken = pa.array(row)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(q[pair])), rows.field(names["id"]).take(taken), pa.array(scores[pair], pa.float64()),
                                                  *[rows.field(names[f]).take(taken) for f in carried]], out.names)

    return classes.mapInArrow(score, out)


def bm25_scores(docs: DataFrame, fields, terms: DataFrame, scoped: bool = True, carried: tuple[str, ...] = ()) -> DataFrame:
    """(query_id, id, score, carried columns) of documents that contain any of a query's terms.

    Up to SMALL_KEYWORDS keywords go to the documents, which are scored in place; the scores are not shuffled. More of them
    meet the counted tokens in joins: with ``scoped``, a query meets documents of its project through a (term, project) join
    and global documents of other projects through a second join. What a ranking needs beside the score is carried, so
    documents are read once.
    """
    kept = [*(["project", "scope"] if scoped else []), *carried]
    asked = terms.select("query_id", "project", "term").distinct().limit(SMALL_KEYWORDS + 1).toArrow()
    if len(asked) <= SMALL_KEYWORDS:
        words = sorted(pc.unique(asked["term"]).to_pylist())
        askers = len(asked.select(["query_id", "project"]).group_by(["query_id", "project"]).aggregate([]))
        if sum(map(len, words)) <= KEYWORD_CHARACTERS and askers == len(pc.unique(asked["query_id"])):  # one project per query
            return _scored_in_place(_counted_classes(docs, fields, words, kept), asked, words, scoped, carried)
    counted = counted_tokens(docs, fields, terms, kept)
    q = broadcast_if_small(terms.join(term_weights(counted), "term"), SMALL_KEYWORDS)
    tf = counted.select("id", *kept, "len", F.inline("terms"))
    out = ["query_id", "id", *carried, _impact().alias("p")]
    if not scoped:
        hits = tf.join(q, "term").select(*out)
    else:
        q = q.withColumnRenamed("project", "q_project")
        own = tf.join(q, (tf["term"] == q["term"]) & (tf["project"] == q["q_project"]))
        shared = tf.filter(F.col("scope") == "global").join(q, "term").filter(~F.col("project").eqNullSafe(F.col("q_project")))
        hits = own.select(*out).unionByName(shared.select(*out))
    return hits.groupBy("query_id", "id").agg(F.sum("p").alias("score"), *[F.max(c).alias(c) for c in carried])


def _lists(scope: Column, project: Column) -> Column:
    """Lists that a row stands in, as an array of (shared, owner): its project's, and that of all global rows."""
    own = F.struct(F.lit(False).alias("shared"), project.alias("owner"))
    everyone = F.struct(F.lit(True).alias("shared"), F.lit("").alias("owner"))
    return F.when(scope == "global", F.array(own, everyone)).otherwise(F.array(own))


def _seen_lists(terms: DataFrame) -> DataFrame:
    """(query_id, term, shared, owner): the two lists that a query sees."""
    return terms.select("query_id", "term", F.inline(_lists(F.lit("global"), F.col("project"))))


LIST = ["term", "shared", "owner"]


def search_fts(obs: DataFrame, queries: DataFrame, limit: int = 10) -> DataFrame:
    """(query_id, id, score, rank): best observations visible to the query's project."""
    docs = obs.withColumn("_imp", F.coalesce("importance_score", F.lit(1.0)))
    scored = bm25_scores(docs, OBSERVATION_FIELDS, durable(query_keywords(queries)), carried=("_imp",))
    order = [F.round("score", 9).desc(), F.col("_imp").desc(), F.col("id").asc()]
    return top_per_group(scored, "query_id", order, limit, "rank").drop("_imp")


def class_scores(counted: DataFrame, terms: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(asked, query_id), (alike, id, status) and (asked, alike, score): BM25 of classes, as a score depends on a query's
    keywords and on a document's length and counts alone. Queries with equal keywords are one class, and so are documents
    with equal length and counts, so repeated queries and documents do not multiply."""
    words = terms.groupBy("query_id").agg(F.array_sort(F.collect_set("term")).alias("words"))
    queries = durable(words.withColumn("asked", F.sha2(F.array_join("words", " "), 256)))
    docs = counted.groupBy("id", "status", "len").agg(F.array_sort(F.flatten(F.collect_list("terms"))).alias("terms"))
    docs = durable(docs.filter(F.size("terms") > 0).withColumn("alike", F.sha2(F.to_json(F.struct("len", "terms")), 256)))
    asked = queries.groupBy("asked").agg(F.first("words").alias("words")).select("asked", F.explode("words").alias("term"))
    tf = docs.groupBy("alike").agg(F.first("len").alias("len"), F.first("terms").alias("terms")).select("alike", "len", F.inline("terms"))
    q = broadcast_if_small(asked.join(term_weights(counted), "term"), SMALL_KEYWORDS)
    scores = tf.join(q, "term").groupBy("asked", "alike").agg(F.sum(_impact()).alias("score"))
    return queries.select("asked", "query_id"), docs.select("alike", "id", "status"), scores


def search_patterns_fts(patterns: DataFrame, queries: DataFrame, limit: int = 10) -> DataFrame:
    """The same over active patterns; every project sees them. Statistics come from all patterns.

    Classes are scored. A class of documents offers its ``limit`` least ids, and a class of queries looks at its ``limit``
    best classes of documents, which hold its best rows.
    """
    terms = durable(query_keywords(queries))
    asked, alike, scores = class_scores(counted_tokens(patterns, PATTERN_FIELDS, terms, ["status"]), terms)
    ids = durable(top_per_group(alike.filter(F.col("status") == "active"), "alike", [F.col("id").asc()], limit, "_n"))
    order = [F.round("score", 9).desc(), F.col("id").asc()]
    heads = scores.join(ids.filter(F.col("_n") == 1).select("alike", "id"), "alike")
    best = top_per_group(heads, "asked", order, limit, "_r").select("asked", "alike", "score")
    rows = top_per_group(best.join(ids.select("alike", "id"), "alike"), "asked", order, limit, "rank")
    return asked.join(rows, "asked").select("query_id", "id", "score", "rank")


# substrings ------------------------------------------------------------------------------------------

class _ListsSoFar:
    """The rank of the k-th best row so far of every list (a project's or the global one) and keyword, within one task.

    A rank is (importance, time); rows of equal rank all stay, since the id decides between them later. Beyond
    LIST_CELLS lists and keywords it starts anew, which only lets more rows through.
    """

    def __init__(self, words: int, k: int):
        self.words, self.k = words, k
        self._forget()

    def _forget(self) -> None:
        self.owners: dict[str | None, int] = {}
        self.least = np.full(self.words, -np.inf)
        self.since = np.full(self.words, np.iinfo("int64").min)
        self.held = [(np.zeros(0, "int64"), np.zeros(0), np.zeros(0, "int64"))]
        self.settled = self.fresh = 0

    def numbers(self, owners: pa.Array) -> np.ndarray | None:
        """The numbers of the lists of these projects, 0 being the global list; none if they alone are too many."""
        coded = owners.dictionary_encode(null_encoding="encode")
        names = coded.dictionary.to_pylist()
        if (len(self.owners) + len(names) + 1) * self.words > LIST_CELLS:
            self._forget()
            if (len(names) + 1) * self.words > LIST_CELLS:
                return None
        at = np.array([self.owners.setdefault(name, len(self.owners) + 1) for name in names], "int64")
        grown = (len(self.owners) + 1) * self.words - len(self.least)
        self.least = np.append(self.least, np.full(grown, -np.inf))
        self.since = np.append(self.since, np.full(grown, np.iinfo("int64").min))
        return at[coded.indices.to_numpy(zero_copy_only=False)]

    def _open(self, cell: np.ndarray, importance: np.ndarray, created: np.ndarray) -> np.ndarray:
        least = self.least[cell]
        return (importance > least) | ((importance == least) & (created >= self.since[cell]))

    def keep(self, own: np.ndarray, shared: np.ndarray, word: np.ndarray, importance: np.ndarray, created: np.ndarray) -> np.ndarray:
        """Which (row, keyword) may be among the k best of a list."""
        cell = np.concatenate([own * self.words + word, word[shared]])
        row = np.concatenate([np.arange(len(word)), np.flatnonzero(shared)])
        open_ = self._open(cell, importance[row], created[row])
        cell, row = cell[open_], row[open_]
        self.held.append((cell, importance[row], created[row]))
        self.fresh += len(cell)
        if self.fresh > self.settled // 2:
            self._cut()
            open_ = self._open(cell, importance[row], created[row])
            row = row[open_]
        kept = np.zeros(len(word), bool)
        kept[row] = True
        return kept

    def _cut(self) -> None:
        cell, importance, created = (np.concatenate(x) for x in zip(*self.held, strict=True))
        order = np.lexsort((-created, -importance, cell))
        cell, importance, created = cell[order], importance[order], created[order]
        first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])) if len(cell) else np.zeros(0, "int64")
        place = np.arange(len(cell)) - np.repeat(first, np.diff(np.append(first, len(cell))))
        last = place == self.k - 1
        self.least[cell[last]], self.since[cell[last]] = importance[last], created[last]
        best = place < self.k
        self.held = [(cell[best], importance[best], created[best])]
        self.settled, self.fresh = int(best.sum()), 0


def keywords_within(body: Column, words: list[str], owner: Column, shared: Column, importance: Column, created: Column, k: int) -> Column:
    """The distinct ones of ``words`` that occur anywhere in a text, found by one automaton in one pass over it, without those
    for which the task has met k better rows already in every list that the row stands in. Letters are lowered; equal texts of a
    batch are searched once."""
    @F.arrow_udf("array<string>")
    def found(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        automaton = ahocorasick.Automaton()
        for n, word in enumerate(words):
            automaton.add_word(word, n)
        automaton.make_automaton()
        names, lists = pa.array(words, pa.string()), _ListsSoFar(len(words), k)
        for texts, owners, global_, score, time in batches:
            coded = texts.dictionary_encode()
            hits = [np.fromiter(sorted({n for _, n in automaton.iter(text.lower())}), "int64") for text in coded.dictionary.to_pylist()]
            sizes, flat = np.array([len(x) for x in hits], "int64"), np.concatenate([*hits, np.zeros(0, "int64")])
            starts = np.cumsum(sizes) - sizes
            text = coded.indices.to_numpy(zero_copy_only=False)
            seen = global_.fill_null(False).to_numpy(zero_copy_only=False)
            score = score.to_numpy(zero_copy_only=False)
            score = np.where(np.isnan(score), np.inf, score)  # as in Spark's order; what ties stays
            # a row without a time comes last; the least number itself has no negative
            time = np.maximum(time.fill_null(np.iinfo("int64").min + 1).to_numpy(zero_copy_only=False), np.iinfo("int64").min + 1)
            own, kept, kept_of = lists.numbers(owners), [np.zeros(0, "int64")], [np.zeros(0, "int64")]
            best = np.lexsort((-time, -score))  # the best rows first, so that most of the others find the lists full
            parts = np.cumsum(sizes[text[best]]) // PAIRS_AT_ONCE
            for rows in np.split(best, np.flatnonzero(np.diff(parts)) + 1):
                n = sizes[text[rows]]
                row, before = np.repeat(rows, n), np.cumsum(n) - n
                word = flat[np.arange(len(row)) - np.repeat(before - starts[text[rows]], n)]
                stays = np.ones(len(word), bool) if own is None else lists.keep(own[row], seen[row], word, score[row], time[row])
                kept.append(word[stays])
                kept_of.append(row[stays])
            kept, kept_of = np.concatenate(kept), np.concatenate(kept_of)
            ends = np.append(0, np.cumsum(np.bincount(kept_of, minlength=len(text))))
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), names.take(pa.array(kept[np.argsort(kept_of, kind="stable")])))

    return found(body, owner, shared, importance.cast("double"), created.cast("long"))


def search_like(obs: DataFrame, queries: DataFrame, limit: int = 10) -> DataFrame:
    """(query_id, id, rank): observations with any keyword as a substring of title, subtitle or narrative.

    One automaton over all keywords runs once over each text, in place; only the keywords that a text holds leave it.
    Keywords beyond what one automaton should hold are split by hash, with one pass over the texts per part. Rows are
    ranked by themselves alone, so each keyword keeps its ``limit`` best rows per project and its ``limit`` best global
    rows, and a query merges the lists of its keywords. What a task has ``limit`` better rows for does not leave it.
    """
    terms = durable(query_keywords(queries))
    score = F.coalesce("importance_score", F.lit(1.0))
    order = [score.desc(), F.col("created_at_epoch").desc(), F.col("id").desc()]
    kept = ["id", "project", "scope", "importance_score", "created_at_epoch"]
    found = None
    for _, words in word_parts(terms, AUTOMATON_CHARACTERS):
        if words:
            held = keywords_within(search_text(OBSERVATION_FIELDS), words, F.col("project"), F.col("scope") == "global", score,
                                   F.col("created_at_epoch"), limit)
            hits = obs.select(*kept, F.explode(held).alias("term"))
            found = hits if found is None else found.unionByName(hits)
    if found is None:
        return terms.select("query_id").join(obs.select("id"), F.lit(False)).withColumn("rank", F.lit(0))
    lists = found.select("term", *kept, F.inline(_lists(F.col("scope"), F.col("project")))).drop("project", "scope")
    best = top_per_group(lists, LIST, order, limit, "_r")
    merged = _seen_lists(terms).join(best, LIST).select("query_id", "id", "importance_score", "created_at_epoch").distinct()
    return top_per_group(merged, "query_id", order, limit, "rank").select("query_id", "id", "rank")


def search_text_with_fallback(obs: DataFrame, queries: DataFrame, limit: int = 10) -> DataFrame:
    """``search_fts``, and ``search_like`` for the queries it finds nothing for, if there are any."""
    fts = durable(search_fts(obs, queries, limit).select("query_id", "id", "rank"))
    rest = queries.join(fts.select("query_id").distinct(), "query_id", "left_anti")
    return fts if rest.isEmpty() else fts.unionByName(search_like(obs, rest, limit))
