"""I-Match fingerprints over randomised lexicons, in DataFrame functions only.

The lexicon is the terms inside a band of inverse document frequency. Each randomised lexicon keeps a random part of it, from
a half down to a small share, so that texts of any length have lexicons with few of their terms. A text's fingerprint is one
hash per randomised lexicon, over the text's distinct terms in that lexicon in sorted order; a lexicon that survives an edit
gives an equal hash. Document frequencies are counted over the whole table for hashed terms; the band is a bit map of fixed
size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from memspark.llm import common

#: Terms are numbered by their hash modulo this.
TERM_SPACE = 1 << 22
#: The band: terms of at least two documents and this share of all, and at most that share.
LEAST_SHARE, MOST_SHARE = 0.0001, 0.05
#: Randomised lexicons: so many at each of the scales; a scale keeps 1/2, 1/8, 1/32, ... of the terms.
DRAWS, SCALES = 16, 6
EMPTY = "--------"


def _number(word: Column) -> Column:
    return F.hash(word).bitwiseAND(F.lit(TERM_SPACE - 1))


def term_numbers(text: Column) -> Column:
    """Distinct numbers of the lower-case words of a text, sorted."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+")
    return F.sort_array(F.array_remove(F.array_distinct(F.transform(words, _number)), _number(F.lit(""))))


def lexicon(df: DataFrame, text: str) -> DataFrame:
    """One row with a bit map of the term numbers inside the band, as an array of longs."""
    spark = df.sparkSession
    terms = df.select(term_numbers(F.col(text)).alias("terms"))
    counts = common.stored(terms.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")))
    total = df.count()
    band = counts.where((F.col("n") >= max(2, LEAST_SHARE * total)) & (F.col("n") <= max(2, MOST_SHARE * total)))
    words = band.groupBy(F.shiftright("term", 6).alias("id")).agg(
        F.bit_or(F.expr("shiftleft(1L, term % 64)")).alias("bits"))
    full = spark.range(TERM_SPACE // 64).join(words, "id", "left").select("id", F.coalesce("bits", F.lit(0)).alias("bits"))
    ordered = F.array_sort(F.collect_list(F.struct("id", "bits")))  # TERM_SPACE / 64 entries, whatever the table's size
    return common.stored(full.agg(ordered.alias("a")).select(F.transform("a", lambda x: x["bits"]).alias("bits")))


def with_fingerprint(df: DataFrame, text: str, bits: DataFrame, name: str) -> DataFrame:
    """Add column ``name``: the hash of the whole lexicon's terms (of all terms, if none is in it), then one hash per
    randomised lexicon, null where the text has none of its terms."""
    df = df.withColumn("_terms", term_numbers(F.col(text))).withColumn("_all", F.xxhash64("_terms"))
    # the bit map is used once and dropped in the same step, so that it never becomes a column of the rows
    inside = F.filter("_terms", lambda t: F.getbit(F.col("_bits")[F.shiftright(t, 6)], t.bitwiseAND(F.lit(63))) == 1)
    df = df.withColumn("_bits", bits.scalar()).withColumn("_in", inside).drop("_bits", "_terms")
    df = df.withColumn("_h", F.when(F.size("_in") > 0, F.xxhash64("_in")).otherwise(F.col("_all"))).drop("_all")
    parts, hashes = [F.col("_in")] * DRAWS, [F.col("_h")]
    for scale in range(SCALES):
        columns = {}
        for draw in range(DRAWS):
            # 1/2 at first, then 1/4 of that
            mask = F.lit(1 if scale == 0 else 3 << 2 * scale - 1)
            columns[f"_s{scale}_{draw}"] = F.filter(parts[draw], lambda t: F.hash(t, F.lit(draw)).bitwiseAND(mask) == 0)  # noqa: B023
        df = df.withColumns(columns)
        names = list(columns)
        df = df.withColumns({f"_h{c}": F.when(F.size(c) > 0, F.xxhash64(c)) for c in names})
        if scale:
            df = df.drop(*[f"_s{scale - 1}_{draw}" for draw in range(DRAWS)])
        parts = [F.col(c) for c in names]
        hashes += [F.col(f"_h{c}") for c in names]
    low = F.transform(F.array(*hashes), lambda h: h.bitwiseAND(F.lit(0xFFFFFFFF)))
    return df.withColumn(name, low).drop("_in", "_h", *[c for c in df.columns if c.startswith(("_s", "_h_"))])


def as_text(fingerprint: Column) -> Column:
    return F.array_join(F.transform(fingerprint, lambda h: F.coalesce(F.lower(F.lpad(F.hex(h), 8, "0")), F.lit(EMPTY))), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal hashes among the randomised lexicons that either text has terms of; 1 for equal fingerprints.

    Lexicons that keep too much say nothing, as one changed term changes their hash. So only those scales count where at
    least a quarter of the lexicons are empty, and the smallest; if they are all empty, every scale counts.
    """
    def hits(wide: bool) -> Column:
        return F.concat(*[_scale_hits(a, b, s, wide or s == SCALES - 1) for s in range(SCALES)],
                        *([_hits(a, b, 1, 1)] if wide else []))

    def share(h: Column) -> Column:
        return F.size(F.filter(h, lambda p: p)) / F.size(h)

    return F.when(F.size(hits(False)) > 0, share(hits(False))).otherwise(share(hits(True)))


def _hits(a: Column, b: Column, start: int, n: int) -> Column:
    """Per slot that either text fills, whether the hashes are equal."""
    pairs = F.zip_with(F.slice(a, start, n), F.slice(b, start, n), lambda x, y: F.when(
        x.isNotNull() | y.isNotNull(), F.coalesce(x == y, F.lit(False))))
    return F.filter(pairs, lambda p: p.isNotNull())


def _scale_hits(a: Column, b: Column, scale: int, always: bool) -> Column:
    hits = _hits(a, b, 2 + scale * DRAWS, DRAWS)
    return hits if always else F.when(F.size(hits) <= DRAWS * 3 // 4, hits).otherwise(F.slice(hits, 1, 0))


def with_next(df: DataFrame, key: str, columns: list[str], buckets: int) -> DataFrame:
    """Add ``next_<c>`` for each of ``columns``: the value in the next row by descending key (null keys last, equal keys by the
    columns); the first row follows the last.

    Rows are dealt to key ranges between approximate quantiles. A quantile is a key of the table and the first of its range,
    so its row is also sent to the range before, where it closes the chain; no row sees more than its own range.
    """
    shares = [(i + 1) / buckets for i in range(buckets)]
    bounds = df.agg(F.percentile_approx(key, shares, 10 * buckets)).first()[0] or []
    bounds = sorted(set(bounds))
    if not bounds:
        place, follows = F.lit(0), F.lit(None).cast("int")
    else:
        steps = [1 << i for i in range(len(bounds).bit_length() - 1, -1, -1)]
        found = F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda at, s: F.when(
            (at + s <= len(bounds)) & (F.element_at(F.col("_bounds"), at + s) < F.col(key)), at + s).otherwise(at))
        place = F.coalesce(F.least(found, F.lit(len(bounds) - 1)), F.lit(0))
        head = F.element_at(F.col("_bounds"), F.col("_range") + 1) == F.col(key)
        follows = F.when(head, (F.col("_range") + 1) % len(bounds))
    ranged = df.withColumn("_bounds", F.lit(bounds) if bounds else F.lit(None)).withColumn("_range", place)
    ranged = ranged.withColumn("_at", F.explode(F.array_compact(F.array(
        F.struct(F.col("_range").alias("range"), F.lit(False).alias("copy")),
        F.when(follows.isNotNull(), F.struct(follows.alias("range"), F.lit(True).alias("copy")))))))
    ranged = ranged.withColumns({"_range": F.col("_at.range"), "_copy": F.col("_at.copy")}).drop("_at", "_bounds")
    order = Window.partitionBy("_range").orderBy("_copy", F.col(key).desc_nulls_last(), *columns)
    first = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    moved = F.struct(*columns)
    ranged = ranged.withColumn("_next", F.coalesce(F.lead(moved).over(order), F.first(moved).over(first) if not bounds else F.lit(None)))
    return ranged.where("not _copy").select(
        *df.columns, *[F.col("_next")[c].alias(f"next_{c}") for c in columns])


def fingerprint_edits(df: DataFrame, key: str, text: str) -> DataFrame:
    """Fingerprint every text and an edited text, and compare.

    The edited text has its last floor(n/2) code points replaced by the first as many (or all) of the next document's, in
    descending order of ``key`` (the first follows the last; rows of equal keys in order of their texts; null keys last). Returns
    ``key``, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. A null text counts as empty;
    texts without any word share one fingerprint. A single row follows itself. An empty table gives no rows. ``key`` must be a
    number. Other columns are not read.
    """
    spark = df.sparkSession
    docs = df.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    bits = lexicon(docs, "text")
    own = with_fingerprint(docs, "text", bits, "own")
    chain = with_next(own.select("key", "text", "own"), "key", ["text", "own"], 4 * common.shuffle_partitions(spark))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    chain = chain.select("key", n.cast("long").alias("n_chars"), "own", "next_own", edited.alias("edited"))
    chain = with_fingerprint(chain.withColumn("edited_sha256", F.sha2("edited", 256)), "edited", bits, "other")
    return chain.select(
        F.col("key").alias(key), "n_chars", "edited_sha256", as_text(F.col("own")).alias("fingerprint"),
        as_text(F.col("other")).alias("edited_fingerprint"), likeness(F.col("own"), F.col("other")).alias("near_edited"),
        likeness(F.col("own"), F.col("next_own")).alias("near_next"))
