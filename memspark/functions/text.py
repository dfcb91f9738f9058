"""Text expressions: tokenizers, signatures, query intent. All but ``holds_any`` are native Column expressions."""

from __future__ import annotations

import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from memspark import vocab

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PUNCTUATION = ".,?!;:'\"()[]{}"


def str_array(values) -> Column:
    """A literal array<string>."""
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def strip(text: Column) -> Column:
    """Trim all white space on both sides, line breaks included."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def empty_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def count_present(text: Column, phrases) -> Column:
    """How many of the phrases occur in the text."""
    def count(t: Column) -> Column:
        total = F.lit(0)
        for p in phrases:
            total = total + F.contains(t, F.lit(p)).cast("int")
        return total

    return let(text, count)


def contains_any(text: Column, phrases, ignore_case: bool = False) -> Column:
    """Whether any of the phrases occurs, in one pass over the text; ``ignore_case`` folds ASCII letters only."""
    pattern = "|".join(re.escape(p) for p in phrases)
    return text.rlike(f"(?i){pattern}" if ignore_case else pattern)


def holds_any(text: Column, phrases) -> Column:
    """``contains_any`` with ``ignore_case`` for long texts: by an automaton over Arrow columns, whose time does not depend on
    the number of phrases. No text holds nothing."""
    def either(c: str) -> str:
        return f"[{c.lower()}{c.upper()}]" if c.isascii() and c.isalpha() else re.escape(c)

    pattern = "|".join("".join(map(either, p)) for p in phrases)

    @F.arrow_udf("boolean")
    def held(texts: pa.Array) -> pa.Array:
        return pc.fill_null(pc.match_substring_regex(texts, pattern), False)

    return held(text)


def truncate_text(text: Column, n: int) -> Column:
    t = strip(text)
    return F.when(F.length(t) > n, F.concat(F.substring(t, 1, n), F.lit("..."))).otherwise(t)


def tokens(text: Column, min_len: int, stopwords) -> Column:
    """Distinct lower-case [a-z0-9_] tokens of at least min_len characters, first-seen order, minus stop words."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9_]{%d,}" % min_len), F.lit(0))
    return F.array_except(found, str_array([w for w in stopwords if len(w) >= min_len]))


def base_names(files: Column) -> Column:
    return F.transform(F.coalesce(files, F.array().cast("array<string>")),
                       lambda f: F.lower(F.substring_index(f, "/", -1)))


def observation_terms(title="title", narrative="narrative", facts="facts", files_read="files_read",
                      files_modified="files_modified") -> Column:
    """Term set used for similarity: words of title, narrative and facts, plus base names of the files."""
    text = F.concat_ws(" ", F.col(title), F.col(narrative), F.array_join(F.col(facts), " "))
    return F.array_union(
        tokens(text, 3, vocab.SIMILARITY_STOPWORDS),
        F.array_union(base_names(F.col(files_read)), base_names(F.col(files_modified))),
    )


def text_terms(text: Column) -> Column:
    return tokens(text, 3, vocab.SIMILARITY_STOPWORDS)


def keywords(text: Column) -> Column:
    """Distinct search keywords: at least four characters, first-seen order."""
    return tokens(text, 4, vocab.FTS_STOPWORDS)


def key_terms(query: Column) -> Column:
    """White-space words without surrounding punctuation; duplicates and order are kept."""
    words = F.split(F.lower(strip(query)), r"\s+")
    bare = F.transform(words, lambda w: F.btrim(w, F.lit(_PUNCTUATION)))
    stop = str_array(vocab.QUERY_STOPWORDS)
    return F.filter(bare, lambda w: (F.length(w) >= 2) & ~F.array_contains(stop, w))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard of two arrays without duplicates: two empty sets give 1, one empty set gives 0."""
    total = F.size(a) + F.size(b)
    share = let(F.size(F.array_intersect(a, b)), lambda inter: inter / (total - inter))
    return F.when(total == 0, F.lit(1.0)).otherwise(share)


def signature(concepts: Column, title: Column) -> Column:
    """Pattern signature: the concepts, then longer title words, distinct in order."""
    words = F.split(F.coalesce(title, F.lit("")), r"[ \-_.,]")
    stop = str_array(vocab.SIGNATURE_STOPWORDS)
    keep = F.filter(words, lambda w: (F.octet_length(w) > 3) & ~F.array_contains(stop, ascii_lower(w)))
    return F.array_distinct(
        F.concat(F.coalesce(concepts, F.array().cast("array<string>")), F.transform(keep, ascii_lower))
    )


def match_score(sig1: Column, sig2: Column) -> Column:
    """Signature overlap: matches are counted over the second list, duplicates included."""
    s1 = F.transform(sig1, ascii_lower)
    matches = F.size(F.filter(sig2, lambda w: F.array_contains(s1, ascii_lower(w))))
    union = F.size(sig1) + F.size(sig2) - matches
    return F.when((F.size(sig1) == 0) | (F.size(sig2) == 0), F.lit(0.0)).otherwise(matches / union)


def pattern_type(concepts: Column, title: Column, narrative: Column) -> Column:
    """First telling concept in array order, else bug when a bug keyword occurs, else refactor."""
    telling = F.filter(concepts, lambda c: c.isin("anti-pattern", "best-practice", "architecture", "refactor"))
    content = F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(narrative, F.lit("")))
    # only texts that the concepts leave open are looked into
    is_bug = holds_any(F.when(F.coalesce(F.size(telling), F.lit(0)) <= 0, content), vocab.BUG_KEYWORDS)
    return (F.when(F.size(telling) > 0, F.get(telling, 0))
            .when(is_bug, F.lit("bug")).otherwise(F.lit("refactor")))


def pattern_name(ptype: Column, sig: Column, title: Column) -> Column:
    prefix = F.lit("")
    for t, p in vocab.PATTERN_NAME_PREFIX.items():
        prefix = F.when(ptype == t, F.lit(p)).otherwise(prefix)
    generated = F.concat(prefix, F.when(F.size(sig) > 0, F.array_join(F.slice(sig, 1, 3), ", "))
                         .otherwise(F.lit("Unnamed")))
    usable = (F.coalesce(title, F.lit("")) != "") & (F.octet_length(title) < 60)
    return F.when(usable, title).otherwise(generated)


def pattern_insight(ptype: Column, frequency: Column, projects: Column, recommendation: Column) -> Column:
    tail = F.lit(vocab.PATTERN_INSIGHT_DEFAULT)
    for t, sentence in vocab.PATTERN_INSIGHT_TAIL.items():
        tail = F.when(ptype == t, F.lit(sentence)).otherwise(tail)
    across = F.when(F.size(projects) > 1,
                    F.concat(F.lit(" across "), F.size(projects).cast("string"), F.lit(" projects"))
                    ).otherwise(F.lit(""))
    advice = F.when(F.coalesce(recommendation, F.lit("")) != "",
                    F.concat(F.lit("What works: "), recommendation)).otherwise(tail)
    return F.concat(F.lit("I've encountered this pattern "), frequency.cast("string"), F.lit(" times"), across,
                    F.lit(". "), advice)


def candidate_key(sig: Column) -> Column:
    return F.array_join(F.transform(sig, lambda s: F.concat(s, F.lit("|"))), "")


def query_intent(query: Column) -> Column:
    q = strip(query)
    out = F.lit("general")
    for intent, patterns in reversed(vocab.INTENT_PATTERNS):
        hit = F.lit(False)
        for p in patterns:
            hit = hit | q.rlike(p)
        out = F.when(hit, F.lit(intent)).otherwise(out)
    return F.when(q == "", F.lit("general")).otherwise(out)


def make_declarative(query: Column) -> Column:
    """Drop one trailing question mark, then the first matching question prefix."""
    q = F.regexp_replace(strip(query), r"\?$", "")
    low = F.lower(q)
    out = q
    for p in reversed(vocab.QUESTION_PREFIXES):
        out = F.when(F.startswith(low, F.lit(p)), strip(F.substr(q, F.lit(len(p) + 1)))).otherwise(out)
    return out


def query_variants(query: Column, max_variants: int = 4) -> Column:
    """array<struct<query,weight,source,intent>>: the original, then the variant its intent asks for."""
    q = strip(query)
    intent = query_intent(q)
    terms = key_terms(q)
    joined = F.array_join(terms, " ")

    def variant(text, weight, source):
        return F.struct(text.alias("query"), F.lit(weight).alias("weight"), F.lit(source).alias("source"),
                        intent.alias("intent"))

    has_terms = F.size(terms) > 0
    declarative = make_declarative(q)
    extra = (
        F.when((intent == "question") & (declarative != q), variant(declarative, 0.85, "intent:declarative"))
        .when((intent == "error") & has_terms,
              variant(F.concat(joined, F.lit(" solution fix")), 0.8, "intent:solution"))
        .when((intent == "implementation") & has_terms, variant(F.concat(F.lit("how "), joined), 0.75, "intent:how"))
        .when((intent == "architecture") & has_terms,
              variant(F.concat(joined, F.lit(" design structure")), 0.75, "intent:design"))
    )
    distinct_extra = F.when(F.lower(strip(extra["query"])) != F.lower(q), extra)
    variants = F.array_compact(F.array(variant(q, 1.0, "original"), distinct_extra))
    none = F.array().cast("array<struct<query:string,weight:double,source:string,intent:string>>")
    return F.when(q == "", none).otherwise(F.slice(variants, 1, max_variants))


def project_id(path: Column) -> Column:
    """Directory name, an underscore, and the first six hex digits of the path's SHA-256."""
    return F.concat(F.substring_index(path, "/", -1), F.lit("_"), F.substring(F.sha2(path, 256), 1, 6))


def determine_scope(concepts: Column, explicit: Column | None = None) -> Column:
    derived = F.when(F.arrays_overlap(concepts, str_array(vocab.GLOBALIZABLE_CONCEPTS)), F.lit("global")
                     ).otherwise(F.lit("project"))
    return derived if explicit is None else F.coalesce(empty_to_null(explicit), derived)
