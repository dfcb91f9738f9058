import re

import pytest
from pyspark.sql import functions as F

from memspark import vocab
from memspark.functions import markup, privacy, text as tx, vectors as vx
from memspark.operators import filters as fl
from memspark.operators.conflicts import correction_text


def one(spark, ddl, row, *cols):
    return spark.createDataFrame([row], ddl).select(*cols).first()


@pytest.mark.parametrize("query,intent", [
    ("How does auth work?", "question"), ("fix the crash", "error"), ("implement the endpoint", "implementation"),
    ("service layer", "architecture"), ("hello there", "general"), ("", "general"), ("what is this error", "error"),
])
def test_intent(spark, query, intent):
    assert one(spark, "q string", (query,), tx.query_intent(F.col("q")))[0] == intent


@pytest.mark.parametrize("query,out", [
    ("how do i reset it?", "reset it"), ("What is a goroutine?", "a goroutine"), ("plain words", "plain words"), (" why is it slow? ", "it slow"),
])
def test_declarative(spark, query, out):
    assert one(spark, "q string", (query,), tx.make_declarative(F.col("q")))[0] == out


def test_variants(spark):
    v = one(spark, "q string", ("fix the login bug, please",), tx.query_variants(F.col("q")).alias("v")).v
    assert [(x.query, x.weight, x.source) for x in v] == [
        ("fix the login bug, please", 1.0, "original"), ("fix login bug please solution fix", 0.8, "intent:solution")]
    assert one(spark, "q string", ("  ",), tx.query_variants(F.col("q")).alias("v")).v == []


def test_tokens_and_terms(spark):
    r = one(spark, "title string, narrative string, facts array<string>, files_read array<string>, files_modified array<string>",
            ("The Auth bug", "it was in JWT_check", ["a fact"], ["pkg/Auth.go"], ["x/y/main.go"]), tx.observation_terms().alias("t"))
    assert set(r.t) == {"auth", "bug", "jwt_check", "fact", "auth.go", "main.go"}
    assert one(spark, "q string", ("How does the Token token refresh_x work",), tx.keywords(F.col("q")).alias("k")).k == ["token", "refresh_x"]
    assert one(spark, "q string", ('"Fix" the (cache), cache!',), tx.key_terms(F.col("q")).alias("k")).k == ["fix", "cache", "cache"]


@pytest.mark.parametrize("a,b,j", [
    (["a", "b", "c"], ["a", "b", "c"], 1.0), (["a"], ["b"], 0.0), (["a", "b", "c"], ["b", "c", "d"], 0.5), ([], [], 1.0), (["a"], [], 0.0),
])
def test_jaccard(spark, a, b, j):
    assert one(spark, "a array<string>, b array<string>", (a, b), tx.jaccard(F.col("a"), F.col("b")))[0] == j


def test_signature_and_match(spark):
    r = one(spark, "c array<string>, t string", (["security", "api"], "Fix nil-pointer in the Security with-this API_layer"),
            tx.signature(F.col("c"), F.col("t")).alias("s"))
    assert r.s == ["security", "api", "pointer", "layer"]
    m = one(spark, "a array<string>, b array<string>", (["A", "b"], ["a", "a", "c"]), tx.match_score(F.col("a"), F.col("b")))[0]
    assert m == pytest.approx(2 / 3)


@pytest.mark.parametrize("concepts,title,narrative,ptype", [
    (["caching", "best-practice", "anti-pattern"], "", "", "best-practice"), ([], "Nil check", "", "bug"), ([], "", "a Race Condition", "bug"),
    ([], "tidy", "code", "refactor"), (["architecture"], "panic", "", "architecture"),
])
def test_pattern_type(spark, concepts, title, narrative, ptype):
    assert one(spark, "c array<string>, t string, n string", (concepts, title, narrative), tx.pattern_type(F.col("c"), F.col("t"), F.col("n")))[0] == ptype


def test_privacy(spark):
    d = spark.createDataFrame([("a <private>x\ny</private> b",), ("<private>x</private>\n",), ("<memory-context>m</memory-context>z",)], "t string")
    assert [tuple(r) for r in d.select(privacy.privacy_clean(F.col("t")), privacy.is_private(F.col("t"))).collect()] == [
        ("a  b", False), ("", True), ("z", False)]


def test_extract_observations(spark):
    t = ("<observation><type>bugfix</type><title> T </title><concepts><concept>Security</concept><concept>bugfix</concept><concept>zzz</concept></concepts>"
         "<files_read><file>a</file><file> b </file></files_read></observation><observation><type>odd</type></observation>")
    rows = markup.extract_observations(spark.createDataFrame([(1, t)], "k long, text string")).orderBy("block_no").collect()
    assert [(r.type, r.title, r.concepts, r.files_read) for r in rows] == [("bugfix", "T", ["security"], ["a", "b"]), ("change", "", [], [])]


def test_extract_summary(spark):
    d = spark.createDataFrame([(1, "<summary><request>r</request></summary>"), (2, '<skip_summary reason="n"/><summary></summary>'), (3, "none")], "k long, text string")
    assert [(r.k, r.request, r.learned) for r in markup.extract_summary(d).collect()] == [(1, "r", "")]


CORRECTIONS = [
    "Actually, that was wrong", "Actually that's not right", "I previously said x is fine but it is not", "Correction: use y", "ignore the previous note",
    "Disregard earlier notes", "it WAS mistaken", "it turns out the cache was incorrect", "this replaces the old way", "do not use it anymore", "don't use foo anymore",
    "no longer recommended", "a deprecated method", "you should have used b instead", "a better way is c",
]


def test_correction_prefilter_loses_nothing(spark):
    texts = CORRECTIONS + ["all fine", "was right", "better still", ""]
    d = spark.createDataFrame([(t,) for t in texts], "t string").select("t", correction_text(F.col("t")).alias("c"))

    def first(t):
        for p in vocab.CORRECTION_PATTERNS:
            m = re.search(p, t)
            if m and m.group(0):
                return m.group(0)

    got = {r.t: r.c for r in d.collect()}
    assert got == {t: first(t) for t in texts}
    assert all(got[t] for t in CORRECTIONS)


def test_pooling_and_cosine(spark):
    r = one(spark, "v array<array<float>>, m array<int>", ([[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]], [1, 1, 0]),
            vx.mask_mean_pool(F.col("v"), F.col("m")), vx.mask_mean_pool(F.col("v"), F.array(F.lit(0), F.lit(0), F.lit(0))), vx.cls_pool(F.col("v")))
    assert [list(x) for x in r] == [[2.0, 3.0], [0.0, 0.0], [1.0, 2.0]]
    c = one(spark, "a array<float>, b array<float>, z array<float>", ([1.0, 0.0], [1.0, 1.0], [0.0, 0.0]),
            vx.cosine(F.col("a"), F.col("b")), vx.cosine(F.col("a"), F.col("z")), vx.cosine(F.col("a"), F.array().cast("array<float>")))
    assert c[0] == pytest.approx(2 ** -0.5) and c[1] == 0.0 and c[2] == 0.0
    assert [x for x in one(spark, "x double", (25.0,), vx.sigmoid(F.col("x")), vx.sigmoid(-F.col("x")), vx.sigmoid(F.col("x") * 0))] == [1.0, 0.0, 0.5]


def test_tool_event_filter(spark):
    long = "x" * 60
    rows = [(1, "Edit", "a", long), (2, "Glob", "a", long), (3, "Edit", "a", "short"), (4, "Edit", "a", long + " No Matches Found"),
            (5, "Read", "go.sum", long), (6, "Grep", "a", "line\n" * 60), (7, "Bash", "Git Status", long), (8, "Bash", "go test", long), (9, "WebSearch", "a", long)]
    d = spark.createDataFrame(rows, "id long, tool_name string, tool_input string, tool_response string")
    assert {r.id for r in fl.tool_event_filter(d).collect()} == {1, 8, 9}
    assert {r.id for r in fl.tool_event_filter(d, at_capture=True).collect()} == {1, 8}


def test_summary_filters(spark):
    good = "I fixed main.go and updated the function " + "x" * 200
    d = spark.createDataFrame([(good,), ("fixed main.go",), (good + " memory agent, no work done",)], "text string")
    assert fl.summary_worthy(d).count() == 1
    s = spark.createDataFrame([("memory agent", "no work done"), ("auth", "fixed")], "request string, learned string")
    for c in ("investigated", "completed", "next_steps", "notes"):
        s = s.withColumn(c, F.lit(None).cast("string"))
    assert [r.request for r in fl.summary_self_ref(s).collect()] == ["auth"]


def test_phrases_are_found_by_an_automaton_and_only_where_the_concepts_leave_the_type_open(spark):
    texts = ["NuLL x", "a\nrace CONDITION", "off-by-one", "offxby-one", "deadlocK", "nıl", "", None, "nothing", "Pänic", "über PANIC"]
    df = spark.createDataFrame([(t, ["architecture"] if i % 2 else None) for i, t in enumerate(texts)], "t string, c array<string>")
    rows = df.select("t", "c", tx.holds_any(F.col("t"), vocab.BUG_KEYWORDS).alias("a"),
                     tx.contains_any(F.coalesce("t", F.lit("")), vocab.BUG_KEYWORDS, ignore_case=True).alias("b"),
                     tx.pattern_type(F.col("c"), F.col("t"), F.lit(None).cast("string")).alias("type")).collect()
    assert [r.a for r in rows] == [r.b for r in rows] and sum(r.a for r in rows) == 4
    assert [r.type for r in rows] == [r.c[0] if r.c else "bug" if r.b else "refactor" for r in rows]
    plan = df.select(tx.pattern_type(F.col("c"), F.col("t"), F.col("t")))._jdf.queryExecution().executedPlan().toString()
    assert "RLIKE" not in plan
