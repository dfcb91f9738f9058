"""Main text, language, toxicity and token counts against plain versions and held-out labels."""

import itertools
import math
import random
import time
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from memspark.llm import dom, langid, main_text, token_counts, toxicity, wordbag
from memspark.llm.labelled_pages import labelled_pages

VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def field():
    return main_text.fit(labelled_pages(400), steps=120)


def test_viterbi_finds_the_best_labels(field):
    for page, _ in labelled_pages(60, seed=5):
        found = dom.blocks(page)[:9]
        emit = [sum(field.weights.get(f, 0.0) for f in main_text.context_features(b.around) + main_text.text_features(b)) for b in found]

        def total(y, emit=emit):
            s = field.start[y[0]] + sum(e for e, on in zip(emit, y, strict=True) if on)
            return s + sum(field.change[a][b] for a, b in zip(y, y[1:], strict=False))

        best = max(total(y) for y in itertools.product((0, 1), repeat=len(found)))
        assert total([int(x) for x in main_text.decode(field, found)]) == pytest.approx(best)


def test_held_out_blocks(field):
    right = total = 0
    for page, truth in labelled_pages(200, seed=9):
        got = main_text.decode(field, dom.blocks(page))
        right, total = right + sum(a == b for a, b in zip(got, truth, strict=True)), total + len(truth)
    assert right / total > 0.98


PAGE = """<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{}</style><script>var a="</p><article>";</script></head><body>
<header><p>The site</p></header><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>
<div class="cookie-banner"><p>We use cookies here.</p></div><article><h1>A &lt;b&gt; title&nbsp;here</h1>
<p><b>First   paragraph, which
 goes on for a while &eacute;&#233;.<br>And a line.<p>Second paragraph with many more words in it than the first one.</p>
<div class="ad">Buy this now</div><aside class="sidebar"><p>Related things</p></aside></article>
<section class="comments"><h3>Comments</h3><article class="comment"><p>I do like this article a lot.</p></article></section>
<form><label>Mail</label><input><button>Send</button></form><!-- <p>hidden</p> --><footer>&copy; site &middot; words</footer></body></html>"""


def test_main_text_of_a_page(field):
    assert main_text.main_text(PAGE, field) == (
        "A <b> title here\nFirst paragraph, which goes on for a while éé. And a line.\n"
        "Second paragraph with many more words in it than the first one.")


def test_broken_pages(spark, field):
    pages = [None, "", "no markup at all", "<p", "<p class='x", "<!-- open", "<script>never closed", "</p></div>", "<a href=\"x>y<p>z",
             "<" * 3000, "<article><p>" + "word " * 50000, "<td>a<tr>b<li>c", "&am &amp &#0; &#x110000;"]
    df = spark.createDataFrame([(i, p, "old", "u") for i, p in enumerate(pages)], "page_id int, html string, text string, url string")
    rows = main_text.extract(df, "html", field).orderBy("page_id").collect()
    assert len(rows) == len(pages) and all(isinstance(r["text"], str) for r in rows) and rows[0]["text"] == rows[1]["text"] == ""
    assert rows[10]["text"] == " ".join(["word"] * 50000)
    assert main_text.extract(df.limit(0), "html", field).collect() == []


def test_shown_text_stays(field):
    page = ("<article><h1>A title of the page</h1><p>Let <math><mi>x</mi>=<mn>2</mn></math> be given, and see <svg><text>the figure</text></svg> here "
            "for more words.<!--> not a comment <!---> nor this <!-- but this --!> and on.</p><noscript>y</noscript></article>")
    assert [b.text for b in dom.blocks(page)] == [
        "A title of the page", "Let x=2 be given, and see the figure here for more words. not a comment nor this and on.", "y"]
    assert main_text.main_text(page, field).split("\n")[1].startswith("Let x=2 be given")
    raw = dom.blocks("a<textarea><b> &amp; c</textarea>d<xmp>&lt;<i></xmp><template>t</template><title>n</title>")
    assert [b.text for b in raw] == ["a", "<b> & c", "d", "&lt;<i>"] and [b.around and b.around.tag for b in raw] == [None, "textarea", None, "xmp"]


HAND_WRITTEN = [  # pages of other make, with the blocks that are main text
    ("""<body class="single-post"><div id="top"><a href="/">Daily Paper</a><ul class="nav"><li><a href="/w">World</a><li><a href="/s">Sport</a></ul></div>
     <div id="main"><h1>River floods the old town</h1><div class="entry-content"><p>After three days of rain the river left its bed on Monday night.
     <p>Many families had to leave their homes, and the bridge stays closed for now.<div class="advertisement">Cheap flights, book today</div>
     <p>The mayor promised help for all who lost their belongings in the water.</div></div>
     <div class="sidebar widget"><h3>Popular</h3><ul><li><a href="/1">Ten recipes</a></ul></div><div id="footer">Copyright 2020 Daily Paper</div>""",
     ["River floods the old town", "After three days", "Many families", "The mayor promised"]),
    ("""<table><tr><td class="menu"><a href=a>Home</a><br><a href=b>Links</a></td><td><div class=content><h2>My garden in spring</h2><p>The first
     tulips came out last week, and the bees are back as well.</p><ul><li>Water the beds in the evening, when the sun is down.</li></ul></div></td></tr></table>
     <form class="search"><p>Search this site</p><textarea>words</textarea></form>""",
     ["My garden in spring", "The first tulips", "Water the beds"]),
    ("""<main><article><header><h1>How to sharpen a knife</h1></header><p>Use a stone with two sides and keep it wet while you work on the blade.</p>
     <aside class="related">You may also like these</aside><blockquote>A dull knife is more dangerous than a sharp one.</blockquote></article>
     <section id="comments"><h2>Replies</h2><div class="comment"><p>Thanks, this helped me a lot with my old knives.</p></div></section></main>""",
     ["How to sharpen a knife", "Use a stone", "A dull knife"])]


def test_pages_of_other_make(field):
    right = total = 0
    for page, main in HAND_WRITTEN:
        found = dom.blocks(page)
        for b, keep in zip(found, main_text.decode(field, found), strict=True):
            right, total = right + (keep == any(b.text.startswith(m) for m in main)), total + 1
    assert right / total >= 0.85, (right, total)


@pytest.mark.parametrize("page", ["<div>x" * 50_000, "<div>" * 30_000 + "<i>x</i>" * 30_000, "<p><table>" + "<div>y" * 40_000,
                                  "<ul><li>z" * 20_000, "".join(f"<t{i}>a" for i in range(20_000)), "<p>q</b>" * 40_000])
def test_deep_pages_take_linear_time(field, page):
    began = time.process_time()
    assert main_text.main_text(page, field) is not None
    assert time.process_time() - began < 8


def segmentations(word, pieces, p):
    """Sum over all segmentations, by recursion on characters."""
    index, memo = pieces.index, {len(word): 1.0}

    def rest(i):
        if i not in memo:
            memo[i] = 0.0
            for j in range(i + 1, len(word) + 1):
                k = index.get(word[i:j])
                if k is not None:
                    memo[i] += p[k] * rest(j)
            j = i + 1
            while j < len(word) and word[j] & 0xC0 == 0x80:
                j += 1
            memo[i] += langid.UNKNOWN * rest(j)
        return memo[i]

    return rest(0)


def test_forward_sums_all_segmentations(monkeypatch):
    pieces = langid.pieces_of(VOCABULARY)
    p = np.random.default_rng(0).random((len(pieces), 2))
    p /= p.sum(0)
    text = "the zzqxj straße ÉCOLE a internationalization 日本語 ûñí " + "abc" * 30
    assert pieces.longest > 16  # no piece is left out
    for few in (0, langid.FEW, 1000):
        monkeypatch.setattr(langid, "FEW", few)
        data, offsets, _, _ = wordbag.distinct_words(pa.array([text]))
        got = langid.log_likelihoods(data, offsets, pieces, p, chunk=3)
        for i in range(len(offsets) - 1):
            word = b" " + data[offsets[i]:offsets[i + 1]].tobytes()
            assert got[i] == pytest.approx([math.log(segmentations(word, pieces, p[:, k])) for k in (0, 1)], abs=1e-6)


def test_expected_counts_are_consistent():
    pieces = langid.pieces_of(VOCABULARY)
    p = np.full(len(pieces), 1 / len(pieces))
    c = langid.expected_counts(np.frombuffer(b"hello", np.uint8), np.array([0, 5]), np.array([2.0]), pieces, p)
    assert sum(len(t) * x for t, x in zip(pieces.texts, c, strict=True)) == pytest.approx(12, rel=1e-3)  # every byte in one piece


def test_long_words_are_fitted_in_parts(spark):
    data = np.frombuffer(("ab" * 40 + "é" * 100 + "x").encode(), np.uint8)
    offsets, word = langid._parts(data, np.array([0, 80, 280, 281]))
    assert offsets[0] == 0 and offsets[-1] == 281 and {80, 280} <= set(offsets.tolist()) and word.tolist() == [0, 0, 1, 1, 1, 1, 2]
    assert all(data[i] & 0xC0 != 0x80 for i in offsets[:-1]) and max(np.diff(offsets)) <= langid.FITTED_BYTES + 3
    r = random.Random(7)
    rows = [(i, "".join(r.choice("日本語東京都市中" if i % 2 else "가나다라마바사아") for _ in range(200)), "ja" if i % 2 else "ko") for i in range(60)]
    df = spark.createDataFrame(rows, "id long, text string, lang string").repartition(2)
    model = langid.fit(df, "id", "text", "lang", VOCABULARY, F.col("id") % 4 < 2)
    got = df.select("lang", langid.predict(model, F.col("text")).alias("p")).collect()
    assert all(r["lang"] == r["p"]["lang"] for r in got)


def test_background_tells_noise_from_language(spark):
    rows = [(i, t, "aa") for i, t in enumerate(words_of(["the", "ing", "ou", "st"], 1, 60))]
    df = spark.createDataFrame(rows, "id long, text string, lang string")
    model = langid.fit(df, "id", "text", "lang", VOCABULARY, F.lit(True))
    r = random.Random(5)
    noise = [" ".join("".join(r.choice("qxzjkvwç") for _ in range(7)) for _ in range(20)), " ".join(words_of(["sch", "ung", "ei", "keit"], 2, 3))]
    new = spark.createDataFrame([(t,) for t in noise + words_of(["the", "ing", "ou", "st"], 9, 30) + ["the unkown"]], "text string")
    got = [r[0]["evidence"] for r in new.select(langid.predict(model, F.col("text"), with_background=True)).collect()]
    assert max(got[:2]) < -10 and min(got[2:]) > -10


def words_of(syllables, seed, n):
    r = random.Random(seed)
    return [" ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 3))) for _ in range(r.randint(5, 60))) for _ in range(n)]


def test_languages(spark):
    kinds = {"aa": ["the", "ing", "ou", "st"], "bb": ["der", "sch", "ung", "ei"], "cc": ["que", "eau", "é", "ment"]}
    rows = [(i * 3 + k, t, lang, "x") for k, (lang, s) in enumerate(kinds.items()) for i, t in enumerate(words_of(s, k, 40))]
    rows += [(900, None, "aa", "x"), (901, "123 .,!", "bb", "x"), (902, "", None, "x"), (None, "the ing", None, "x"), (903, "a" * 3000, None, None)]
    df = spark.createDataFrame(rows, "id long, text string, lang string, score string").repartition(3)
    model = langid.fit(df, "id", "text", "lang", VOCABULARY, F.col("id") % 4 != 2)
    got = {r["id"]: (r["lang"], r["p"]["lang"], r["p"]["score"]) for r in df.select("id", "lang", langid.predict(model, F.col("text")).alias("p")).collect()}
    held = [x for i, x in got.items() if i is not None and i < 900 and i % 4 == 2]
    assert sum(a == b for a, b, _ in held) / len(held) > 0.95
    assert got[900][1:] == got[901][1:] == got[902][1:] == ("und", 0.0) and got[None][1] == "aa"
    assert all(0 <= s <= 1 for *_, s in got.values())
    empty = langid.fit(df.limit(0), "id", "text", "lang", VOCABULARY, F.lit(True))
    assert {r[0]["lang"] for r in df.select(langid.predict(empty, F.col("text"))).collect()} == {"und"}


def test_toxicity_on_held_out_rows(spark):
    plain = words_of(["an", "be", "ti", "ro", "le", "un"], 1, 300)
    r = random.Random(2)
    rows, labels = [], []
    for i, t in enumerate(plain):
        toxic = i % 6 == 0
        w = t.split()
        if toxic:
            for _ in range(1 + len(w) // 12):
                w.insert(r.randrange(len(w) + 1), r.choice(["vilest", "dross", "nastyword"]) + r.choice(["", ",", "!"]))
        rows.append((i, " ".join(w), 7))
        if i % 7 != 3:
            labels.append((i, int(toxic)))
    rows += [(900, None, 7), (901, "", 7), (None, "an be", 7), (902, "x" * 50000, 7)]
    df = spark.createDataFrame(rows, "id long, text string, toxic int").repartition(3)
    lab = spark.createDataFrame([*labels, (902, None), (None, 1)], "id long, y int")
    model = toxicity.fit(df, "id", "text", lab, "y", F.col("id") % 5 != 0)
    got = {r["id"]: r["s"] for r in df.select("id", toxicity.score(model, F.col("text")).alias("s")).collect()}
    held = [i for i in range(300) if i % 5 == 0]
    assert np.mean([(got[i] >= 0.5) == (i % 6 == 0) for i in held]) > 0.95
    assert got[900] == got[901] and all(0 <= s <= 1 for s in got.values())
    nothing = toxicity.fit(df, "id", "text", lab.limit(0), "y", F.lit(True))
    assert max(r[0] for r in df.select(toxicity.score(nothing, F.col("text"))).collect()) < 0.01


def test_words_take_no_index_of_every_byte():
    text = " ".join(f"word{i % 997} É{'xyz'[i % 3] * 9}," for i in range(150_000))
    wordbag.distinct_words(pa.array(["warm"]))
    tracemalloc.start()
    data, offsets, word, n = wordbag.distinct_words(pa.array([None, text, "ab\u00e9", "cd"]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 15 * len(text.encode()), peak / len(text.encode())
    words = [data[offsets[i]:offsets[i + 1]].tobytes().decode() for i in range(len(offsets) - 1)]
    assert n.tolist() == [0, 300_000, 1, 1] and words[:2] == ["word", "éxxxxxxxxx"] and [words[i] for i in word[-2:]] == ["abé", "cd"]


def test_nnpu_turns_against_negative_risk():
    r = np.random.default_rng(0)
    positive = r.random((200, 3)) * [1, 0.1, 0.1]
    unlabelled = np.concatenate([r.random((60, 3)) * [1, 0.1, 0.1], r.random((540, 3)) * [0.05, 1, 1]])
    w, b = toxicity.fit_nnpu(positive, unlabelled, 0.1)
    assert np.mean(unlabelled[60:] @ w + b < 0) > 0.95 and np.mean(positive @ w + b > 0) > 0.6


def test_token_counts(spark):
    scores = token_counts.scores_of(VOCABULARY)
    texts = ["the cat", "", None, "  ", "日本語 x😀y", "a" * 700, "é" * 90, "un\tdeux\n trois", "the the cat", *words_of(["the", "sch", "é", "12"], 3, 50)]
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "id int, text string, n_tokens int").repartition(2)
    got = {r["id"]: (r["n_tokens"], r["n_pretokens"]) for r in token_counts.with_token_counts(df, "text", VOCABULARY).collect()}
    for i, t in enumerate(texts):
        words = [b" " + w.encode() for w in (t or "").split()]
        assert got[i] == (sum(best_count(w, scores) for w in words), len(words)), t


def best_count(word, scores):
    """Tokens of the best segmentation, by a table over all pieces that end at a place; the shortest of equally good ones first."""
    table = [(0.0, 0)]
    for j in range(1, len(word) + 1):
        top = (-math.inf, 0)
        for i in range(j - 1, -1, -1):
            piece = word[i:j]
            if piece in scores.score and table[i][0] + scores.score[piece] > top[0]:
                top = (table[i][0] + scores.score[piece], table[i][1] + 1)
        for i in range(j - 1, max(-1, j - 5), -1):  # a character that is no piece
            try:
                one = len(word[i:j].decode()) == 1
            except UnicodeDecodeError:
                one = False
            if one and table[i][0] + (j - i) * token_counts.BYTE_SCORE > top[0]:
                top = (table[i][0] + (j - i) * token_counts.BYTE_SCORE, table[i][1] + j - i)
        table.append(top)
    return table[-1][1]


def test_token_counts_of_long_pre_tokens(monkeypatch):
    scores = token_counts.scores_of(VOCABULARY)
    assert scores.longest > 16  # no piece is left out
    r = random.Random(3)
    long = ["".join(r.choice(["international", "日本", "é", "qz", "ной", "1"]) for _ in range(60)) for _ in range(12)]
    texts = [" ".join([*long[:6], long[0] + "x"]), *long[6:], "thequickbrown qqqzzz reconsideration"]
    want = [sum(best_count(b" " + w.encode(), scores) for w in t.split()) for t in texts]
    for few in (0, token_counts.FEW, 1000):
        monkeypatch.setattr(token_counts, "FEW", few)
        assert token_counts.count_tokens(pa.array(texts), scores)[0].tolist() == want


def test_token_counts_of_no_rows(spark):
    df = spark.createDataFrame([], "id int, text string, n_tokens int")
    assert token_counts.with_token_counts(df, "text", VOCABULARY).collect() == []
