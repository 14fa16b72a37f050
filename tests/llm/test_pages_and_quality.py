import time
import zlib

import numpy as np
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rosterlake.llm import htmlmain, quality, queries

PAGES = "page_id bigint, url string, html string, text string"


def marks(pages, scan):
    """Of other labelled pages than those fitted on: words missed, words too many, pages
    told exactly."""
    missed = more = exact = 0
    for page, content in pages:
        got = set(htmlmain.main_text(page, scan=scan).split())
        missed, more, exact = missed + len(content - got), more + len(got - content), exact + (got == content)
    return missed, more, exact


def test_other_labelled_pages_are_recovered_and_the_scan_matters():
    pages = htmlmain.labelled_pages(200, seed=99)
    total = sum(len(c) for _, c in pages)
    missed, more, exact = marks(pages, scan=True)
    assert missed < 0.005 * total and more < 0.01 * total and exact >= 0.75 * len(pages)
    _, more_without, exact_without = marks(pages, scan=False)
    assert more_without > 1.3 * more and exact_without < exact


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from([-8.0, -1.0, -0.5, 0.25, 1.0, 3.0]), max_size=14))
def test_the_scan_finds_the_greatest_sum(scores):
    best = max([0.0] + [sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)])
    lo, hi = htmlmain.region(scores)
    assert abs(sum(scores[lo:hi]) - best) < 1e-9


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div class=ad>", "</div>", "a b c", "<nav>", "</nav>", "<li>", "x", "<zz>", "<br>"]), max_size=14))
def test_words_score_above_zero_and_tags_below(parts):
    found, elements = htmlmain.pieces(" ".join(parts), htmlmain.weights())
    assert all(p.score > 0 if p.words else p.score < 0 if p.name else p.score == 0 for p in found)
    assert all(0 <= e.first <= e.last <= len(found) for e in elements)


ARTICLE = "<h1>The old mill</h1><p>The quiet river runs past the old mill and on to the village green where children play all day.</p><p>Nobody remembers who built it, and nobody asks any more.</p>"
TEXT = "The old mill\nThe quiet river runs past the old mill and on to the village green where children play all day.\nNobody remembers who built it, and nobody asks any more."
TALK = "<p>Nice piece of writing, thank you very much for it, I agree with all of that.</p><p>Me too, I could not agree more.</p>"


@pytest.mark.parametrize("name", ["post-comments", "comment-content", "reader-feedback", "comments", "userResponses"])
@pytest.mark.parametrize("page", ["<article>{a}</article><div class='{n}'>{t}</div>", "<article>{a}<section id='{n}'>{t}</section></article>", "<div class='story-body'>{a}</div><div class='{n}'>{t}</div>"])
def test_reader_comments_are_left_out(page, name):
    assert htmlmain.main_text("<html><body>" + page.format(a=ARTICLE, n=name, t=TALK) + "</body></html>") == TEXT


@pytest.mark.parametrize(
    "page",
    [
        f"<div class='post'>{ARTICLE}<div class='story-share'><a>Tweet</a> <a>Mail</a></div><div class='entry-footer'>Filed under mills</div></div>",
        f"<main>{ARTICLE}</main><div class='copyright'>All rights reserved by the mill</div>",
        f"<div><a href=/>Home</a> <a href=/n>News</a> <a href=/s>Sports</a></div><div>{ARTICLE}</div>",
        f"<nav><ul><li><a href=/>Home</a></li></ul></nav>{ARTICLE}<footer>Legal words</footer>",
        f"<div class='cookie-notice'>We use cookies here</div><div id=content>{ARTICLE}</div><aside>Read also</aside><form><label>Mail</label></form>",
        f"<table><tr><td><a href=/>Home</a></td><td>{ARTICLE}</td></tr></table>",
        f"<header><a href=/>Site name</a></header><article><header>{ARTICLE[:21]}</header>{ARTICLE[21:]}</article>",
    ],
)
def test_what_stands_around_an_article_is_left_out(page):
    assert htmlmain.main_text(f"<html><body>{page}</body></html>") == TEXT


def test_a_telling_name_alone_takes_no_text_away():
    long = "words of the text itself " * 40
    page = f"<html><body><nav><a href=/>x</a></nav><article>{ARTICLE}<section id='search'><p>{long}</p></section></article></body></html>"
    assert htmlmain.main_text(page) == TEXT + "\n" + long.strip()


ENTRY = f"<div class=entry>{ARTICLE}</div>"
AROUND = "<nav><a href=/>Home</a> <a href=/n>News of the day</a></nav>{}<footer>Legal words of the site</footer>"


@pytest.mark.parametrize("name", ["no-sidebar", "has-sidebar", "right-sidebar", "page-with-sidebar", "modal-open", "cookie-banner-active", "single single-post no-sidebar", "comments-open header-fixed"])
@pytest.mark.parametrize(
    "page",
    [
        "<body class='{n}'>{e}</body>",
        "<body class='{n}'>{around}</body>",
        "<body><div class='{n}'>{e}</div></body>",
        "<body><div class='{n}'><main><article>{e}</article></main></div></body>",
        "<body class='{n}'><div id=page class='site {n}'><div id=content class=site-content>{around}</div></div></body>",
        "<body>{outer}</body>",
    ],
)
def test_the_name_of_a_wrapper_takes_no_page_away(page, name):
    text = page.format(n=name, e=ENTRY, around=AROUND.format(ENTRY), outer=AROUND.format(f"<div class='{name}'><article>{ENTRY}</article></div>"))
    assert htmlmain.main_text(f"<html>{text}</html>") == TEXT


def test_a_page_in_one_form_keeps_its_text():
    assert htmlmain.main_text(f"<html><body><form id=form1 action=/x method=post>{AROUND.format(ENTRY)}<label>Your mail</label></form></body></html>") == TEXT


def test_large_odd_pages_take_linear_time():
    """Pages of a megabyte whose tags are unclosed, stray, nested or cut."""
    n = 1 << 20
    odd = ["<b>" * (n // 7) + "</p>" * (n // 7), "<a " * (n // 3) + '"', '<a "' * (n // 4) + "<", "<script></script" * (n // 16), "<div class=menu>x" * (n // 17), "<p title='x" * (n // 11), "<!--" * (n // 4), "</script " * (n // 9), "<a" + " b" * (n // 2), "<td><b>x</td>" * (n // 13), "&amp" * (n // 4)]
    took = []
    for page in odd:
        began = time.process_time()
        htmlmain.main_text(page)
        took.append(time.process_time() - began)
    assert max(took) < 12, took  # most take one or two seconds


def test_a_page_without_content_is_empty():
    assert htmlmain.main_text("<html><body><nav><ul><li><a href=/>Home</a></li><li><a href=/b>Other things</a></li></ul></nav><footer>Legal</footer></body></html>") == ""


def test_what_is_left_out_and_kept():
    page = """<html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><a href=/>Home</a></nav>
    <div class="cookie-notice">We use cookies here</div><article><h1>A  title</h1><p>One &amp; two&nbsp;three <b>bold</b>,<br>four.<p>Unclosed second paragraph
    <script>var x = "</p>";</script><div class="ad">Buy this now</div><p>Last.</p></article><aside>Read also</aside><form><label>Mail</label></form>
    <section class="comments"><p>Nice article, thanks a lot for it, I agree</p></section><footer>Legal words</footer></body></html>"""
    assert htmlmain.main_text(page) == "A title\nOne & two three bold, four.\nUnclosed second paragraph\nLast."


def test_odd_pages(spark):
    rows = [(1, None, None, "t"), (2, "u", "", "t"), (3, "u", "plain  text", "t"), (4, "u", "<p>" + "word " * 100_000, "t"), (5, "u", "<<<>>> & &#x; <p", "t"), (6, "u", "<script>only()", "t"), (None, None, "<p>a b c", None), (3, "u", "plain  text", "t")]
    out = htmlmain.extract(spark.createDataFrame(rows, PAGES)).collect()
    by = {r["page_id"]: r["text"] for r in out}
    assert len(out) == len(rows) and by[1] == by[2] == by[6] == "" and by[3] == "plain text" and by[None] == "a b c"
    assert by[4] == ("word " * 100_000).strip()
    assert htmlmain.extract(spark.createDataFrame([], PAGES)).count() == 0


def test_page_query(spark, sf):
    """The pages' articles, taken by their tag."""
    import html
    import re

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in queries.op8_html_extraction(spark, sf).collect():
        article = re.search(r"<article>(.*?)</article>", pages[r["page_id"]], re.S)[1]
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " ")))).strip() for b in re.split(r"</?(?:p|h1)>", article)]
        want = "\n".join(b for b in blocks if b)
        assert r["text"] == want and r["n_chars"] == len(want)


# -- quality


def auc(score, label):
    pos, neg = [s for s, y in zip(score, label, strict=True) if y], [s for s, y in zip(score, label, strict=True) if not y]
    return np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])


def test_held_out_rows_are_told_apart(spark):
    d = "/root/testdata/sf0.1"
    out = queries.op10_quality(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").toPandas()
    assert all((zlib.crc32(str(i).encode()) % 4 == 2) == h for i, h in zip(out.doc_id, out.held_out, strict=True))
    held = out[out.held_out]
    assert out.score.between(0, 1).all() and ((out.score >= 0.7) == (out.predicted == 1)).all()
    assert auc(held.score, held.quality) > 0.97
    assert (held.predicted == held.quality).mean() > 0.95
    assert held[held.quality == 1].predicted.mean() > 0.97


def test_scores_equal_a_plain_computation(spark, sf):
    """The query's rows against the model's dictionaries used one block at a time."""
    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    m = quality.fit(docs, labels)
    size = lambda block, d: len(zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False).compress(block))
    got = {r["doc_id"]: r for r in queries.op10_quality(spark, sf).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows[:150]:
        raw = (r["text"] or "").encode()
        g, b = (sum(size(raw[i : i + quality.BLOCK], d) for i in range(0, len(raw), quality.BLOCK)) for d in (m.good, m.bad))
        x = (b - g) / (b + g) if raw else 0.0
        want = 1 / (1 + np.exp(-(m.slope * x + m.intercept)))
        out = got[r["doc_id"]]
        assert abs(out["score"] - want) < 1e-9 and out["predicted"] == (out["score"] >= 0.7) and out["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)


def test_a_long_labelled_text_is_sampled_over_its_whole_length(spark):
    parts = "".join(chr(97 + i) * 5000 for i in range(8))
    taken = spark.createDataFrame([(parts,), ("short",), ("",)], "text string").select(quality.sampled(F.col("text"), 4096).alias("t")).collect()
    assert len(taken[0]["t"]) == 4096 and set(taken[0]["t"]) >= {"a", "h"} and len(set(taken[0]["t"])) >= 4
    assert [r["t"] for r in taken[1:]] == ["short", ""]


DOCS = "doc_id bigint, text string, score string, quality int"
LABELS = "doc_id bigint, quality int, toxic int"


def corpus(spark, n=80):
    good = [(i, f"The quiet river {i} runs past the old mill and the village green. " * 4, "x", 1) for i in range(n)]
    bad = [(1000 + i, f"BUY!! NOW!! {i} $$$ CHEAP!! WIN!! $$$ " * 6, "x", 1) for i in range(n)]
    return spark.createDataFrame(good + bad, DOCS), spark.createDataFrame([(i, 1, 0) for i in range(n)] + [(1000 + i, 0, 0) for i in range(n)] + [(3, None, 0), (5, 7, 0), (None, 1, 0)], LABELS)


def test_filter_keeps_good_rows_unchanged(spark):
    docs, labels = corpus(spark)
    odd = spark.createDataFrame([(5000, None, None, None), (5001, "", None, None), (5002, "The quiet river " * 20_000, None, None), (None, "The village green by the old mill.", None, None)], DOCS)
    out = quality.keep_good(docs.unionByName(odd), labels)
    assert out.columns == docs.columns
    kept = {r["doc_id"] for r in out.collect()}
    assert set(range(80)) <= kept and not any(k is not None and 1000 <= k < 2000 for k in kept) and {5002, None} <= kept


def test_few_or_no_labels(spark):
    docs, labels = corpus(spark, 3)
    none = labels.where("doc_id > 9999")
    m = quality.fit(docs, none)
    assert m.score(["", "abc"]).tolist() == [0.5, 0.5]
    ones = quality.fit(docs, labels.where("quality = 1"))
    assert ones.score(["x"])[0] > 0.99
    few = quality.fit(docs, labels)
    assert few.score(["The quiet river runs past"])[0] > few.score(["WIN!! $$$ CHEAP!!"])[0]
    assert quality.with_score(docs.where("doc_id < 0"), few, "s").count() == 0


def test_sample_is_bounded(spark):
    docs, labels = corpus(spark)
    m = quality.fit(docs, labels, sample=5, window=100)
    assert len(m.good) <= 5 * 100 + 5


def test_a_repeated_id_counts_once(spark):
    docs, labels = corpus(spark, 20)
    again = docs.unionByName(docs.where("doc_id = 1000").crossJoin(spark.range(500)).drop("id").withColumn("text", F.concat("text", F.rand(1).cast("string"))))
    taken = []
    real = quality.build_dictionary
    quality.build_dictionary = lambda texts, *a: taken.append(len(texts)) or real(texts, *a)
    try:
        quality.fit(again, labels)
    finally:
        quality.build_dictionary = real
    assert sum(taken) <= 40


def test_whole_texts_can_be_asked_for(spark):
    docs, labels = corpus(spark)
    long = docs.withColumn("text", F.repeat("text", 60))
    assert quality.fit(long, labels, window=None) != quality.fit(long, labels)


def test_the_model_never_sees_held_out_rows(spark):
    docs, labels = corpus(spark)
    swap = labels.withColumn("quality", F.when(quality.may_learn(F.col("doc_id")), F.col("quality")).otherwise(1 - F.col("quality")))
    assert quality.fit(docs, labels) == quality.fit(docs, swap)
