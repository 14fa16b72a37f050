import difflib
import hashlib
import html
import itertools
import math
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from rosterlake.functions import names, scoring, text, vectors


def values(spark, column, rows, schema="x string"):
    df = spark.createDataFrame([(r,) if not isinstance(r, tuple) else r for r in rows], schema)
    return [r[0] for r in df.select(column.alias("v")).collect()]


def test_search_tokens(spark):
    got = values(spark, text.search_tokens(F.col("x")), ["Gravitational-wave detectors and galaxies", None, "glass bus class ties"])
    assert got == [["gravitational", "wave", "detector", "and", "galaxy"], [], ["glass", "bus", "class", "ties"]]


def test_overlaps(spark):
    df = spark.createDataFrame([("gravitational waves", "Quantum noise in a gravitational-wave detector"), ("quantum noise", "The quantum noise floor"), ("noise", "noise"), ("theory of matter", "theory of matter"), ("of a", "of a"), ("", "x")], "q string, t string")
    q, t = text.search_tokens(F.col("q")), text.search_tokens(F.col("t"))
    got = df.select(scoring.keyword_overlap(q, t).alias("k"), scoring.phrase_overlap(q, t).alias("p")).collect()
    assert [r["k"] for r in got] == [1.0, 1.0, 1.0, 1.0, 0.0, 0.0]
    assert [r["p"] for r in got] == [1.0, 1.0, 0.0, 0.0, 0.0, 0.0]


def test_discounted_sum(spark):
    got = values(spark, scoring.discounted_sum(F.col("x"), 5), [([0.9, 0.8, 0.7, 0.6, 0.5],), ([0.5, 0.9],), ([],)], "x array<double>")
    assert [round(g, 6) for g in got] == [1.795, 1.2, 0.0]
    nine = values(spark, scoring.discounted_sum(F.col("x"), 9), [([1.0] * 9,)], "x array<double>")
    assert round(nine[0], 6) == 2.25


def test_query_synonyms_cascade(spark):
    got = values(spark, text.normalize_query(F.col("x")), ["astrophysics", "  CMB  and QM", "astronomy", None])
    assert got == ["astrophysicsphysics", "condensed matter and quantum materials", "astrophysicsnomy", ""]


@pytest.mark.parametrize(
    ("title", "status", "kind"),
    [("Associate Professor of Physics", "verified", "associate_professor"), ("Postdoctoral Fellow", "excluded", "excluded"), ("Adjunct Professor", "ambiguous", "ambiguous"), ("Professor Emerita", "verified", "professor"), ("Professor and Staff Director", "excluded", "excluded"), ("Wizard", "ambiguous", "ambiguous"), (None, "ambiguous", "ambiguous")],
)
def test_titles(spark, title, status, kind):
    got = values(spark, text.classify_title(F.col("x")), [(title,)])[0]
    assert (got["status"], got["normalized_title"]) == (status, kind)


def naive_name(s):
    clean = re.sub(r"\s+", " ", s or "").strip()
    folded = "".join(c for c in unicodedata.normalize("NFKD", clean) if not unicodedata.combining(c))
    return re.sub(r"[^A-Za-z0-9\s-]", "", folded).lower()


def test_names_and_addresses(spark):
    rows = ["  José  Ángel  Núñez-Ó ", "Øre Ström", "Plain Name", None, "ﬁne Ⅷ"]
    assert values(spark, text.normalize_name(F.col("x")), rows) == [naive_name(r) for r in rows]
    assert values(spark, text.normalize_email(F.col("x")), ["mail Ann.B@Ex-ample.ORG now", "none", None]) == ["ann.b@ex-ample.org", None, None]
    marks = ["a &amp; b &lt;c&gt; &eacute; &nope; &#65;", "plain", None]
    assert values(spark, text.unescape_html(F.col("x")), marks) == [html.unescape(m) if m else m for m in marks]


def test_annotations_and_honorifics(spark):
    rows = ["Smadar Naoz | She/Her", "Taylor Example (they/them)", "Ann Lee, she/her", "Bob Ray [Cher]", "Ann Lee (Physics)", "Dr. Prof. Ann B. Lee Jr.", "Dr.", "Prof Ann", "Ann Lee III", "A — B"]
    assert values(spark, names.strip_annotations(F.col("x")), rows) == ["Smadar Naoz", "Taylor Example", "Ann Lee", "Bob Ray", "Ann Lee (Physics)", "Dr. Prof. Ann B. Lee Jr.", "Dr.", "Prof Ann", "Ann Lee III", "A"]
    assert values(spark, names.strip_honorifics(F.col("x")), rows)[4:] == ["Ann Lee (Physics)", "Ann B. Lee", "", "Ann", "Ann Lee", "A"]
    assert values(spark, names.name_variants(F.col("x")), ["Dr. Philip H. Bucksbaum", "José Núñez", "Cher", ""]) == [["Philip H. Bucksbaum", "Philip Bucksbaum"], ["José Núñez", "Jose Nunez"], ["Cher"], []]


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [("Jane Doe", "jane doe", 1.0), ("Jane D. Doe", "Jane Doe", 0.97), ("Ernest Moniz", "E. J. Moniz", 0.89), ("Jane Anna Doe", "Janet Berta Doe", 0.84), ("", "x y", 0.0), ("tide", "diet", 0.25)],
)
def test_name_similarity(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    tokens = df.select(names.name_tokens(F.col("a")).alias("l"), names.name_tokens(F.col("b")).alias("r"))
    assert abs(tokens.select(names.name_similarity(F.col("l"), F.col("r"))).first()[0] - want) < 1e-9


def may_align(left, right):
    """All walks over both lists, by their first step."""
    if not left or not right:
        return all(len(w) == 1 for w in [*left, *right])
    a, b = left[0], right[0]
    if a == b or a[0] == b[0] and 1 in (len(a), len(b)):
        return may_align(left[1:], right[1:])
    if len(a) == 1:
        return may_align(left[1:], right)
    return len(b) == 1 and may_align(left, right[1:])


def naive_similarity(left, right):
    if not left or not right:
        return 0.0
    if left == right:
        return 1.0
    if len(left) > 1 and len(right) > 1 and left[-1] == right[-1] and left[0][0] == right[0][0]:
        inner = left[1:-1], right[1:-1]
        if all(inner) and not may_align(*inner):
            return 0.84
        return 0.97 if left[0] == right[0] else 0.89
    return difflib.SequenceMatcher(None, " ".join(left), " ".join(right)).ratio()


def test_name_similarity_equals_the_rule_on_all_pairs(spark):
    words = ["a", "b", "ann", "amy", "bea"]
    pool = [[], ["lee"], ["bob", "lee"], *[["ann", *m, "lee"] for n in range(4) for m in itertools.product(words, repeat=n)][:120], ["a", "lee"], ["amy", "b", "lee"], ["ann", "b", "rose"]]
    rows = [(a, b) for k, a in enumerate(pool) for b in pool[k % 7 :: 7]]
    df = spark.createDataFrame(rows, "l array<string>, r array<string>").select("l", "r", names.name_similarity(F.col("l"), F.col("r")).alias("s"))
    for r in df.collect():
        assert abs(r["s"] - naive_similarity(r["l"], r["r"])) < 1e-12, (r["l"], r["r"])


def test_middle_words(spark):
    cases = [(["a"], ["anna"], True), ([], ["x"], True), (["j", "anna"], ["anna"], True), (["anna"], ["berta"], False), (["anna", "berta"], ["anna"], False), (["a", "ab"], ["ab"], False), (["x", "y"], ["z"], True)]
    df = spark.createDataFrame([c[:2] for c in cases], "l array<string>, r array<string>")
    assert [r[0] for r in df.select(names.middles_agree(F.col("l"), F.col("r"))).collect()] == [c[2] for c in cases]


def naive_embedding(s, dim):
    out = [0.0] * dim
    for token in s.lower().split():
        d = hashlib.sha256(token.encode()).digest()
        for k in range(0, 32, 4):
            out[int.from_bytes(d[k : k + 4], "big") % dim] += 1.0 if d[k] % 2 == 0 else -1.0
    n = math.sqrt(sum(x * x for x in out))
    return [x / n for x in out] if n else out


def test_hash_embedding(spark):
    rows = [(1, "Quantum matter quantum"), (2, ""), (3, None), (4, "Öl und Wasser\tund\nmehr")]
    got = {r["k"]: r["embedding"] for r in vectors.hash_embed(spark.createDataFrame(rows, "k bigint, t string"), "k", "t", 64).collect()}
    for k, t in rows:
        assert got[k] == pytest.approx(naive_embedding(t or "", 64), abs=1e-15)
        assert vectors.hash_embed_one(t or "", 64) == pytest.approx(got[k], abs=1e-15)


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), (None, [1.0]), ([], []), ([1.0, 1.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert [round(r[0], 6) for r in df.select(vectors.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0, 0.0, 0.0, 0.707107]
    assert [round(r[0], 6) for r in df.select(vectors.cosine_to([1.0, 0.0])(F.col("a"))).collect()] == [1.0, 0.0, 0.0, 0.0, 0.0, 0.707107]


def test_title_key_and_preprint(spark):
    assert len(set(values(spark, text.title_key(F.col("x")), ["TiO$_{2}$ films", "TiO<sub>2</sub> films", "TIO 2 film"]))) == 1
    df = spark.createDataFrame([("arXiv (Cornell)", None), (None, "10.48550/ARXIV.1"), ("Nature", "10.1/x"), (None, None)], "s string, d string")
    assert [r[0] for r in df.select(text.is_preprint(F.col("s"), F.col("d"))).collect()] == [True, True, False, False]


def test_truncate_and_marker(spark):
    assert values(spark, text.truncate(F.col("x"), 10), ["short", "one two three four", None]) == ["short", "one two…", ""]
    assert values(spark, text.after_marker(F.col("x"), "- Paper:"), ['a\n- Paper: "T x"\nb', "none"]) == ["T x", ""]


def test_host_allowed(spark):
    d = F.array(F.lit("example.edu"))
    assert values(spark, text.host_allowed(F.col("x"), d), ["https://physics.example.edu/a", "https://example.edu", "https://badexample.edu", "nonsense", None]) == [True, True, False, False, False]


def test_informative_terms(spark):
    got = values(spark, text.informative_terms(F.col("x")), ["Studies of the process class: batteries, lasers, x-rays and research"])
    assert got == [["process"[:-1], "class", "battery", "laser", "x-ray"]]


def test_sql_functions_equal_the_columns(spark):
    """Each temporary function against the column of the same meaning."""
    from rosterlake.functions import scoring, sqlfun, text, vectors
    from rosterlake.operators import funding

    assert "cosine_of" in sqlfun.register(spark) and sqlfun.register(spark)
    rows = [
        ("  Assistant\u00a0 Professor ", "ann.lee@Example.edu x", "Jos\u00e9  N\u00fa\u00f1ez-Smith", ["quantum", "of", "noise"], ["noise", "quantum", "noise"], [1.0, 2.0], [2.0, 0.5], [0.3, 0.9, 0.1, 0.5, 0.2, 0.8], "arXiv x", None),
        ("Postdoc", None, None, [], ["a"], [], [1.0], [], None, "10.48550/arXiv.7"),
        (None, "none", "", ["series", "glass"], [], [0.0, 0.0], [1.0, 1.0], [0.5], "Journal", ""),
        ("Visiting Professor of the studies", "", "Bo", ["studies", "series"], ["studies", "series"], [1.0], [1.0, 2.0], [1.0, 2.0], "", "2030-01-01"),
    ]
    df = spark.createDataFrame(rows, "t string, e string, n string, q array<string>, x array<string>, a array<double>, b array<double>, s array<double>, v string, d string")
    both = {
        "norm_space(t)": text.normalize_whitespace(F.col("t")),
        "first_email(e)": text.normalize_email(F.col("e")),
        "plain_name(n)": text.normalize_name(F.col("n")),
        "title_status(t)": text.classify_title(F.col("t"))["status"],
        "search_terms(t)": text.search_tokens(F.col("t")),
        "is_preprint(v, d)": text.is_preprint(F.col("v"), F.col("d")),
        "keyword_share(q, x)": scoring.keyword_overlap(F.col("q"), F.col("x")),
        "phrase_share(q, x)": scoring.phrase_overlap(F.col("q"), F.col("x")),
        "cosine_of(a, b)": vectors.cosine(F.col("a"), F.col("b")),
        "best_sum(s, 3)": scoring.discounted_sum(F.col("s"), 3),
        "best_sum(s, 9)": scoring.discounted_sum(F.col("s"), 9),
        "work_score(0.5, q, x, x)": scoring.work_score(F.lit(0.5), *[scoring.keyword_overlap(F.col("q"), F.col("x"))] * 2, *[scoring.phrase_overlap(F.col("q"), F.col("x"))] * 2),
        "active_grant(d, '2026-01-01')": funding.is_active(F.col("d"), "2026-01-01"),
    }
    for sql, column in both.items():
        for r in df.select(F.expr(sql).alias("sql"), column.alias("column")).collect():
            assert r["sql"] == r["column"] or abs(r["sql"] - r["column"]) < 1e-12, (sql, r)
    # Spark sees through a function: its argument alone is read
    plan = spark.sql("SELECT count(*) FROM {df} WHERE active_grant(d, '2026-01-01')", df=df)._jdf.queryExecution().optimizedPlan().toString()
    assert "active_grant" not in plan
