"""Text and URL functions at their boundaries."""

import pytest
from pyspark.sql import functions as F

from lanternq.plans import pages as P
from lanternq.functions import text as T
from lanternq.functions import urls as U


@pytest.fixture
def value(spark):
    def run(make, *args):
        row = spark.createDataFrame([tuple(args)], ", ".join(f"c{i} string" for i in range(len(args))))
        return row.select(make(*[F.col(f"c{i}") for i in range(len(args))]).alias("v")).first()["v"]

    return run


@pytest.mark.parametrize(("text", "want"), [("Maybe it works. Perhaps not.", 2), ("Il paraît que oui", 1), ("maybemaybe", 0), ("It may be, it seems", 2), ("", 0)])
def test_hedges(value, text, want):
    assert value(T.hedge_count, text) == want


@pytest.mark.parametrize(("n", "want"), [(7, False), (8, True), (40, True), (41, False)])
def test_answer_unit_bounds(value, n, want):
    assert value(T.is_answer_unit, " ".join(["Word", "5"] + ["x"] * (n - 2))) is want


@pytest.mark.parametrize(("text", "want"), [("What is it", True), ("whatever", False), ("Où est-ce", True), ("ok?", True), ("Prix", False)])
def test_questions(value, text, want):
    assert value(T.is_question, text) is want


@pytest.mark.parametrize(("text", "want"), [("This is", False), ("Celui-ci va", False), ("De plus il", False), ("Paris is", True), ("", True)])
def test_opening(value, text, want):
    assert value(T.opens_clean, text) is want


@pytest.mark.parametrize(("text", "want"), [("abc 1", True), ("in Paris", True), ("end. Paris", False), ("Paris", False)])
def test_fact_anchor(value, text, want):
    assert value(T.has_fact_anchor, text) is want


def test_shingles(value):
    assert value(T.shingles, "a b c d e f") == ["a b c d e", "b c d e f"]
    assert value(T.shingles, "a b") == ["a b"]
    assert value(T.shingles, "...") == []


def test_jaccard(value):
    assert value(lambda a, b: T.jaccard(F.split(a, " "), F.split(b, " ")), "a b c", "b c d") == 0.5
    assert value(lambda a, b: T.jaccard(F.array().cast("array<string>"), F.split(b, " ")), "a", "b") == 0.0


@pytest.mark.parametrize(("text", "want"), [("Erreur 404", True), ("404 Not Found", True), ("500 recipes for bread", False), ("Oops", True), ("Error handling in Rust", False), ("Page non trouvée !", True)])
def test_error_labels(value, text, want):
    assert value(T.is_error_label, text) is want


@pytest.mark.parametrize(("text", "want"), [("en", True), ("EN-us", True), ("e", False), ("en_US", False), ("zh-Hant", True)])
def test_language_tags(value, text, want):
    assert value(T.is_bcp47, text) is want


@pytest.mark.parametrize(
    ("url", "want"),
    [("https://X.com/a/?utm_source=1&b=2#c", "https://x.com/a?b=2"), ("http://x.com", "http://x.com/"), ("http://x.com/?ref=a", "http://x.com/"), ("http://x.com/?reference=a", "http://x.com/?reference=a"), ("mailto:a", "mailto:a")],
)
def test_identity(value, url, want):
    assert value(U.canonical_identity, url) == want


def test_blocked_addresses(value):
    for x in ("127.0.0.1", "10.1.2.3", "::1", "::ffff:10.0.0.1", "100.64.0.1", "169.254.169.254", "fe80::1", "nonsense", "224.0.0.1"):
        assert value(U.is_blocked_address, x) is True, x
    assert value(U.is_blocked_address, "8.8.8.8") is False


def test_dates(value):
    for text, want in (("2024-01-02", "2024-01-02 00:00:00"), ("Tue, 02 Jan 2024 03:04:05 GMT", "2024-01-02 03:04:05"), ("soon", "None")):
        assert str(value(T.parse_date, text)) == want


def test_page_excerpts_and_entities(spark):
    long = "word " * 600
    rows = [
        (1, f"<body><nav>menu</nav><main><p>{long}</p></main></body>"),
        (2, "<body><article>too short</article></body>"),
        (3, f"<header>top</header><!-- no --><p>{'a&amp;b &#233; &#x41; ' * 12}</p><script>x</script>"),
        (4, None),
        (5, f"<body><article>{'y' * 2500}</article><main>{long}</main></body>"),
    ]
    got = {r["i"]: r["x"] for r in spark.createDataFrame(rows, "i int, html string").select("i", P.excerpt_of(F.col("html")).alias("x")).collect()}
    assert got == {1: ("word " * 400).strip(), 2: None, 3: ("a&b é A " * 12).strip(), 4: None, 5: "y" * 2000}


def test_folding_and_anchor_words(value):
    assert value(T.fold_diacritics, "Łódź Žluťoučký İstanbul Ünal Nguyễn") == "Łodz Zlutoucky Istanbul Unal Nguyen"
    assert value(T.anchor_tokens, "Voir plus de Présentation, learn more about bread") == ["presentation", "bread"]
