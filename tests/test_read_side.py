"""Parser, binder, search, facets and browsing."""

import math
import random

import pytest
from pyspark.sql import functions as F

from shelfspark import analysis
from shelfspark.cql.bind import bind
from shelfspark.cql.parser import Boolean, Clause, Key, parse
from shelfspark.demo.catalog import PARTS
from shelfspark.engine import Engine
from shelfspark.errors import NotFoundError, QueryError, UnsupportedError, ValidationError
from shelfspark.model import Field, Resource
from shelfspark.operators import browse, consortium, facets, search
from shelfspark.plans import index
from shelfspark.plans.library import RESOURCES

BOOKS = Resource(
    "books",
    (
        Field("id", uses=("sort",)),
        Field("title", "multilang", uses=("sort",)),
        Field("series", "standard", True),
        Field("langs", "keyword", True, ("facet", "filter")),
        Field("status", "keyword", uses=("facet", "filter")),
        Field("code", "keyword_no_space_dash"),
        Field("year", "long", uses=("filter", "sort")),
        Field("added", "date", uses=("filter",)),
    ),
    aliases={"keyword": ("title", "series"), "any": ("title", "status")},
)
ROWS = [
    ("1", "Semantic web primer", ["Cooperative information"], ["eng"], "A", "ab-1 2", 2004, "2020-01-01 00:00:00"),
    ("2", "A web of wi-fi", None, ["eng", "ger"], "B", "AB12", 1999, "2020-02-01 00:00:00"),
    ("3", "Déjà vu", ["Straße", "web"], [], None, None, None, None),
    ("4", "", ["Semantic systems"], None, "A", "x", 2010, "2021-05-05 10:00:00"),
    ("5", None, None, ["rus"], "C", "y", 2004, None),
]


@pytest.fixture(scope="module")
def books(spark):
    return spark.createDataFrame(ROWS, "id string, title string, series array<string>, langs array<string>, status string, code string, year long, added string").withColumn("added", F.col("added").cast("timestamp"))


QUERIES = [
    ("keyword = *", "12345"), ("cql.allRecords=1", "12345"), ("title = web", "12"), ('title all "web primer"', "1"), ('title any "primer vu"', "13"), ('title == "semantic web"', "1"), ('title == "web semantic"', ""),
    ('title ==/string "semantic WEB primer"', "1"), ('keyword = "semantic information"', "1"), ("keyword = web", "123"), ("title <> web", "345"), ('title = ""', "1234"), ('title == ""', "4"), ("langs == []", "34"),
    ("status == A", "14"), ("status <> A", "235"), ('status = ""', "1245"), ("cql.allRecords=1 not status = A", "235"), ("status == (A or C)", "145"), ("code = ab12", "12"), ("year > 2003 and year <= 2004", "15"),
    ("title = sem*", "1"), ("title = *we?*", "12"), ("title = deja", "3"), ("series = strasse", "3"), ("title = wifi", "2"), ("title = fi", "2"), ('any = "web"', "12"), ('added >= "2020-02-01"', "24"),
    ('series ==/string "semantic SYSTEMS"', "4"), ('any == "a"', "2"),
    ("langs = ger or langs = rus and year = 2004", "5"), ("(title = web or status = C) not langs = ger", "15"),
]


@pytest.mark.parametrize("cql,ids", QUERIES)
def test_queries(books, cql, ids):
    assert "".join(sorted(r.id for r in search.matched(books, cql, BOOKS).collect())) == ids


def test_stored_copies_give_the_same_results(books):
    prepared = index.prepared(books, BOOKS)
    assert {"norm__title", "tok__title", "base__series", "norm__code"} <= set(prepared.columns)
    for cql, ids in QUERIES[2:12]:
        assert "".join(sorted(r.id for r in search.matched(prepared, cql, BOOKS).collect())) == ids


def test_parser():
    assert parse('a = 1 or b == "x y" and c all z sortBy d e/sort.descending').keys == (Key("d"), Key("e", True))
    assert parse("a = 1 or b = 2 and c = 3").root == Boolean("and", Boolean("or", Clause("a", "=", "1"), Clause("b", "=", "2")), Clause("c", "=", "3"))
    assert parse('a ==/string "q \\" q"').root == Clause("a", "==", 'q " q', ("string",))
    for bad in ("", "a = ", "(a = 1", "a = 1)", 'a = "x', "a = 1 and", "a = 1 sortBy"):
        with pytest.raises(QueryError):
            parse(bad)


@pytest.mark.parametrize("cql,error", [("nope = 1", QueryError), ("title < 5", UnsupportedError), ("keyword > 5", UnsupportedError), ('added > "soon"', QueryError), ("title = a prox title = b", UnsupportedError), ("title within 5", QueryError)])
def test_refused(cql, error):
    with pytest.raises(error):
        bind(cql, BOOKS)


def test_sorting_and_pages(books):
    ids = lambda cql, **k: "".join(r.id for r in search.search(books, cql, BOOKS, **k).collect())
    assert ids("cql.allRecords=1 sortBy year") == "21543"
    assert ids("cql.allRecords=1 sortBy year/sort.descending") == "41523"
    assert ids("cql.allRecords=1 sortBy year", limit=2, offset=1) == "15"
    with pytest.raises(QueryError):
        ids("cql.allRecords=1 sortBy langs")
    with pytest.raises(ValidationError):
        ids("cql.allRecords=1", limit=500, offset=9600)


def test_facets(books):
    got = {(r.facet, r.id): (r.total_records, r.selected) for r in facets.facets(books, "cql.allRecords=1 and status == A and langs == eng", ["status", "langs:5"], BOOKS).collect()}
    assert got == {("status", "A"): (1, True), ("status", "B"): (1, False), ("langs", "eng"): (1, True)}
    for bad in ("title", "nope", "a b", "status:x", ""):
        with pytest.raises(QueryError):
            facets.facets(books, "cql.allRecords=1", [bad], BOOKS)


def test_browse_contexts():
    ctx = lambda cql, **k: browse.context(cql, PARTS, "shelf", **k)
    assert ctx("shelf < x or shelf >= x", limit=10, preceding=3) == browse.Context("x", 3, 7, True, ())
    assert ctx("shelf <= x", limit=5).backward == 5 and len(ctx("shelf > x and p_type == A", limit=5).filters) == 1
    for bad in ("shelf > x sortBy shelf", "shelf > x or shelf < y", "p_name = x", "shelf > x or shelf > x", "shelf > x and p_name = y"):
        with pytest.raises(QueryError):
            ctx(bad)
    with pytest.raises(ValidationError):
        ctx("shelf < x or shelf > x", limit=5, preceding=5)


def test_folding_equals_its_text_form(spark):
    texts = ["Déjà VU", "STRASSE straße", "Æther œuvre", "Ångström İ ı", "ÿ Ž ø Ł", "plain", " a-b_c "]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", analysis.fold(F.col("t")).alias("f"), analysis.base_tokens(F.col("t")).alias("w")).collect():
        assert r.f == analysis.fold_text(r.t) and r.w == analysis.text_tokens(r.t)


def test_truncation_keeps_characters(spark):
    texts = ["é" * 10, "abc", "日本語" * 5, "a" * 20, "😀" * 6]
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", analysis.truncated(F.col("t"), 11).alias("c")).collect():
        want = r.t.encode()[:11].decode("utf-8", "ignore")
        assert r.c == want


def test_engine(spark, tmp_path):
    rows = [("1", "t1", False, "Alpha beta"), ("2", "t2", False, "Beta"), ("3", "c", True, "Gamma beta")]
    df = spark.createDataFrame(rows, "id string, tenantId string, shared boolean, title string")
    parts = Resource("instance", (Field("id", uses=("sort",)), Field("tenantId", uses=("facet", "filter")), Field("shared", "bool", uses=("facet", "filter")), Field("title", "standard")))
    engine = Engine(spark, {"instance": df}, consortium.Tenant("t1", "c"), {"instance": parts})
    assert [r.id for r in engine.search("instance", "title = beta").collect()] == ["1", "3"]
    assert engine.search("instance", "title = beta", consolidated=True).count() == 3
    assert engine.total("instance", "title = beta") == 2
    engine.store("instance", df, f"{tmp_path}/instance", 2)
    assert {r.id for r in engine.ids("instance", "title = gamma").collect()} == {"3"}
    assert engine.facets("instance", "title = beta", ["tenantId"]).count() == 2
    with pytest.raises(ValidationError):
        engine.configure_languages(["eng"] * 6)
    engine.drop("instance")
    with pytest.raises(NotFoundError):
        engine.search("instance", "title = x")


def test_descriptors_bind():
    instance = RESOURCES["instance"]
    assert bind("isbn = 047144250X", instance)[0].value and bind('item.barcode == "1"', instance)
    assert bind('lccn = "N 79 021 425"', instance)[0].value == "n79021425"
    assert "items" in instance.schema().fieldNames()


def test_call_number_browse_through_the_engine(spark):
    rows = [(str(i), f"QA{n} .B{i} 19{90 + i}", "lc") for i, n in enumerate([9, 76, 300, 1000, 12])]
    df = spark.createDataFrame(rows, "id string, fullCallNumber string, callNumberTypeId string")
    engine = Engine(spark, {"instance_call_number": df})
    engine.configs.put("instance-call-number", "lc", "LC", ("lc",))
    found = engine.browse("call-numbers", 'fullCallNumber >= "QA12 .B4 1994"', 3, option="lc").collect()
    assert [r.fullCallNumber.split()[0] for r in found] == ["QA12", "QA76", "QA300"] and found[0].is_anchor


def test_patterns_find_what_tokens_have(spark):
    """Text conditions without stored tokens against those on token arrays, on texts full of signs."""
    rng = random.Random(3)
    texts = ["".join(rng.choice("aabb  é1-_.'/ß\n日\u00a0") for _ in range(rng.randint(0, 25))) for _ in range(150)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, title string")
    one = Resource("t", (Field("id", "long"), Field("title", "standard")))
    stored = index.prepared(df, one)
    asked = sorted({w for t in texts if t for w in analysis.text_tokens(t)})[::3] + ["ab", "a"]
    asked = [w for w in asked if "*" not in w]
    for op, words in [("all", [w]) for w in asked[:25]] + [("all", [a, b]) for a, b in zip(asked[:8], asked[5:13], strict=True)] + [("any", asked[3:9])] + [("==", [a, b]) for a in ("a", "b", "1") for b in ("b", "e", "a1")]:
        cql = f'title {op} "{" ".join(words)}"'
        want = {r.id for r in search.matched(stored, cql, one).collect()}
        assert {r.id for r in search.matched(df, cql, one).collect()} == want, cql


def test_relevance_orders_a_search(spark, tmp_path):
    rows = [("1", "t1", True, "web web web"), ("2", "t1", True, "a web of many other words that are long"), ("3", "t1", True, "primer"), ("4", "x", False, "web")]
    df = spark.createDataFrame(rows, "id string, tenantId string, shared boolean, title string")
    parts = Resource("instance", (Field("id", uses=("sort",)), Field("tenantId"), Field("shared", "bool"), Field("title", "standard")))
    engine = Engine(spark, {"instance": df}, consortium.Tenant("t1", "c"), {"instance": parts})
    assert [r.id for r in engine.search("instance", "title = web").collect()] == ["1", "2"]
    engine.store_inverted("instance", f"{tmp_path}/inverted", 2)
    assert [r.id for r in engine.search("instance", "title = web", consolidated=True).collect()] == ["1", "4", "2"]
    assert [r.id for r in engine.search("instance", "title = web sortBy id/sort.descending").collect()] == ["2", "1"]
    assert engine.search("instance", "title = web").columns == ["id", "tenantId", "shared", "title"]
    top = index.Inverted.open(spark, f"{tmp_path}/inverted").top("web", ["title"]).collect()
    n, mean = 4, (3 + 9 + 1 + 1) / 4
    idf = math.log(1 + (n - 3 + 0.5) / 3.5)
    want = {k: idf * tf / (tf + 1.2 * (0.25 + 0.75 * length / mean)) for k, tf, length in (("1", 3, 3), ("2", 1, 9), ("4", 1, 1))}
    assert {r.key: r.score for r in top} == pytest.approx(want) and [r.key for r in top] == sorted(want, key=lambda k: -want[k])
