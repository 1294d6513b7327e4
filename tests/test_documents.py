"""Projection through objects and lists, scrolls over versions, jobs that outlast a process, analysers and indexes."""

import pytest
from pyspark.sql import functions as F

from shelfspark import analysis
from shelfspark.engine import Engine
from shelfspark.errors import NotFoundError, ValidationError
from shelfspark.functions import stemming
from shelfspark.model import Field, Resource
from shelfspark.operators import ids, search
from shelfspark.operators.tables import Versions
from shelfspark.plans import documents, index

DEEP = Resource("deep", (Field("id"), Field("a.b", "keyword", True, default="d"), Field("a.c.d", "long", True), Field("e.f", default="z"), Field("gone", "none")))
SCHEMA = "id string, junk int, a array<struct<b string, x int, c array<struct<d long, plain_d long, y int>>>>, e struct<f string, g int>, plain_id string, gone string"
ROWS = [
    ("1", 1, [("p", 1, [(1, 10, 0), (2, None, 0)]), (None, 1, None), None], (None, 1), "one", "g"),
    ("2", 1, [], None, None, None), ("3", 1, None, ("q", 2), "three", None),
]


def test_projection_goes_through_lists_of_objects(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    out = documents.projected(df, DEEP)
    assert out.schema.simpleString() == "struct<id:string,a:array<struct<b:string,c:array<struct<d:bigint>>>>,e:struct<f:string>>"
    one, two, three = (r.asDict(True) for r in out.orderBy("id").collect())
    assert one["a"] == [{"b": "p", "c": [{"d": 1}, {"d": 2}]}, {"b": "d", "c": None}, None] and one["e"] == {"f": "z"}
    assert two["a"] == [] and two["e"] is None and three["a"] is None and three["e"] == {"f": "q"}


def test_plain_values_win_at_every_level(spark):
    out = documents.unplained(spark.createDataFrame(ROWS[:1], SCHEMA)).first().asDict(True)
    assert out["id"] == "one" and [x["d"] for x in out["a"][0]["c"]] == [10, None] and "plain_d" not in out["a"][0]["c"][0]


def test_paths_go_through_lists(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    got = df.select("id", documents.at_path(df, "a.c.d").alias("d"), documents.at_path(df, "a.b").alias("b"), documents.at_path(df, "e.f").alias("f")).orderBy("id").collect()
    assert [(r.d, r.b, r.f) for r in got] == [([1, 2], ["p"], None), ([], [], None), (None, None, "q")]


R = Resource("r", (Field("id", "long", uses=("sort",)), Field("kind", uses=("filter",))))


def test_a_scroll_keeps_its_version(spark, tmp_path):
    table = Versions(spark, f"file://{tmp_path}/t", 3)
    make = lambda ids_, kind: spark.createDataFrame([(i, kind) for i in ids_], "id long, kind string")
    table.replace(make(range(25), "a"), ["id"])
    scroll, seen, cursor, turn = ids.Scroll(table, R), [], None, 0
    while turn == 0 or cursor:
        page, cursor = ids.Scroll(Versions(spark, f"file://{tmp_path}/t", 3), R).page("kind == a", 10, cursor)
        seen += [r.id for r in page.collect()]
        table.merge(make(range(turn, 40, 3), "b"), ["id"])  # between pages rows change and come
        table.prune(keep=8)
        turn += 1
    assert seen == list(range(25)) and scroll.page("kind == a", 50)[0].count() < 25
    table.prune()
    with pytest.raises(ValueError):
        scroll.page("kind == a", 10, '{"version": 0, "last": 3}')


def test_jobs_outlast_a_process(spark, tmp_path):
    df = spark.createDataFrame([("x", "a"), ("y", "b")], "id string, kind string")
    r = Resource("r", (Field("id"), Field("kind")))
    ids.Jobs(spark, f"file://{tmp_path}/jobs").run("one", df, "kind == a", r, "INSTANCE")
    with pytest.raises(Exception):
        ids.Jobs(spark, f"file://{tmp_path}/jobs").run("bad", df.withColumn("id", F.raise_error(F.lit("no"))), "kind == a", r, "INSTANCE")
    again = ids.Jobs(spark, f"file://{tmp_path}/jobs")
    assert again.state("one") == "COMPLETED" and again.state("bad") == "ERROR" and again.state("none") is None
    assert list(again.stream("one")) == ["x"] and again.state("one") == "DEPRECATED"
    with pytest.raises(NotFoundError):
        list(again.stream("one"))
    assert again.clean() == ["one"] and again.clean() == []


# words and their stems as the algorithm's description gives them
PORTER = """caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size hopping hop
 tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration valenci valenc digitizer digit conformabli conform
 radicalli radic differentli differ vileli vile analogousli analog vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous
 formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr electrical electr hopeful hope goodness good revival reviv allowance allow
 inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust dependent depend adoption adopt homologou homolog
 communism commun activate activ angulariti angular homologous homolog effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll is is""".split()
OTHER = {"ger": "hauser haus hauses haus kindern kind kinder kind schonsten schon fern fern", "fre": "chevaux cheval grandes grand heureux heureu mere mere", "spa": "luces luz meses mes libros libr casas cas sol sol"}


@pytest.mark.parametrize("language", list(stemming.STEMMERS))
def test_stems_of_columns_and_of_words(spark, language):
    found = PORTER if language == "eng" else OTHER[language].split()
    words, stems = found[::2], found[1::2]
    stemmer = stemming.STEMMERS[language]
    assert [stemmer.word(w) for w in words] == stems
    df = spark.createDataFrame([(words,)], "w array<string>")
    assert df.select(stemmer.column(F.col("w"))).first()[0] == stems


def test_pairs_of_characters(spark):
    text = "東京都 is 京 and カタカナー x"
    assert stemming.text_pairs(text) == ["東京", "京都", "京", "カタ", "タカ", "カナ", "ナー"]
    assert spark.range(1).select(stemming.pairs(F.lit(text))).first()[0] == stemming.text_pairs(text)


@pytest.mark.parametrize("stored", [False, True])
def test_forms_of_a_word_meet_within_their_language(spark, stored):
    r = Resource("r", (Field("id"), Field("title", "multilang"), Field("languages", "keyword", True)), languages=("eng", "ger", "chi"))
    rows = [("1", "walking dogs", ["eng"]), ("2", "walked", ["ger"]), ("3", "Kinder", ["ger", "eng"]), ("4", "Kinder", ["eng"]), ("5", "Kind", None), ("6", "東京都", ["chi"]), ("7", "東京都", None), ("8", "cats & dogs", ["eng"])]
    df = spark.createDataFrame(rows, "id string, title string, languages array<string>")
    df = index.prepared(df, r) if stored else df
    ids_ = lambda cql: "".join(sorted(x.id for x in search.matched(df, cql, r).collect()))
    assert ids_("title = walks") == "1" and ids_("title = kind") == "35" and ids_("title any \"kindern walk\"") == "13"
    assert ids_('title == "walk dog"') == "1" and ids_('title == "dog walk"') == "" and ids_("title = 東京") == "6" and ids_("title = kindern") == "3"
    assert ids_('title == "cats and dogs"') == "8" and ids_("title <> walks") == "2345678"


def test_an_engine_reads_records_by_the_configured_languages(spark):
    df = spark.createDataFrame([("1", "running", ["eng"]), ("2", "kinder", ["ger"])], "id string, indexTitle string, languages array<string>")
    engine = Engine(spark, {"instance": df})
    found = lambda cql: [r.id for r in engine.search("instance", cql).collect()]
    assert found("indexTitle = runs") == ["1"] and found("indexTitle = kinds") == []
    engine.configure_languages(["ger"])
    assert found("indexTitle = runs") == [] and found("indexTitle = kinde") == ["2"]


BOOKS = Resource("b", (Field("id"), Field("title", "standard"), Field("series", "standard", True), Field("code", "keyword_icu"), Field("kind", uses=("filter",))), aliases={"keyword": ("title", "series"), "any": ("title", "kind")})
BOOK_ROWS = [
    ("1", "the art of the web", ["web of art", "the web"], "AB-12/c", "x"), ("2", "web the art", None, "xab-1", "y"), ("3", "Wi-Fi of the art", ["of", "the web"], None, "x"),
    ("4", None, ["a the", "art b"], "é%_9", None), ("5", "the the of the", [], "ab", "y"), ("6", "", [None], "", "x"),
]
CQLS = [
    'title == "the art"', 'keyword == "the web"', 'keyword == "the art"', 'title == "the the of"', "title = wifi", 'title == "wi fi"', "keyword all \"web art\"", 'keyword any "fi b"', 'title <> "the art"',
    'title == "of the" not kind == x', 'title = web or kind == y', 'any = "web"', 'keyword = the and code = *b-1*', "code = ab*", "code = *%?9", "code = *", "code <> ab*", "code = a*c and title = the", "code = *b*",
]


@pytest.mark.parametrize("cql", CQLS)
def test_indexes_find_what_conditions_do(spark, cql):
    df = spark.createDataFrame(BOOK_ROWS, "id string, title string, series array<string>, code string, kind string")
    plain = sorted(r.id for r in search.matched(df, cql, BOOKS).collect())
    found = index.filtered(df, index_bind(cql), BOOKS, index.Inverted.of(df, BOOKS), index.Grams.of(df, BOOKS, ("code",)))
    assert sorted(r.id for r in found.collect()) == plain


def index_bind(cql):
    from shelfspark.cql.bind import bind

    return bind(cql, BOOKS)[0]


def test_a_stored_pattern_tests_few_rows(spark, tmp_path):
    df = spark.range(5000).selectExpr("cast(id as string) as id", "concat('item ', lpad(cast(id as string), 4, '0'), ' end') as title", "cast(null as array<string>) as series", "concat('c', id) as code", "'x' as kind")
    engine = Engine(spark, {"b": df}, resources={"b": BOOKS})
    engine.store_grams("b", f"file://{tmp_path}/g", ("code",), 8)
    few = engine.grams["b"].candidates(index_bind("code = *c123?"))
    assert few.count() < 50 and engine.search("b", "code = *c123?").count() == 10
    assert analysis.normalised_text("keyword_icu", "C1*") == "c1*" and index.pattern_grams("c1*") == ["\x02c1"]


def test_location_units_of_every_kind(spark):
    df = spark.createDataFrame([("1", "North", "t1"), ("2", "East", "t2"), ("3", "West", "t1")], "id string, name string, tenantId string")
    engine = Engine(spark, dict.fromkeys(("institution", "campus", "library", "location"), df))
    for kind in ("institution", "campus", "library", "location"):
        assert [r.id for r in engine.units(kind).collect()] == ["2", "1", "3"]
        assert [r.id for r in engine.units(kind, tenant="t1", sort_by="id", descending=True).collect()] == ["3", "1"]
        assert [r.id for r in engine.units(kind, sort_by="tenantId", limit=1, offset=2).collect()] == ["2"]
    with pytest.raises(ValidationError):
        engine.units("campus", sort_by="code")
    with pytest.raises(NotFoundError):
        engine.units("shelf")
