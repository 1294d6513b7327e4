"""Browse, sort and facets compare, order and count normalised values; pages of tables stored in order."""

import random

import pytest

from shelfspark.engine import Engine
from shelfspark.model import Field, Resource
from shelfspark.operators import browse, facets, search
from shelfspark.operators.consortium import Tenant
from shelfspark.plans.ordered import Ordered

SUBJECTS = ["Art", "Music", "Éclair", "Zoo", "art history"]


@pytest.fixture(scope="module")
def engine(spark):
    subjects = spark.createDataFrame([(str(i), v) for i, v in enumerate(SUBJECTS)], "id string, value string")
    authorities = spark.createDataFrame([("1", "Apple", "Authorized"), ("2", "Zebra", "Reference"), ("3", "Melon", "Auth/Ref")], "id string, headingRef string, authRefType string")
    return Engine(spark, {"instance_subject": subjects, "authority": authorities})


def test_capitals_and_accents_are_met(engine):
    page = lambda kind, cql, **how: [(r[0], r.is_anchor) for r in engine.browse(kind, cql, **how).select("value" if kind == "subjects" else "headingRef", "is_anchor").collect()]
    assert page("subjects", 'value >= "Music"') == [("Music", True), ("Zoo", False)]
    assert page("subjects", 'value < "Music" or value >= "Music"', limit=6) == [("Art", False), ("art history", False), ("Éclair", False), ("Music", True), ("Zoo", False)]
    assert page("subjects", 'value < "ECLAIR"') == [("Art", False), ("art history", False)]
    assert page("subjects", 'value < "Mü" or value >= "Mü"', limit=2) == [("Éclair", False), ("Mü", True)]
    assert page("authorities", 'headingRef >= "Apple"') == [("Apple", True), ("Zebra", False)]


def test_sort_is_that_of_the_normalised_value(spark):
    r = Resource("r", (Field("id", uses=("sort",)), Field("name", "keyword_icu", uses=("sort",)), Field("names", "keyword_icu", True, ("sort",))))
    rows = [("1", "Zoo", ["b", "Z"]), ("2", "art", ["É"]), ("3", "Éclair", ["a", "Q"]), ("4", None, None), ("5", "ART", ["A"])]
    df = spark.createDataFrame(rows, "id string, name string, names array<string>")
    ids = lambda cql: "".join(x.id for x in search.search(df, cql, r).collect())
    assert ids("cql.allRecords=1 sortBy name") == "25314"
    assert ids("cql.allRecords=1 sortBy names/sort.descending") == "13254"
    assert ids("cql.allRecords=1 sortBy names") == "35124"


def test_facets_count_normalised_values(spark):
    r = Resource("r", (Field("id"), Field("f", "keyword_lowercase", uses=("facet", "filter"))))
    df = spark.createDataFrame([("1", "Book"), ("2", "Map"), ("3", "book"), ("4", None)], "id string, f string")
    found = facets.facets(df, 'f == "Book"', ["f"], r).collect()
    assert [(x.id, x.total_records, x.selected) for x in found] == [("book", 2, True), ("map", 1, False)]


def test_the_string_cql_all_may_be_a_term(engine):
    assert engine.search("instance_subject", 'value == "cql.all"').count() == 0


def page_of(df):
    return [tuple(r) for r in df.select("id", "value", "is_anchor", "position", "prev", "next").collect()]


@pytest.mark.parametrize("tenant", [Tenant("t1"), Tenant("t1", "central")])
def test_stored_pages_equal_those_of_the_whole_table(spark, tmp_path, tenant):
    """Ties over several ranges, nulls, an anchor before, behind and between all values, conditions that leave few rows."""
    rng = random.Random(3)
    names = [None, "Hot", "hot", "HÔT"] * 40 + ["".join(rng.choice("abÀÉçZz ") for _ in range(rng.randint(0, 4))) for _ in range(300)]
    rows = [(f"{i:04d}", v, f"t{rng.randint(0, 2)}", rng.random() < 0.1, [(f"t{rng.randint(0, 2)}", rng.random() < 0.2, 1)]) for i, v in enumerate(names)]
    df = spark.createDataFrame(rows, "id string, value string, tenantId string, shared boolean, instances array<struct<tenant_id string, shared boolean, count long>>")
    whole, stored = (Engine(spark, {"instance_subject": df}, tenant) for _ in range(2))
    stored.store_ordered("subjects", f"file://{tmp_path}/{tenant.central}", parts=20)
    both, only = 'value < "{0}" or value >= "{0}"', 'value < "{0}" or value > "{0}"'
    for anchor, cql, limit in (("hot", 'value >= "{0}"', 25), ("hot", only, 6), ("Hou", 'value < "{0}"', 150), ("", both, 5), ("zzzzzz", both, 250), ("é", both, 25), ("!", only, 25)):
        q = cql.format(anchor)
        assert page_of(stored.browse("subjects", q, limit)) == page_of(whole.browse("subjects", q, limit)), (q, limit)


def test_a_stored_page_reads_few_files(spark, tmp_path):
    df = spark.range(20_000).selectExpr("cast(id as string) as id", "concat('Name ', lpad(cast(id as string), 5, '0')) as value")
    r, order = Resource("r", (Field("id"), Field("value", "keyword_icu", uses=("sort",)))), browse.Order(("value", "id"), "value")
    ordered = Ordered.write(df, r, f"file://{tmp_path}/few", order, 50)
    ctx = browse.Context("Name 10000", 50, 50, True)
    near = ordered.near(ctx, "name 10000", r)
    assert len(ordered.rows().inputFiles()) > 40 and 0 < len(near.inputFiles()) <= 4
    page = browse.browse(near, ctx, order, r)
    assert [x.value for x in page.collect()] == [f"Name {i:05d}" for i in range(9950, 10050)]


def test_shelving_keys_are_stored(spark, tmp_path):
    rows = [(str(i), f"QA {i}.5 .B{i}") for i in (2, 10, 100, 9, 30)] + [("x", None)]
    df = spark.createDataFrame(rows, "id string, fullCallNumber string")
    whole, stored = (Engine(spark, {"instance_call_number": df}) for _ in range(2))
    stored.store_ordered("call-numbers", f"file://{tmp_path}/shelf", option="lc", parts=3)
    q = 'fullCallNumber < "QA 10" or fullCallNumber >= "QA 10"'
    got = [(r.id, r.fullCallNumber, r.is_anchor) for r in stored.browse("call-numbers", q, option="lc").collect()]
    assert got == [(r.id, r.fullCallNumber, r.is_anchor) for r in whole.browse("call-numbers", q, option="lc").collect()]
    assert [x[0] for x in got] == ["2", "9", None, "10", "30", "100", "x"]
