"""More queries over the star-schema tables: derived fields, term processors, relevance, affiliation, documents, bookkeeping."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..engine import Engine
from ..functions import identifiers, linked_data, records
from ..functions.shelving import shelving_orders
from ..model import Field, Resource
from ..operators import browse as B
from ..operators import consortium, facets, lookups, search, tables
from ..plans import children, documents, index, reindex
from ..sources import events
from .catalog import DOCUMENTS, PARTS, instances, parts, table
from .registry import DOC_SQL, FOUND, INSTANCE_SQL, PART_SQL, add, has
from .stored import inverted



def key():
    return F.col("p_partkey").cast("string")


def text(c):
    return F.lit(c) if isinstance(c, str) else c


def structs(*rows: dict) -> Column:
    return F.array(*[F.struct(*[text(v).alias(k) for k, v in r.items()]) for r in rows])


def on_part(name: str, sql: str, columns: Callable[[], dict]) -> None:
    """Derived columns of all parts; ``sql`` gives the same beside the key."""
    FOUND[name] = (lambda spark, sf: table(spark, sf, "part").select("p_partkey", *[c.alias(n) for n, c in columns().items()]), f"SELECT p_partkey, {sql} FROM part")


def ids(*pairs) -> F.Column:
    return structs(*[{"value": v, "type": t} for v, t in pairs])


def thirteen():
    return F.concat(F.lit("978"), F.lpad(key(), 10, "0"))


on_part("fn_isbns", "'978' || lpad(p_partkey::VARCHAR, 10, '0') || '|ab 12' AS isbns", lambda: dict(isbns=F.array_join(identifiers.isbns(ids((thirteen(), "ISBN"), ("AB 1-2", "Invalid ISBN"), (thirteen(), "ISBN"), ("x", "ISSN"))), "|")))
on_part("fn_issns", "'1234-' || p_size AS issns", lambda: dict(issns=F.array_join(identifiers.issns(ids((F.concat(F.lit(" 1234-"), "p_size"), "ISSN"), (F.concat(F.lit("1234-"), "p_size"), "Linking ISSN"), ("no", "ISBN"))), "|")))
on_part("fn_oclcs", "'1' || p_partkey AS oclcs", lambda: dict(oclcs=F.array_join(identifiers.oclcs(ids((F.concat(F.lit("(OCoLC)001"), key()), "OCLC"), ("none", "Cancelled OCLC"), ("7", "ISBN"))), "|")))
on_part("fn_canceled_lccns", "lower(replace(p_brand, ' ', '')) || '1' AS lccns", lambda: dict(lccns=F.array_join(identifiers.lccns(ids((F.concat("p_brand", F.lit(" 1")), "Canceled LCCN"), ("n", "LCCN")), canceled=True), "|")))
on_part("fn_identifier_types", "CASE WHEN p_size > 25 THEN p_brand ELSE '' END AS found", lambda: dict(found=F.array_join(identifiers.of_types(ids(("p", "x"), (F.col("p_brand"), F.when(F.col("p_size") > 25, "wanted").otherwise("other"))), ("wanted",)), "|")))
on_part("fn_sort_contributor", "CASE WHEN p_size > 25 THEN p_type ELSE p_brand END AS name", lambda: dict(name=records.sort_contributor(structs({"name": F.col("p_brand"), "primary": F.lit(False)}, {"name": F.col("p_type"), "primary": F.col("p_size") > 25}))))
on_part("fn_statistical_codes", "p_type || '|' || p_brand AS codes", lambda: dict(codes=F.array_join(records.union_codes(F.array("p_type", F.lit(" ")), F.array("p_brand", "p_type", F.lit(None))), "|")))
on_part("fn_uniform_titles", "CASE WHEN p_size % 2 = 1 THEN p_name ELSE '' END AS titles", lambda: dict(titles=F.array_join(records.uniform_titles(structs({"alternativeTitle": F.col("p_name"), "type": F.when(F.col("p_size") % 2 == 1, "Uniform Title").otherwise("Other")}, {"alternativeTitle": "x", "type": "Other"})), "|")))
on_part("fn_tags", "p_type || '|b' AS tags", lambda: dict(tags=F.array_join(records.tags(F.array(F.concat(F.lit(" "), "p_type"), F.lit("  "), F.lit("b"), "p_type")), "|")))
on_part("fn_record_identifiers", "p_brand || '|' || CASE WHEN p_size > 9 THEN p_type || '|' ELSE '' END || p_name AS found", lambda: dict(found=F.array_join(records.identifiers(F.array("p_brand"), F.when(F.col("p_size") > 9, F.col("p_type")), F.col("p_name")), "|")))
on_part("fn_classification_ids", "sha1(left(trim(p_name), 50) || '|' || p_type) AS ids", lambda: dict(ids=F.array_join(records.classification_ids(structs({"classificationNumber": F.concat(F.lit(" "), "p_name"), "classificationTypeId": F.col("p_type")}, {"classificationNumber": " ", "classificationTypeId": "t"}, {"classificationNumber": F.col("p_name"), "classificationTypeId": F.col("p_type")})), "|")))
on_part("fn_holdings_type_ids", "p_type || '|' || p_brand AS ids", lambda: dict(ids=F.array_join(records.holdings_type_ids(structs({"holdingsTypeId": F.concat(F.lit(" "), "p_type")}, {"holdingsTypeId": F.lit(None).cast("string")}, {"holdingsTypeId": ""}, {"holdingsTypeId": F.col("p_brand")}, {"holdingsTypeId": F.col("p_type")})), "|")))
on_part(
    "fn_merged_lists",
    "p_type || '|' || p_brand || CASE WHEN p_size > 9 THEN '|' || p_type ELSE '' END AS list, p_type || '|' || p_brand AS set",
    lambda: dict(list=F.array_join(records.merged_list(F.array("p_type"), F.lit(None).cast("array<string>"), F.array("p_brand"), F.when(F.col("p_size") > 9, F.array("p_type"))), "|"),
    set=F.array_join(records.merged_set(F.array("p_type"), F.array("p_brand"), F.when(F.col("p_size") > 9, F.array("p_type"))), "|")),
)


def orders():
    shelf = F.concat(F.lit("qa"), F.col("p_size").cast("string"), F.lit(" .c"), F.col("p_size").cast("string"))
    return shelving_orders(shelf, ("DEFAULT", "LC", "NLM", "DEWEY"))


LC_SQL = "'QA ' || length(p_size::VARCHAR) || p_size || ' C' || p_size"
on_part("fn_shelving_orders", f"upper('qa' || p_size || ' .c' || p_size) AS \"defaultShelvingOrder\", {LC_SQL} AS \"lcShelvingOrder\", {LC_SQL} AS \"nlmShelvingOrder\", NULL::VARCHAR AS \"deweyShelvingOrder\"", lambda: orders())
on_part("fn_shelving_dewey", "length(p_size::VARCHAR) || p_size || '.5 R' || p_size AS dewey", lambda: dict(dewey=shelving_orders(F.concat(F.lit(" 00"), F.col("p_size").cast("string"), F.lit(".5 r"), F.col("p_size").cast("string")), ("DEWEY",))["deweyShelvingOrder"]))


def titles():
    return structs({"value": F.col("p_name")}, {"value": " "}, {"value": F.col("p_name")})


def inner():
    return F.array(F.struct(structs({"value": F.col("p_brand")}, {"value": F.col("p_name")}).alias("titles")), F.struct(F.lit(None).cast("array<struct<value:string>>").alias("titles")))


on_part(
    "fn_linked_data",
    "p_name || '|' || p_brand AS titles, p_name AS sort_title, lower(replace(p_brand, ' ', '')) AS lccns, '978' || lpad(p_partkey::VARCHAR, 10, '0') AS isbns",
    lambda: dict(
        titles=F.array_join(linked_data.work_and_instances(titles(), inner(), "titles", "value"), "|"),
        sort_title=linked_data.sort_title(titles()),
        lccns=F.array_join(linked_data.lccns(ids((F.col("p_brand"), "lccn"), ("1", "ISBN"))), "|"),
        isbns=F.array_join(linked_data.isbns(ids((thirteen(), "ISBN"), ("1", "LCCN"))), "|"),
    ),
)


# terms that a field's processor rewrites
def processed(name: str, cql: str, column, fields: Field, where: str) -> None:
    resource = Resource("parts", (Field("p_partkey", "long"), fields), key="p_partkey")
    FOUND[name] = (lambda spark, sf: search.matched(table(spark, sf, "part").select("p_partkey", column().alias(fields.path)), cql, resource).select("p_partkey"), f"SELECT p_partkey FROM part WHERE {where}")


processed("term_call_number", 'number = "BRAND 1"', lambda: records.normalised_call_number(F.col("p_brand"), F.col("p_type")), Field("number", "keyword_lowercase", term=records.call_number_term), "regexp_replace(lower(p_brand || p_type), '[^a-z0-9]', '', 'g') LIKE 'brand1%'")
processed("term_classification", 'number = "*d#2*"', lambda: records.classification_number(F.concat_ws("-", "p_brand", "p_type")), Field("number", "keyword_icu", term=records.classification_term), "regexp_replace(lower(p_brand || p_type), '[^a-z0-9]', '', 'g') LIKE '%d2%'")
processed("term_isbn", 'isbn = "978-0-0000-001-2"', lambda: F.array(F.concat(F.lit("978"), F.lpad((F.col("p_partkey") % 100).cast("string"), 9, "0"))), Field("isbn", "keyword", True, term=lambda t: identifiers.no_space_term(t).replace("-", "")), "p_partkey % 100 = 12")
processed("term_isbn_prefix", "isbn = 97800000001*", lambda: F.array(thirteen()), Field("isbn", "keyword", True, term=identifiers.isbn_term), "lpad(p_partkey::VARCHAR, 10, '0') LIKE '00000001%'")
processed("term_oclc", 'oclc = "(OCoLC)ocm0012"', lambda: F.array(key()), Field("oclc", "keyword", True, term=identifiers.oclc_term), "p_partkey = 12")
processed("term_no_space", 'lccn = "Brand #1 2"', lambda: F.array(identifiers.no_space(F.col("p_brand"))), Field("lccn", "keyword_icu", True, term=identifiers.no_space_term), "p_brand = 'Brand#12'")


@add("term_call_number_type", "SELECT p_partkey FROM part WHERE p_type IN ('SMALL', 'ECONOMY')")
def _(spark, sf):
    configs = B.Configs()
    configs.put("instance-call-number", "other", "DEFAULT", ("SMALL", "ECONOMY"))
    kind = Resource("parts", (Field("p_partkey", "long"), Field("p_type", "keyword", term=records.call_number_type_term(configs))), key="p_partkey")
    return search.matched(table(spark, sf, "part"), "p_type = other", kind).select("p_partkey")


@add("cql_field_modifier", "SELECT p_partkey FROM part WHERE p_brand = 'Brand#3'")
def _(spark, sf):
    renamed = Resource("parts", (Field("p_partkey", "long"), Field("items.brand", "keyword")), rename=(("item.", "items."),), key="p_partkey")
    return search.matched(table(spark, sf, "part").select("p_partkey", F.struct(F.col("p_brand").alias("brand")).alias("items")), 'item.brand == "Brand#3"', renamed).select("p_partkey")


@add("cql_dotted_path", "SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20 AND p_type = 'SMALL'")
def _(spark, sf):
    nested = Resource("parts", (Field("p_partkey", "long"), Field("dims.size", "long", uses=("filter",)), Field("dims.kind.name", "keyword")), key="p_partkey")
    rows = table(spark, sf, "part").select("p_partkey", F.struct(F.col("p_size").alias("size"), F.struct(F.col("p_type").alias("name")).alias("kind")).alias("dims"))
    return search.matched(rows, "dims.size >= 10 and dims.size <= 20 and dims.kind.name == SMALL", nested).select("p_partkey")


@add("cql_backslash", "SELECT p_partkey FROM part WHERE p_size = 3")
def _(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", F.when(F.col("p_size") == 3, F.lit("a\\b")).otherwise(F.lit("a\\\\b")).alias("path"))
    return search.matched(rows, r'path == "a\\b"', Resource("parts", (Field("p_partkey", "long"), Field("path", "keyword")), key="p_partkey")).select("p_partkey")


@add("text_empty_string", "SELECT p_partkey FROM part WHERE p_size = 7")
def _(spark, sf):
    return search.matched(parts(spark, sf).withColumn("p_name", F.when(F.col("p_size") == 7, F.lit("")).otherwise(F.col("p_name"))), 'p_name == ""', PARTS).select("p_partkey")


@add("browse_empty_anchor", f"SELECT p_partkey, shelf FROM {PART_SQL} WHERE false")
def _(spark, sf):
    return B.browse(parts(spark, sf), B.context('shelf >= ""', PARTS, "shelf", 10), B.Order(("shelf", "p_partkey"), "shelf"), PARTS).select("p_partkey", "shelf")


@add("total_hits", "SELECT count(*) AS total FROM part WHERE p_type = 'ECONOMY' AND p_size >= 10")
def _(spark, sf):
    return spark.createDataFrame([(search.total(parts(spark, sf), "p_type == ECONOMY and p_size >= 10", PARTS),)], "total long")


@add("facet_totals", "SELECT 'p_type' AS facet, count(DISTINCT p_type) AS total_records FROM part WHERE p_size > 10 AND p_brand = 'Brand#3' UNION ALL SELECT 'p_brand', count(DISTINCT p_brand) FROM part WHERE p_size > 10 UNION ALL SELECT 'p_size', 4")
def _(spark, sf):
    specs = ["p_type", "p_brand", "p_size:4"]
    return facets.totals(facets.facets(parts(spark, sf), 'p_size > 10 and p_brand == "Brand#3"', specs, PARTS), specs, PARTS)


# relevance
TOKENS = r"""flatten(list_transform(list_filter(regexp_split_to_array(f, '\s+'), lambda w: w <> ''), lambda w: list_filter(regexp_split_to_array(w, '[^\p{L}\p{N}]+'), lambda x: x <> '')
 || CASE WHEN len(list_filter(regexp_split_to_array(w, '[^\p{L}\p{N}]+'), lambda x: x <> '')) > 1 THEN [regexp_replace(w, '[^\p{L}\p{N}]+', '', 'g')] ELSE [] END))"""


def relevance_sql(words: list[str], every: bool, limit: int) -> str:
    tf = ", ".join(f"len(list_filter(t, lambda x: x = '{w}')) AS tf{i}" for i, w in enumerate(words))
    score = " + ".join(f"CASE WHEN tf{i} > 0 THEN ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} / (tf{i} + 1.2 * (1 - 0.75 + 0.75 * l * n / nt)) ELSE 0 END" for i in range(len(words)))
    test = (" AND " if every else " OR ").join(f"tf{i} > 0" for i in range(len(words)))
    dfs = ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(words)))
    return f"""WITH d AS (SELECT doc_id, len(t) AS l, {tf} FROM (SELECT doc_id, {TOKENS} AS t FROM {DOC_SQL})),
 s AS (SELECT count(*) FILTER (l > 0) AS n, sum(l) AS nt, {dfs} FROM d)
 SELECT doc_id, round({score}, 6) AS score FROM d, s WHERE {test} ORDER BY {score} DESC, doc_id LIMIT {limit}"""


@add("search_relevance", relevance_sql(["the", "with"], True, 25))
def _(spark, sf):
    return inverted(spark, sf).top("the with", ["text"], 25).select(F.col("key").alias("doc_id"), F.round("score", 6).alias("score"))


@add("search_relevance_any", relevance_sql(["nicht", "pour", "value"], False, 40))
def _(spark, sf):
    return inverted(spark, sf).top("nicht pour value", ["text"], 40, every=False).select(F.col("key").alias("doc_id"), F.round("score", 6).alias("score"))


@add("search_ranked", f"SELECT r.doc_id, lang FROM ({relevance_sql(['the', 'with'], True, 1000000)}) r JOIN {DOC_SQL} d ON r.doc_id = d.doc_id WHERE n_chars > 500 ORDER BY score DESC, r.doc_id LIMIT 15")
def _(spark, sf):
    docs = table(spark, sf, "documents")
    shown = Resource("documents", tuple(f.__class__(**{**f.__dict__, "shown": f.path == "lang"}) for f in DOCUMENTS.fields), key="doc_id")
    return search.search(docs, 'text all "the with" and n_chars > 500', shown, 15, inverted=inverted(spark, sf))


@add("text_inverted", f"SELECT doc_id FROM {DOC_SQL} WHERE {has('the')} AND {has('with')}")
def _(spark, sf):
    return index.Inverted.of(table(spark, sf, "documents"), DOCUMENTS).hits("the with", ["text"]).select(F.col("key").alias("doc_id"))


# affiliation in browse
def _subjects(spark: SparkSession, sf: str) -> DataFrame:
    entities, relations = children.subjects(instances(spark, sf))
    return children.counted(relations, "subject_id", entities).select("id", "value", F.col("authority_id").alias("authorityId"), F.col("source_id").alias("sourceId"), F.col("type_id").alias("typeId"), "instances")


def on_subjects(name: str, tenant: consortium.Tenant, cql: str, where: str) -> None:
    def run(spark, sf):
        engine = Engine(spark, {"instance_subject": _subjects(spark, sf)}, tenant)
        return engine.browse("subjects", cql, 20).select("value", "typeId", children.total_count().alias("total"))

    FOUND[name] = (run, f"""SELECT value, type_id AS "typeId", count(*) AS total FROM (SELECT unnest(string_split(p_name, ' ')) AS value, p_type AS type_id, tenant_id, shared FROM {INSTANCE_SQL})
 WHERE {where} AND value >= 'm' GROUP BY ALL ORDER BY value, type_id LIMIT 20""")


on_subjects("browse_affiliation", consortium.Tenant("t1", "central"), 'value >= "m"', "(tenant_id = 't1' OR shared)")
on_subjects("browse_affiliation_central", consortium.Tenant("central", "central"), 'value >= "m"', "shared")
on_subjects("browse_affiliation_own", consortium.Tenant("t1", "central"), 'value >= "m" and instances.shared == false', "tenant_id = 't1' AND NOT shared")
on_subjects("browse_affiliation_tenant", consortium.Tenant("t1", "central"), 'value >= "m" and instances.tenantId == (t2 or t3)', "shared AND tenant_id IN ('t2', 't3')")


@add("search_consolidated", "SELECT p_partkey FROM part WHERE p_size = 7")
def _(spark, sf):
    p = table(spark, sf, "part").withColumn("tenantId", F.concat(F.lit("t"), (F.col("p_partkey") % 4).cast("string"))).withColumn("shared", F.lit(False))
    engine = Engine(spark, {"parts": p}, consortium.Tenant("t1", "central"), {"parts": Resource("parts", (Field("p_partkey", "long", uses=("sort",)), Field("p_size", "long")), key="p_partkey")})
    return engine.search("parts", "p_size = 7", limit=None, consolidated=True).select("p_partkey")


# documents
@add("document_projection", "SELECT p_partkey AS id, coalesce(CASE WHEN p_size > 10 THEN p_brand END, 'none') AS brand FROM part")
def _(spark, sf):
    resource = Resource("parts", (Field("id", "long"), Field("brand", "keyword", default="none"), Field("gone", "keyword")))
    return documents.projected(table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") > 10, F.col("p_brand")).alias("brand"), "p_name"), resource)


@add("document_unplained", "SELECT p_partkey, p_brand AS name, p_type AS kind FROM part")
def _(spark, sf):
    return documents.unplained(table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("name"), F.col("p_brand").alias("plain_name"), F.col("p_type").alias("plain_kind")))


@add("document_expansion", "SELECT p_partkey, lower(p_name) AS plain_p_name FROM part")
def _(spark, sf):
    return documents.expanded(parts(spark, sf).withColumn("p_name", F.concat(F.lit(" "), F.upper("p_name"))), PARTS).select("p_partkey", "plain_p_name")


@add("document_json", """SELECT p_partkey AS key, '{"id":' || p_partkey || ',"name":"' || p_name || '"' || CASE WHEN p_size > 10 THEN ',"size":' || p_size ELSE '' END || '}' AS body FROM part""")
def _(spark, sf):
    return documents.serialised(table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.when(F.col("p_size") > 10, F.col("p_size")).alias("size")))


@add("sharing_complete", "SELECT s_suppkey AS id, s_suppkey IN (SELECT l_suppkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size = 7) AS moved FROM supplier")
def _(spark, sf):
    numbers = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("old").alias("last_updated_date"))
    relations = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("instance_id"), F.col("l_suppkey").alias("call_number_id"))
    shared = table(spark, sf, "part").where("p_size = 7").select(F.col("p_partkey").alias("instance_id"))
    return events.sharing_completed(shared, relations, numbers, F.lit("new")).select("id", (F.col("last_updated_date") == "new").alias("moved"))


@add("heading_changes", "SELECT DISTINCT l_partkey AS document_id, 'CREATE' AS action FROM lineitem WHERE l_returnflag = 'N' UNION ALL SELECT DISTINCT l_partkey, 'DELETE' FROM lineitem WHERE l_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'N')")
def _(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("document_id"), "l_returnflag")
    return documents.heading_changes(rows.where("l_returnflag = 'N'").select("document_id").distinct(), rows.select("document_id").distinct())


@add("index_actions", "SELECT DISTINCT l_partkey AS id, CASE WHEN p_size > 25 THEN 'INDEX' ELSE 'DELETE' END AS action FROM lineitem JOIN part ON l_partkey = p_partkey")
def _(spark, sf):
    return documents.actions(table(spark, sf, "lineitem").select(F.col("l_partkey").alias("id")), table(spark, sf, "part").where("p_size > 25").select(F.col("p_partkey").alias("id")))


# lookups
@add("single_classification", """SELECT id, tenant_id, count, CASE WHEN count = 1 THEN one END AS instance_title FROM
 (SELECT p_brand || ' ' || p_type AS id, tenant_id, count(*) AS count, min(p_name) AS one FROM (SELECT *, 't' || (p_partkey % 4) AS tenant_id FROM part) GROUP BY ALL)""")
def _(spark, sf):
    i = instances(spark, sf).select("tenant_id", "title", "contributors", F.array(F.col("classifications")[0]["classificationNumber"]).alias("classification_ids"))
    counts = i.select(F.explode("classification_ids").alias("id"), "tenant_id").groupBy("id", "tenant_id").agg(F.count(F.lit(1)).alias("count"))
    return lookups.single_classifications(counts, i).select("id", "tenant_id", "count", "instance_title")


@add("holdings_of_items", "SELECT DISTINCT l_partkey AS instance_id, l_orderkey::VARCHAR AS id FROM lineitem WHERE (l_orderkey, l_linenumber) IN (SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 45)")
def _(spark, sf):
    li = table(spark, sf, "lineitem")
    item = F.struct(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("barcode"), F.col("l_orderkey").cast("string").alias("holding_id"))
    i = li.groupBy(F.col("l_partkey").alias("id")).agg(F.collect_list(item).alias("items"), F.collect_set(F.struct(F.col("l_orderkey").cast("string").alias("id"))).alias("holdings"))
    return lookups.holdings_of_items(i, li.where("l_quantity > 45").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("barcode")))


@add("reference_ids", "SELECT n_nationkey AS id FROM nation WHERE n_name IN ('NATION_0', 'NATION_1')")
def _(spark, sf):
    return lookups.reference_ids(table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")), ["NATION_0", "NATION_1", "NOWHERE"])


@add("batch_lookup_array", "SELECT l_partkey AS id FROM lineitem GROUP BY l_partkey HAVING count(*) FILTER (l_orderkey < 1200) > 0")
def _(spark, sf):
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.collect_set(F.col("l_orderkey").cast("string")).alias("former_ids"))
    return consortium.batch(rows, "FORMER_IDS", [str(i) for i in range(1200)]).select("id")


# bookkeeping
@add("uuid_ranges", """SELECT md5(text)[1:1] || '0000000-0000-0000-0000-000000000000' AS low, md5(text)[1:1] || 'fffffff-ffff-ffff-ffff-ffffffffffff' AS high, count(*) AS documents
 FROM documents WHERE text IS NOT NULL GROUP BY ALL""")
def _(spark, sf):
    """How many documents lie in each of sixteen ranges of identifiers that follow from their texts."""
    digest = F.md5(F.col("text").cast("binary"))
    key = F.concat_ws("-", *[F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    rows = table(spark, sf, "documents").where("text is not null").select(key.alias("id"))
    bounds = F.array(*[F.struct(F.lit(str(a)).alias("low"), F.lit(str(b)).alias("high")) for a, b in tables.uuid_ranges(16)])
    mine = F.filter(bounds, lambda r: F.col("id").between(r["low"], r["high"]))[0]
    return rows.select(mine.alias("r")).groupBy("r.low", "r.high").agg(F.count(F.lit(1)).alias("documents"))


@add("staged_rows", """SELECT o_orderkey AS id, o_orderstatus AS status, false AS moved FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
 UNION ALL SELECT l_orderkey, l_linestatus, true FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_linestatus DESC) AS r FROM lineitem) WHERE r = 1""")
def _(spark, sf):
    base = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.lit("2024-01-01").cast("timestamp").alias("last_updated_date"))
    # the order of insertion has to be unique for the result to be
    staging = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("inserted_at")).agg(F.max("l_linestatus").alias("status"))
    return reindex.staged(base, staging, ["id"]).select("id", "status", (F.year("last_updated_date") < 2024).alias("moved"))


@add("soft_deleted", "SELECT s_suppkey AS id, s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R') AS is_deleted FROM supplier")
def _(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.lit(False).alias("is_deleted"))
    return tables.soft_deleted(s, table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("id")), "id")


@add("events_accepted", "SELECT event_id FROM events WHERE event_type <> 'click' AND NOT (event_type = 'error' AND user_id % 2 = 0)")
def _(spark, sf):
    kind = F.when(F.col("event_type") == "click", "DELETE_ALL").when(F.col("event_type") == "error", "DELETE").otherwise("UPDATE")
    e = table(spark, sf, "events").select("event_id", kind.alias("type"), F.when(F.col("user_id") % 2 == 0, "authority").otherwise("instance").alias("resource"), F.lit("HARD_DELETE").alias("deleteEventSubType"))
    return events.accepted(e).select("event_id")


@add("events_own", "SELECT event_id FROM events WHERE user_id % 3 <> 0")
def _(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.when(F.col("user_id") % 3 == 0, "CONSORTIUM-MARC").when(F.col("user_id") % 3 == 1, "MARC").alias("source"))
    return events.own(e).select("event_id")


@add("record_batches", "SELECT event_id, user_id FROM events")
def _(spark, sf):
    e = table(spark, sf, "events").groupBy("user_id").agg(F.to_json(F.collect_list(F.struct("event_id", "user_id"))).alias("value"))
    return events.record_batches(e, "struct<event_id:long,user_id:long>")
