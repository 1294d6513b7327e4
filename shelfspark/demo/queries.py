"""Queries over the star-schema tables with the SQL that each has to equal: name -> (DataFrame function, DuckDB SQL)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cql.bind import bind
from ..functions import identifiers, records
from ..functions.shelving import shelving_key
from ..operators import browse as B
from ..operators import consortium, facets, ids, lookups, search, tables
from ..plans import children, documents, index
from ..sources import events
from ..streaming import pipeline
from . import headings, more, nested, spoken, stored  # noqa: F401  register their queries
from .catalog import DOCUMENTS, ORDERS, PARTS, instances, items, parts, table
from .registry import DOC_SQL, FOLD_SQL, FOUND, INSTANCE_SQL, ITEM_SQL, PART_SQL, add, has


def on_parts(name: str, cql: str, where: str) -> None:
    """All parts that match, by key."""
    FOUND[name] = (lambda spark, sf: search.matched(parts(spark, sf), cql, PARTS).select("p_partkey", "p_brand"), f"SELECT p_partkey, p_brand FROM {PART_SQL} WHERE {where}")


def on_documents(name: str, cql: str, where: str) -> None:
    FOUND[name] = (lambda spark, sf: search.matched(table(spark, sf, "documents"), cql, DOCUMENTS).select("doc_id", "lang"), f"SELECT doc_id, lang FROM {DOC_SQL} WHERE {where}")


# terms
on_parts("cql_eq_term", "p_type = ECONOMY", "p_type = 'ECONOMY'")
on_parts("cql_exact_term", 'p_brand == "Brand#17"', "p_brand = 'Brand#17'")
on_parts("cql_normalised_term", 'brand_lower == "BRAND#17"', "lower(p_brand) = 'brand#17'")
on_parts("cql_in_terms", "p_type == (ECONOMY or SMALL)", "p_type IN ('ECONOMY', 'SMALL')")
on_parts("cql_ne_term", "note <> ECONOMY", "coalesce(note, '') <> 'ECONOMY'")
on_parts("cql_lt", "p_size < 7", "p_size < 7")
on_parts("cql_lte", "p_size <= 7", "p_size <= 7")
on_parts("cql_gt", "p_retailprice > 950.5", "p_retailprice > 950.5")
on_parts("cql_gte", "p_size >= 45", "p_size >= 45")
on_parts("cql_range_pair", "p_size >= 10 and p_size <= 12", "p_size BETWEEN 10 AND 12")
on_parts("cql_wildcard_prefix", "p_brand == Brand#1*", "p_brand LIKE 'Brand#1%'")
on_parts("cql_wildcard_infix", "p_name = *d*bolt*", "lower(p_name) LIKE '%d%bolt%'")
on_parts("cql_exists", 'note = ""', "note IS NOT NULL")
on_parts("cql_not_exists", 'cql.allRecords=1 not note = ""', "note IS NULL")
on_parts("cql_absent", "note == []", "note IS NULL")
on_parts("cql_array_term", "tags == red", "list_contains(tags, 'red')")
on_parts("cql_alias_term", 'labels = "SMALL"', "p_brand = 'SMALL' OR p_type = 'SMALL'")
on_parts("cql_match_all", "cql.allRecords=1", "true")
on_parts("cql_keyword_star", "keyword = *", "true")
on_parts("cql_and_or_not", "(p_type = ECONOMY or p_size < 5) and p_retailprice > 910 not p_name = red", "(p_type = 'ECONOMY' OR p_size < 5) AND p_retailprice > 910 AND NOT list_contains(string_split(lower(p_name), ' '), 'red')")
on_parts("cql_distributed_or", "p_brand == (Brand#3 or Brand#4) and p_size > 20", "p_brand IN ('Brand#3', 'Brand#4') AND p_size > 20")
on_parts("cql_left_to_right", "p_size = 1 or p_size = 2 and p_type = ECONOMY", "(p_size = 1 OR p_size = 2) AND p_type = 'ECONOMY'")
FOUND["cql_date_range"] = (
    lambda spark, sf: search.matched(table(spark, sf, "orders"), 'o_orderdate >= "1997-01-01" and o_orderdate < "1997-02-01T00:00:00"', ORDERS).select("o_orderkey", "o_orderstatus"),
    "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1997-02-01'",
)

# texts
on_documents("text_all", 'text all "the with"', f"{has('the')} AND {has('with')}")
on_documents("text_any", 'text any "pour nicht"', f"{has('pour')} OR {has('nicht')}")
on_documents("text_adj", 'text adj "of the"', f"{has('of')} AND {has('the')}")
on_documents("text_eq_cross_field", 'keyword = "the with"', f"({has('the')} AND {has('with')}) OR lang = 'the with'")
on_documents("text_phrase", 'text == "of the"', "contains(' ' || array_to_string(list_filter(base, lambda x: x <> ''), ' ') || ' ', ' of the ')")
on_documents("text_ne", 'text <> "the with"', f"NOT ({has('the')} AND {has('with')})")
on_documents("text_folded", "text = ETRE", has("etre"))
on_documents("text_alias_any", 'cql.all any "fr der"', f"{has('fr')} OR {has('der')} OR lang = 'fr der' OR source = 'fr der'")
on_parts("text_exact_string", 'title ==/string "RED Widget"', "lower(p_name) = 'red widget'")


@add("text_prepared_index", f"SELECT doc_id, lang FROM {DOC_SQL} WHERE {has('the')} AND {has('with')}")
def _(spark, sf):
    return search.matched(index.prepared(table(spark, sf, "documents"), DOCUMENTS), 'text all "the with"', DOCUMENTS).select("doc_id", "lang")


@add("text_all_values", "SELECT p_partkey, array_to_string(list_sort([p_name, p_brand, p_type]), '|') AS all_values FROM part")
def _(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", F.array_join(F.array_sort(records.all_values(p.schema)()), "|").alias("all_values"))


# sorting and paging
def on_sorted(name: str, cql: str, sql: str, limit: int = 20, offset: int = 0) -> None:
    FOUND[name] = (lambda spark, sf: search.search(parts(spark, sf), cql, PARTS, limit, offset, expand_all=True).select("p_partkey", "p_size", "p_retailprice"), f"SELECT p_partkey, p_size, p_retailprice FROM {PART_SQL} {sql} LIMIT {limit} OFFSET {offset}")


on_sorted("sort_single_desc", "p_type == ECONOMY and p_size >= 10 sortBy p_retailprice/sort.descending", "WHERE p_type = 'ECONOMY' AND p_size >= 10 ORDER BY p_retailprice DESC, p_partkey")
on_sorted("sort_secondary", "p_size < 30 sortBy p_type", "WHERE p_size < 30 ORDER BY p_type, p_brand, p_partkey")
on_sorted("sort_collection_min", "p_size > 3 sortBy sizes", "WHERE p_size > 3 ORDER BY list_min(sizes), p_partkey")
on_sorted("sort_collection_max", "p_size > 3 sortBy sizes/sort.descending", "WHERE p_size > 3 ORDER BY list_max(sizes) DESC, p_partkey")
on_sorted("page_offset_limit", "cql.allRecords=1 sortBy p_size p_retailprice", "ORDER BY p_size, p_retailprice, p_partkey", 50, 500)


@add("search_projection", "SELECT p_partkey, p_name, p_brand FROM part WHERE p_size = 7 ORDER BY p_partkey LIMIT 10")
def _(spark, sf):
    shown = PARTS.__class__("parts", tuple(f.__class__(**{**f.__dict__, "shown": f.path in ("p_name",)}) for f in PARTS.fields), PARTS.aliases, key="p_partkey")
    return search.search(parts(spark, sf), "p_size = 7", shown, 10, include=["p_brand", "nothing"])


@add("scan_keyset", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders WHERE (o_custkey, o_orderkey) > (100, 500) ORDER BY o_custkey, o_orderkey LIMIT 100")
def _(spark, sf):
    return tables.after(table(spark, sf, "orders"), ["o_custkey", "o_orderkey"], [100, 500], 100).select("o_custkey", "o_orderkey", "o_totalprice")


@add("scan_range", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey BETWEEN 1000 AND 1100")
def _(spark, sf):
    return tables.between(table(spark, sf, "orders"), "o_orderkey", 1000, 1100).select("o_orderkey", "o_custkey")


# facets
def on_facets(name: str, cql: str, specs: list[str], sql: str) -> None:
    FOUND[name] = (lambda spark, sf: facets.facets(parts(spark, sf), cql, specs, PARTS), sql)


on_facets("facet_terms", "p_size > 10", ["p_type"], "SELECT 'p_type' AS facet, p_type AS id, count(*) AS total_records, false AS selected FROM part WHERE p_size > 10 GROUP BY p_type")
on_facets("facet_sized", "p_size > 10", ["p_brand:5"], "SELECT 'p_brand' AS facet, p_brand AS id, count(*) AS total_records, false AS selected FROM part WHERE p_size > 10 GROUP BY p_brand ORDER BY 3 DESC, 2 LIMIT 5")
on_facets("facet_excludes_own_filter", 'p_name = red and p_type == ECONOMY and p_brand == "Brand#3"', ["p_type"], "SELECT 'p_type' AS facet, p_type AS id, count(*) AS total_records, p_type = 'ECONOMY' AS selected FROM part WHERE list_contains(string_split(p_name, ' '), 'red') AND p_brand = 'Brand#3' GROUP BY p_type")
on_facets("facet_selected_first", 'p_brand == ("Brand#3" or "Brand#9")', ["p_brand:4"], "SELECT 'p_brand' AS facet, p_brand AS id, count(*) AS total_records, p_brand IN ('Brand#3', 'Brand#9') AS selected FROM part GROUP BY p_brand ORDER BY 4 DESC, 3 DESC, 2 LIMIT 4")
on_facets("facet_only_selected", 'p_brand == ("Brand#3" or "Brand#9")', ["p_brand:1"], "SELECT 'p_brand' AS facet, p_brand AS id, count(*) AS total_records, true AS selected FROM part WHERE p_brand IN ('Brand#3', 'Brand#9') GROUP BY p_brand ORDER BY 3 DESC, 2 LIMIT 1")
on_facets(
    "facet_multi",
    "p_retailprice > 950 and p_type == ECONOMY and p_size == (1 or 2 or 3)",
    ["p_type", "p_brand", "p_size"],
    """SELECT 'p_type' AS facet, p_type AS id, count(*) AS total_records, p_type = 'ECONOMY' AS selected FROM part WHERE p_retailprice > 950 AND p_size IN (1, 2, 3) GROUP BY p_type
 UNION ALL SELECT 'p_brand', p_brand, count(*), false FROM part WHERE p_retailprice > 950 AND p_size IN (1, 2, 3) AND p_type = 'ECONOMY' GROUP BY p_brand
 UNION ALL SELECT 'p_size', p_size::VARCHAR, count(*), p_size IN (1, 2, 3) FROM part WHERE p_retailprice > 950 AND p_type = 'ECONOMY' GROUP BY p_size""",
)
on_facets("facet_array_field", "p_size < 20", ["tags"], f"SELECT 'tags' AS facet, id, count(*) AS total_records, false AS selected FROM (SELECT unnest(list_distinct(tags)) AS id FROM {PART_SQL} WHERE p_size < 20) GROUP BY id")


# browsing: parts by shelf mark
def on_shelf(name: str, cql: str, limit: int, preceding: int | None, sql: str) -> None:
    def run(spark, sf):
        ctx = B.context(cql, PARTS, "shelf", limit, preceding)
        rows = parts(spark, sf).select("p_partkey", "shelf", "p_type", "p_size")
        return B.browse(rows, ctx, B.Order(("shelf", "p_partkey"), "shelf"), PARTS).select("p_partkey", "shelf", "is_anchor", "position", "prev", "next")

    FOUND[name] = (run, sql)


def one_side(op: str, anchor: str, limit: int, where: str = "true") -> str:
    """A page on one side in SQL; going back, the last rows in order."""
    forward = op[0] == ">"
    order = "shelf, p_partkey" if forward else "shelf DESC, p_partkey DESC"
    return f"""WITH h AS (SELECT p_partkey, shelf, shelf = '{anchor}' AS is_anchor FROM {PART_SQL} WHERE shelf {op} '{anchor}' AND {where}),
 m AS (SELECT *, row_number() OVER (ORDER BY {order}) AS r, count(*) OVER () AS n FROM h),
 p AS (SELECT * FROM m WHERE r <= {limit})
 SELECT p_partkey, shelf, is_anchor, row_number() OVER (ORDER BY shelf, p_partkey) - 1 AS position,
 {"first(shelf) OVER w" if forward else f"CASE WHEN n > {limit} THEN first(shelf) OVER w END"} AS prev,
 {f"CASE WHEN n > {limit} THEN last(shelf) OVER w END" if forward else "last(shelf) OVER w"} AS next
 FROM p WINDOW w AS (ORDER BY shelf, p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"""


def both_sides(anchor: str, before: int, behind: int, included: bool) -> str:
    hits = f"SELECT p_partkey, shelf, true AS is_anchor FROM {PART_SQL} WHERE shelf = '{anchor}'"
    hole = f"SELECT NULL::BIGINT AS p_partkey, '{anchor}' AS shelf, true AS is_anchor"
    mid = f"SELECT * FROM ({hits}) UNION ALL SELECT * FROM ({hole}) WHERE NOT EXISTS ({hits})" if included else hole
    return f"""WITH b AS (SELECT p_partkey, shelf, false AS is_anchor FROM {PART_SQL} WHERE shelf < '{anchor}' ORDER BY shelf DESC, p_partkey DESC LIMIT {before}),
 f AS (SELECT * FROM ({mid}) UNION ALL SELECT * FROM (SELECT p_partkey, shelf, false AS is_anchor FROM {PART_SQL} WHERE shelf > '{anchor}')),
 g AS (SELECT * FROM f ORDER BY shelf, p_partkey NULLS LAST LIMIT {behind}),
 p AS (SELECT * FROM b UNION ALL SELECT * FROM g)
 SELECT p_partkey, shelf, is_anchor, row_number() OVER w - 1 AS position,
 CASE WHEN (SELECT count(*) FROM {PART_SQL} WHERE shelf < '{anchor}') > {before} THEN first(shelf) OVER v END AS prev,
 CASE WHEN (SELECT count(*) FROM f) > {behind} THEN last(shelf) OVER v END AS next
 FROM p WINDOW w AS (ORDER BY shelf, p_partkey NULLS LAST), v AS (ORDER BY shelf, p_partkey NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"""


A1 = "Brand 11 .24:1"
on_shelf("browse_forward", f'shelf > "{A1}"', 10, None, one_side(">", A1, 10))
on_shelf("browse_forward_incl", 'shelf >= "Brand 12"', 10, None, one_side(">=", "Brand 12", 10))
on_shelf("browse_backward", f'shelf < "{A1}"', 10, None, one_side("<", A1, 10))
on_shelf("browse_backward_start", 'shelf < "Brand 1 .2"', 100, None, one_side("<", "Brand 1 .2", 100))
on_shelf("browse_around", f'shelf < "{A1}" or shelf > "{A1}"', 10, 4, both_sides(A1, 4, 6, False))
on_shelf("browse_around_incl", 'shelf < "Brand 17 .28:1" or shelf >= "Brand 17 .28:1"', 11, None, both_sides("Brand 17 .28:1", 5, 6, True))
on_shelf("browse_placeholder", 'shelf < "Brand 2 .zz" or shelf >= "Brand 2 .zz"', 8, 3, both_sides("Brand 2 .zz", 3, 5, True))
on_shelf("browse_filtered", 'shelf >= "Brand 2" and p_type == SMALL', 10, None, one_side(">=", "Brand 2", 10, "p_type = 'SMALL'"))

SUDOC_SQL = r"""array_to_string(list_transform(t, lambda x, i:
 CASE WHEN x = '.' THEN '01' WHEN x = ':' THEN '02' WHEN x = '-' THEN '03' WHEN x = '/' THEN '04'
 WHEN regexp_matches(x, '^[A-Za-z]') THEN '1' || upper(x)
 ELSE (CASE WHEN coalesce(list_position(t, ':'), 0) > 0 AND i > list_position(t, ':') AND length(x) BETWEEN 3 AND 4 THEN '2' ELSE '3' END)
 || length(regexp_replace(x, '^0+([0-9])', '\1')) || regexp_replace(x, '^0+([0-9])', '\1') END), ' ')"""


@add("shelving_sudoc", f"SELECT p_partkey, {SUDOC_SQL} AS shelving_order FROM (SELECT p_partkey, regexp_extract_all(shelf, '([A-Za-z]+|[0-9]+|[:/.-])', 1) AS t FROM {PART_SQL})")
def _(spark, sf):
    return parts(spark, sf).select("p_partkey", shelving_key(F.col("shelf"), "SUDOC").alias("shelving_order"))


@add("browse_shelving_sudoc", f"SELECT p_partkey, shelf FROM (SELECT p_partkey, shelf, lower({SUDOC_SQL}) AS k FROM (SELECT p_partkey, shelf, regexp_extract_all(shelf, '([A-Za-z]+|[0-9]+|[:/.-])', 1) AS t FROM {PART_SQL})) WHERE k >= '1brand 3211' ORDER BY k, p_partkey LIMIT 15")
def _(spark, sf):
    rows = B.shelved(parts(spark, sf).select("p_partkey", "shelf"), "shelf", B.Configs().get("instance-call-number", "sudoc")[0])
    return B.browse(rows, B.Context("1brand 3211", 0, 15, True), B.Order(("shelving_order", "p_partkey"), "shelf"), PARTS).select("p_partkey", "shelf")


@add("browse_shelving_default", f"SELECT p_partkey, shelf FROM {PART_SQL} WHERE lower(trim(shelf)) > 'brand 21' ORDER BY lower(trim(shelf)), p_partkey LIMIT 15")
def _(spark, sf):
    rows = B.shelved(parts(spark, sf).select("p_partkey", "shelf"), "shelf", "DEFAULT")
    return B.browse(rows, B.Context("Brand 21", 0, 15, False), B.Order(("shelving_order", "p_partkey"), "shelf"), PARTS, anchor_key="brand 21").select("p_partkey", "shelf")


@add("browse_shelving_lc", r"""SELECT p_partkey, CASE WHEN regexp_matches(k, '^[A-Z]{1,3}\s*[0-9]+') THEN regexp_extract(k, '^([A-Z]{1,3})', 1) || ' ' || length(d) || d || ' ' || 'C' || (p_size) || ' ' || '41998' END AS shelving_order
 FROM (SELECT p_partkey, p_size, 'QA' || p_size || ' .C' || p_size || ' 1998' AS k, p_size::VARCHAR AS d FROM part)""")
def _(spark, sf):
    mark = F.concat(F.lit("qa"), F.col("p_size").cast("string"), F.lit(" .c"), F.col("p_size").cast("string"), F.lit(" 1998"))
    return table(spark, sf, "part").select("p_partkey", shelving_key(mark, "LC").alias("shelving_order"))


@add("browse_type_config", f"SELECT p_partkey, shelf FROM {PART_SQL} WHERE p_type IN ('SMALL', 'ECONOMY') AND shelf >= 'Brand 3' ORDER BY shelf, p_partkey LIMIT 10")
def _(spark, sf):
    configs = B.Configs()
    configs.put("instance-call-number", "other", "DEFAULT", ("SMALL", "ECONOMY"))
    wanted = " or ".join(configs.get("instance-call-number", "other")[1])
    ctx = B.context(f'shelf >= "Brand 3" and p_type == ({wanted})', PARTS, "shelf", 10)
    return B.browse(parts(spark, sf), ctx, B.Order(("shelf", "p_partkey"), "shelf"), PARTS).select("p_partkey", "shelf")


HEADINGS = [("c_name", "personalName", "Authorized"), ("c_mktsegment", "topicalTerm", "Reference"), ("nation", "geographicName", "Auth/Ref")]
HEADING_SQL = """(SELECT unnest(['c_name0_', 'c_mktsegment0_', 'nation0_']) || c_custkey AS document_id, c_custkey::VARCHAR AS id, unnest(['personalName', 'topicalTerm', 'geographicName']) AS heading_type,
 unnest(['Authorized', 'Reference', 'Auth/Ref']) AS auth_ref_type, unnest([c_name, c_mktsegment, n_name]) AS heading_ref FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


def _authorities(spark, sf):
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return documents.authority_headings(c.select(F.col("c_custkey").cast("string").alias("id"), "c_name", "c_mktsegment", F.col("n_name").alias("nation")), HEADINGS)


@add("authority_explode", f"SELECT document_id, id, heading_type, auth_ref_type, heading_ref FROM {HEADING_SQL}")
def _(spark, sf):
    return _authorities(spark, sf).select("document_id", "id", "heading_type", "auth_ref_type", "heading_ref")


@add("browse_authority", f"SELECT document_id, heading_ref FROM {HEADING_SQL} WHERE auth_ref_type IN ('Authorized', 'Reference') AND heading_ref >= 'C' ORDER BY heading_ref, document_id LIMIT 12")
def _(spark, sf):
    rows = _authorities(spark, sf).where(F.col("auth_ref_type").isin("Authorized", "Reference"))
    return B.browse(rows, B.Context("C", 0, 12, True), B.Order(("heading_ref", "document_id"), "heading_ref"), PARTS).select("document_id", "heading_ref")


@add("browse_contributor_nulls_last", f"SELECT p_partkey, p_brand, note FROM {PART_SQL} WHERE p_brand >= 'Brand#24' ORDER BY p_brand, note NULLS LAST, p_partkey LIMIT 60")
def _(spark, sf):
    rows = parts(spark, sf).select("p_partkey", "p_brand", "note")
    return B.browse(rows, B.Context("Brand#24", 0, 60, True), B.Order(("p_brand", "note", "p_partkey"), "p_brand"), PARTS).select("p_partkey", "p_brand", "note")


# children and documents
@add("child_subjects", f"""SELECT value, type_id, tenant_id, shared, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS value, p_type AS type_id, tenant_id, shared FROM {INSTANCE_SQL}) GROUP BY ALL""")
def _(spark, sf):
    entities, relations = children.subjects(instances(spark, sf))
    rows = children.counted(relations, "subject_id", entities)
    return rows.select("value", "type_id", F.explode("instances").alias("i")).select("value", "type_id", "i.tenant_id", "i.shared", F.col("i.count").alias("n"))


@add("child_subject_ids", "SELECT DISTINCT sha1(w || '||s1|' || p_type) AS id, w AS value FROM (SELECT unnest(string_split(p_name, ' ')) AS w, p_type FROM part)")
def _(spark, sf):
    return children.subjects(instances(spark, sf))[0].select("id", "value")


@add("child_classifications", f"SELECT number, tenant_id, shared, count(*) AS n FROM (SELECT p_brand || ' ' || p_type AS number, tenant_id, shared FROM {INSTANCE_SQL}) GROUP BY ALL")
def _(spark, sf):
    entities, relations = children.classifications(instances(spark, sf))
    return children.counted(relations, "classification_id", entities).select("number", F.explode("instances").alias("i")).select("number", "i.tenant_id", "i.shared", F.col("i.count").alias("n"))


@add("child_contributors", f"""SELECT p_brand AS name, tenant_id, shared, count(DISTINCT id) AS n, coalesce(array_to_string(list_sort(list(DISTINCT p_type) FILTER (p_size > 25)), ','), '') AS types FROM {INSTANCE_SQL} GROUP BY ALL""")
def _(spark, sf):
    entities, relations = children.contributors(instances(spark, sf))
    rows = children.counted(relations, "contributor_id", entities, distinct_instances=True, types="type_id")
    return rows.select("name", F.explode("instances").alias("i")).select("name", "i.tenant_id", "i.shared", F.col("i.count").alias("n"), F.array_join("i.type_ids", ",").alias("types"))


@add("child_call_numbers", f"""SELECT call_number, prefix, suffix, i.tenant_id, p.shared, location_id, count(DISTINCT instance_id) AS n, min(instance_id) AS least
 FROM {ITEM_SQL} i JOIN {INSTANCE_SQL} p ON i.instance_id = p.id GROUP BY ALL""")
def _(spark, sf):
    entities, relations = children.call_numbers(items(spark, sf))
    rows = children.located(relations, instances(spark, sf), entities)
    x = rows.select("call_number", "prefix", "suffix", F.explode("instances").alias("i"))
    return x.select("call_number", "prefix", "suffix", "i.tenant_id", "i.shared", "i.location_id", F.size("i.instance_ids").cast("long").alias("n"), F.array_min("i.instance_ids").alias("least"))


@add("browse_count_subjects", "SELECT value, type_id, count(*) AS total FROM (SELECT unnest(string_split(p_name, ' ')) AS value, p_type AS type_id FROM part) GROUP BY ALL")
def _(spark, sf):
    entities, relations = children.subjects(instances(spark, sf))
    return children.counted(relations, "subject_id", entities).select("value", "type_id", children.total_count().alias("total"))


@add("browse_count_call_numbers", f"SELECT call_number, prefix, suffix, count(DISTINCT instance_id) AS total FROM {ITEM_SQL} JOIN part ON instance_id = p_partkey::VARCHAR GROUP BY ALL")
def _(spark, sf):
    entities, relations = children.call_numbers(items(spark, sf))
    return children.located(relations, instances(spark, sf), entities).where("instances is not null").select("call_number", "prefix", "suffix", children.distinct_instances().alias("total"))


@add("assemble_documents", f"""SELECT p.id, coalesce(h.n, 0) AS holdings, coalesce(i.n, 0) AS items, coalesce(i.l, '') AS first_item FROM {INSTANCE_SQL} p
 LEFT JOIN (SELECT l_partkey::VARCHAR AS id, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1) h ON p.id = h.id
 LEFT JOIN (SELECT instance_id AS id, count(*) AS n, min(id) AS l FROM {ITEM_SQL} GROUP BY 1) i ON p.id = i.id""")
def _(spark, sf):
    it = items(spark, sf)
    holdings = it.select("instance_id", F.split("id", "-")[0].alias("id")).distinct()
    docs = documents.assembled(instances(spark, sf), holdings, it.select("instance_id", "id", "tenant_id"))
    return docs.select("id", F.size("holdings").cast("long").alias("holdings"), F.size("items").cast("long").alias("items"), F.coalesce(F.get("items", F.lit(0))["id"], F.lit("")).alias("first_item"))


@add("number_of_titles", """SELECT s.s_suppkey AS id, count(DISTINCT l_partkey) AS number_of_titles FROM supplier s LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1""")
def _(spark, sf):
    titles = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.collect_set("l_suppkey").alias("authority_ids"))
    authorities = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("Authorized").alias("auth_ref_type"))
    return lookups.number_of_titles(authorities, titles, F.col("authority_ids")).select("id", "number_of_titles")


@add("single_instance_title", f"""SELECT c.call_number, c.k, p_name AS instance_title FROM (SELECT call_number, location_id || prefix || suffix AS k, count(DISTINCT instance_id) AS n, min(instance_id) AS one FROM {ITEM_SQL} GROUP BY ALL) c LEFT JOIN part ON c.n = 1 AND p_partkey::VARCHAR = c.one""")
def _(spark, sf):
    rows = items(spark, sf).groupBy("call_number", F.concat("location_id", "prefix", "suffix").alias("k")).agg(F.collect_set("instance_id").alias("instance_ids"))
    return lookups.single_titles(rows, instances(spark, sf)).select("call_number", "k", "instance_title")


@add("subject_counts", "SELECT subject, count(*) AS count FROM (SELECT DISTINCT p_partkey, unnest(string_split(lower(p_name), ' ')) AS subject FROM part) WHERE subject IN ('red', 'bolt') GROUP BY 1")
def _(spark, sf):
    return lookups.subject_counts(table(spark, sf, "part").select(F.col("p_partkey").alias("id"), "p_name"), F.split("p_name", " "), ["RED", "bolt"])


# scalar functions
# a third of the parts each: thirteen digits, ten digits or nine and X, thirteen digits with a remark behind
@add("fn_isbn", """SELECT p_partkey, '97' || (8 + p_partkey % 2) || lpad((p_partkey % 10000)::VARCHAR, 10, '0') AS isbn, CASE WHEN p_partkey % 3 = 2 THEN '(pbk.)' END AS second FROM part WHERE p_partkey % 3 <> 1
 UNION ALL SELECT p_partkey, d || CASE WHEN chk < 10 THEN chk::VARCHAR ELSE '-x' END, CASE WHEN chk < 10 THEN '978' || d || ((10 - s13 % 10) % 10) END FROM (SELECT *, (11 - s % 11) % 11 AS chk, 38 + 3 * (x1 + x3 + x5 + x7 + x9) + x2 + x4 + x6 + x8 AS s13 FROM (
 SELECT *, 10 * x1 + 9 * x2 + 8 * x3 + 7 * x4 + 6 * x5 + 5 * x6 + 4 * x7 + 3 * x8 + 2 * x9 AS s FROM (
 SELECT p_partkey, d, d[1]::INT AS x1, d[2]::INT AS x2, d[3]::INT AS x3, d[4]::INT AS x4, d[5]::INT AS x5, d[6]::INT AS x6, d[7]::INT AS x7, d[8]::INT AS x8, d[9]::INT AS x9 FROM (SELECT p_partkey, lpad((p_partkey * 7919)::VARCHAR, 9, '0') AS d FROM part WHERE p_partkey % 3 = 1))))""")
def _(spark, sf):
    k = F.col("p_partkey")
    nine = F.lpad((k * 7919).cast("string"), 9, "0")
    total = sum((F.substring(nine, i + 1, 1).cast("int") * (10 - i) for i in range(9)), F.lit(0))
    check = (F.lit(11) - total % 11) % 11
    thirteen = F.concat(F.lit("97"), (F.lit(8) + k % 2).cast("string"), F.lpad((k % 10000).cast("string"), 10, "0"))
    ten = F.concat(F.substring(nine, 1, 1), F.lit("-"), F.substring(nine, 2, 4), F.lit(" "), F.substring(nine, 6, 4), F.lit("-"), F.when(check < 10, check.cast("string")).otherwise("X"))
    raw = F.when(k % 3 == 0, thirteen).when(k % 3 == 1, ten).otherwise(F.concat(thirteen, F.lit(" (PBK.)")))
    x = table(spark, sf, "part").select("p_partkey", identifiers.isbn(raw).alias("v"))
    return x.select("p_partkey", F.get("v", F.lit(0)).alias("isbn"), F.get("v", F.lit(1)).alias("second"))


@add("fn_oclc", "SELECT p_partkey, CASE WHEN p_partkey = 0 THEN NULL ELSE p_partkey || '-' || p_size END AS oclc FROM part WHERE p_partkey > 0")
def _(spark, sf):
    p = table(spark, sf, "part").where("p_partkey > 0")
    return p.select("p_partkey", identifiers.oclc(F.concat(F.lit(" (OCoLC)ocm00"), F.col("p_partkey").cast("string"), F.lit("  "), F.col("p_size").cast("string"))).alias("oclc"))


@add("fn_lccn", "SELECT p_partkey, lower(replace(p_name || p_brand, ' ', '')) AS lccn FROM part")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", identifiers.no_space(F.concat(F.upper("p_name"), F.lit(" \t"), F.col("p_brand"))).alias("lccn"))


@add("fn_date1", "SELECT p_partkey, CASE WHEN length(d) > 4 OR d = '' THEN 0 ELSE regexp_replace(d, '[^0-9]', '0', 'g')::SMALLINT END::SMALLINT AS date1 FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '19u' || p_size WHEN 1 THEN '' WHEN 2 THEN '19' || p_partkey ELSE p_size || 'u' END AS d FROM part)")
def _(spark, sf):
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    d = F.when(k % 4 == 0, F.concat(F.lit("19u"), size)).when(k % 4 == 1, "").when(k % 4 == 2, F.concat(F.lit("19"), k.cast("string"))).otherwise(F.concat(size, F.lit("u")))
    return table(spark, sf, "part").select("p_partkey", records.date1(d).alias("date1"))


@add("fn_callnumber_full", "SELECT p_partkey, concat_ws(' ', nullif(trim(CASE WHEN p_size > 20 THEN ' ' || p_type ELSE ' ' END), ''), p_brand, CASE WHEN p_partkey % 2 = 0 THEN p_name END) AS full FROM part")
def _(spark, sf):
    prefix = F.when(F.col("p_size") > 20, F.concat(F.lit(" "), "p_type")).otherwise(F.lit(" "))
    return table(spark, sf, "part").select("p_partkey", records.full_call_number(prefix, F.col("p_brand"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_name"))).alias("full"))


@add("fn_callnumber_normalized", "SELECT p_partkey, regexp_replace(lower(p_type || p_brand || p_name), '[^a-z0-9]', '', 'g') AS with_prefix, regexp_replace(lower(p_brand || p_name), '[^a-z0-9]', '', 'g') AS without FROM part")
def _(spark, sf):
    v = records.call_number_variants(F.col("p_type"), F.col("p_brand"), F.col("p_name"))
    return table(spark, sf, "part").select("p_partkey", F.get(v, F.lit(0)).alias("with_prefix"), F.get(v, F.lit(1)).alias("without"))


@add("fn_sha_id", "SELECT p_partkey, sha1(p_name || '|' || coalesce(CASE WHEN p_size > 10 THEN p_type END, '') || '|' || p_brand) AS id FROM part")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", records.sha_id(F.col("p_name"), F.when(F.col("p_size") > 10, F.col("p_type")), F.col("p_brand")).alias("id"))


@add("fn_classification_norm", "SELECT p_partkey, nullif(regexp_replace(p_brand || '-' || p_type, '[^a-zA-Z0-9]', '', 'g'), '') AS number FROM part")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", records.classification_number(F.concat_ws("-", "p_brand", "p_type")).alias("number"))


@add("fn_public_notes", "SELECT conv_id, count(*) FILTER (role = 'user') AS n, coalesce(min(text) FILTER (role = 'user'), '') AS least FROM conversations GROUP BY conv_id")
def _(spark, sf):
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct(F.col("text").alias("note"), F.when(F.col("role") != "user", True).alias("staffOnly"))).alias("notes"))
    v = records.public_notes(F.col("notes"))
    return c.select("conv_id", F.size(v).cast("long").alias("n"), F.coalesce(F.array_min(v), F.lit("")).alias("least"))


@add("fn_json_extract", "SELECT event_id, props->>'$.k' AS k FROM events")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", documents.json_text(F.col("props"), "k").alias("k"))


@add("fn_folding", f"SELECT doc_id, sha1({FOLD_SQL}) AS folded FROM documents")
def _(spark, sf):
    from .. import analysis

    return table(spark, sf, "documents").select("doc_id", F.sha1(analysis.fold(F.col("text")).cast("binary")).alias("folded"))


@add("fn_sort_title", "SELECT p_partkey, coalesce(CASE WHEN p_size % 2 = 0 THEN p_name END, p_brand) AS sort_title FROM part")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", records.sort_title(F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise(F.lit("  ")), F.col("p_brand")).alias("sort_title"))


@add("page_numbers", "SELECT o_orderkey, ceil(o_orderkey / 7.0)::BIGINT AS page, ceil(o_custkey / 7.0)::BIGINT AS total_pages FROM orders")
def _(spark, sf):
    rows = table(spark, sf, "orders").withColumn("instances", F.array("o_orderstatus"))
    return documents.page_of(rows, F.col("o_orderkey"), 7, F.col("o_custkey")).select("o_orderkey", F.col("page_number").alias("page"), "total_pages")


# sets and upserts
@add("union_local_shared", "SELECT id FROM (SELECT p_partkey AS id, p_partkey % 4 AS t, p_partkey % 5 = 0 AS shared FROM part) WHERE t = 1 UNION ALL SELECT p_partkey FROM part WHERE p_partkey % 5 = 0 AND p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_suppkey % 4 = 1)")
def _(spark, sf):
    from ..plans import reindex

    i = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("t"), (F.col("p_partkey") % 4).cast("string")).alias("tenant_id"), (F.col("p_partkey") % 5 == 0).alias("shared"))
    h = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("instance_id"), F.concat(F.lit("t"), (F.col("l_suppkey") % 4).cast("string")).alias("tenant_id"))
    return reindex.member_documents(i, i, h, "t1").select("id")


# whole tables: all orders are old rows, and new ones have twice the key of each line, so that half of them are new
@add("insert_ignore", "SELECT o_orderkey, o_custkey FROM orders UNION ALL SELECT DISTINCT 2 * l_orderkey, -1 FROM lineitem WHERE 2 * l_orderkey NOT IN (SELECT o_orderkey FROM orders)")
def _(spark, sf):
    return tables.insert_ignore(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), _doubled(spark, sf), ["o_orderkey"])


@add("upsert_replace", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT 2 * l_orderkey FROM lineitem) UNION ALL SELECT DISTINCT 2 * l_orderkey, -1 FROM lineitem")
def _(spark, sf):
    return tables.upsert(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), _doubled(spark, sf).distinct(), ["o_orderkey"])


@add("update_diff", "SELECT DISTINCT 2 * l_orderkey AS id, 'CREATE' AS action FROM lineitem UNION ALL SELECT o_orderkey, 'DELETE' FROM orders WHERE o_orderkey NOT IN (SELECT 2 * l_orderkey FROM lineitem)")
def _(spark, sf):
    return tables.difference(_doubled(spark, sf).withColumnRenamed("o_orderkey", "id"), table(spark, sf, "orders").select(F.col("o_orderkey").alias("id")), ["id"])


@add("touch_from_join", "SELECT o_orderkey AS id, CASE WHEN o_orderkey IN (SELECT 2 * l_orderkey FROM lineitem) THEN 'new' ELSE 'old' END AS stamp FROM orders")
def _(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.lit("old").alias("stamp"))
    return tables.touched(o, _doubled(spark, sf).withColumnRenamed("o_orderkey", "id"), "id", F.lit("new"), "stamp")


def _doubled(spark, sf):
    return table(spark, sf, "lineitem").select((F.col("l_orderkey") * 2).alias("o_orderkey"), F.lit(-1).cast("long").alias("o_custkey"))


@add("semi_exists", "SELECT p_partkey FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 49)")
def _(spark, sf):
    return tables.exists_in(table(spark, sf, "part").select("p_partkey"), table(spark, sf, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey")), ["p_partkey"])


@add("anti_not_exists", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def _(spark, sf):
    return tables.missing_from(table(spark, sf, "customer").select("c_custkey"), table(spark, sf, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


EVENT_TYPE = "CASE event_type WHEN 'signup' THEN 'CREATE' WHEN 'error' THEN 'DELETE' ELSE 'UPDATE' END"


def _events(spark, sf):
    e = table(spark, sf, "events")
    kind = F.when(F.col("event_type") == "signup", "CREATE").when(F.col("event_type") == "error", "DELETE").otherwise("UPDATE")
    return e.select("event_id", F.col("user_id").alias("key"), "ts", "value", kind.alias("type"))


@add("dedup_last_event", f"SELECT user_id AS key, event_id, {EVENT_TYPE} AS type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def _(spark, sf):
    return tables.last_events(_events(spark, sf), "key", ("ts", "event_id")).select("key", "event_id", "type")


@add("dedup_with_pairs", f"""WITH b AS (SELECT event_id // 2 AS key, event_id, ts, {EVENT_TYPE} AS type, 't' || (user_id % 3) AS tenant FROM events),
 k AS (SELECT key, count(*) AS n, count(DISTINCT tenant) AS t, list_sort(list(DISTINCT type)) AS y FROM b GROUP BY key)
 SELECT key, event_id, type FROM (SELECT b.*, k.n, k.t, k.y, row_number() OVER (PARTITION BY b.key ORDER BY ts DESC, event_id DESC) AS r FROM b JOIN k ON b.key = k.key)
 WHERE r = 1 OR (n = 2 AND t = 2 AND (y = ['CREATE', 'DELETE'] OR y = ['CREATE', 'UPDATE']))""")
def _(spark, sf):
    e = _events(spark, sf).withColumn("user", F.col("key")).withColumn("key", F.expr("event_id div 2")).withColumn("tenant", F.concat(F.lit("t"), (F.col("user") % 3).cast("string")))
    return tables.last_events(e, "key", ("ts", "event_id"), tenant="tenant").select("key", "event_id", "type")


@add("staging_latest", "SELECT l_orderkey, l_linenumber, l_shipdate FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS r FROM lineitem) WHERE r = 1")
def _(spark, sf):
    return tables.latest(table(spark, sf, "lineitem"), ["l_orderkey"], [F.desc("l_shipdate"), *[F.asc(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")]]).select("l_orderkey", "l_linenumber", "l_shipdate")


@add("delete_by_tenant", "SELECT p_partkey FROM part WHERE NOT (p_partkey % 4 = 1 AND NOT p_partkey % 5 = 0)")
def _(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.concat(F.lit("t"), (F.col("p_partkey") % 4).cast("string")).alias("tenant_id"), (F.col("p_partkey") % 5 == 0).alias("shared"))
    return tables.deleted_by_tenant(p, "t1", keep_shared=True).select("p_partkey")


@add("stream_state", f"SELECT user_id AS key, event_id FROM (SELECT *, {EVENT_TYPE} AS type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1 AND type <> 'DELETE'")
def _(spark, sf):
    e = _events(spark, sf)
    first = pipeline.merged(None, e.where("event_id < 4000"), ["key"], ("ts", "event_id"))
    # keys deleted by an early batch and not written since stay away, as they have no later event
    both = pipeline.merged(first, e.where("event_id >= 4000"), ["key"], ("ts", "event_id"))
    return pipeline.live(both).select("key", "event_id")


# consortium
def _tenants(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.concat(F.lit("t"), (F.col("p_partkey") % 4).cast("string")).alias("tenant_id"), F.when(F.col("p_partkey") % 7 != 0, F.col("p_partkey") % 5 == 0).alias("shared"))


@add("affiliation_member", "SELECT p_partkey FROM part WHERE p_partkey % 4 = 2 OR (p_partkey % 7 <> 0 AND p_partkey % 5 = 0)")
def _(spark, sf):
    return _tenants(spark, sf).where(consortium.visible(consortium.Tenant("t2", "central"), F.col("tenant_id"), F.col("shared"))).select("p_partkey")


@add("affiliation_central", "SELECT p_partkey FROM part WHERE p_partkey % 7 <> 0 AND p_partkey % 5 = 0")
def _(spark, sf):
    return _tenants(spark, sf).where(consortium.visible(consortium.Tenant("central", "central"), F.col("tenant_id"), F.col("shared"))).select("p_partkey")


@add("subresource_filter", f"SELECT value, type_id, sum(n)::BIGINT AS total FROM (SELECT value, type_id, tenant_id, shared, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS value, p_type AS type_id, tenant_id, shared FROM {INSTANCE_SQL}) GROUP BY ALL) WHERE tenant_id = 't1' OR shared GROUP BY ALL")
def _(spark, sf):
    entities, relations = children.subjects(instances(spark, sf))
    rows = children.counted(relations, "subject_id", entities).withColumn("instances", consortium.visible_elements(consortium.Tenant("t1", "central"), F.col("instances")))
    return rows.where(F.size("instances") > 0).select("value", "type_id", children.total_count().alias("total"))


@add("consortium_holdings", "SELECT id, tenant_id, instance_id FROM (SELECT l_orderkey || '-' || l_linenumber AS id, 't' || (l_suppkey % 4) AS tenant_id, l_partkey::VARCHAR AS instance_id FROM lineitem) WHERE tenant_id = 't2' ORDER BY instance_id DESC, id LIMIT 50 OFFSET 10")
def _(spark, sf):
    return consortium.holdings(items(spark, sf).select("id", "tenant_id", "instance_id"), tenant="t2", sort_by="instance_id", descending=True, limit=50, offset=10)


@add("batch_lookup", "SELECT l_orderkey || '-' || l_linenumber AS id, l_partkey::VARCHAR AS instance_id FROM lineitem WHERE (l_orderkey || '-' || l_linenumber) IN ('1-1', '2-1', '2-2', '900-1', 'none')")
def _(spark, sf):
    return consortium.batch(items(spark, sf).select("id", "instance_id"), "id", ["1-1", "2-1", "2-2", "900-1", "none"])


@add("batch_lookup_join", "SELECT l_orderkey || '-' || l_linenumber AS id FROM lineitem WHERE l_orderkey < 1500 AND l_linenumber = 1")
def _(spark, sf):
    return consortium.batch(items(spark, sf).select("id"), "id", [f"{i}-1" for i in range(1500)])


@add("location_hierarchy", "SELECT s_suppkey AS id, s_name AS name, n_name AS campus, r_name AS institution FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey ORDER BY s_name, s_suppkey LIMIT 40")
def _(spark, sf):
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    x = table(spark, sf, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("n_name").alias("campus"), F.col("r_name").alias("institution"))
    return consortium.locations(x, limit=40)


@add("nested_condition", "SELECT conv_id FROM conversations WHERE role = 'user' AND turn = 2 GROUP BY conv_id")
def _(spark, sf):
    from ..model import Field, Resource

    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct("turn", "role")).alias("instances"))
    nested = Resource("conversations", (Field("conv_id", "long"), Field("instances.turn", "long", many=True, uses=("filter",)), Field("instances.role", "keyword", many=True, uses=("filter",))), nested="instances", key="conv_id")
    return search.matched(c, "instances.role == user and instances.turn == 2", nested).select("conv_id")


# pipelines
@add("event_routing", "SELECT event_id, CASE user_id % 4 WHEN 0 THEN 'instance' WHEN 1 THEN 'holdings' WHEN 2 THEN 'item' END AS resource, CASE WHEN user_id % 4 IN (1, 2) THEN props->>'$.k' ELSE user_id::VARCHAR END AS record_id FROM events")
def _(spark, sf):
    e = table(spark, sf, "events")
    topic = F.concat(F.lit("folder.inventory."), F.element_at(F.array(*[F.lit(t) for t in ("instance", "holdings-record", "item", "unknown")]), (F.col("user_id") % 4 + 1).cast("int")))
    resource = events.routed(topic)
    body = F.to_json(F.struct(F.get_json_object("props", "$.k").alias("id")))
    return e.select("event_id", resource.alias("resource"), events.record_id(F.coalesce(resource, F.lit("")), F.col("user_id").cast("string"), body).alias("record_id"))


@add("parent_fanout", "SELECT DISTINCT event_id, unnest([user_id, CASE WHEN event_id % 3 = 0 THEN user_id + 1 ELSE user_id END]) AS parent_id FROM events")
def _(spark, sf):
    e = table(spark, sf, "events")
    return events.parents(e, F.col("user_id"), F.when(F.col("event_id") % 3 == 0, F.col("user_id") + 1).otherwise(F.col("user_id"))).select("event_id", "parent_id")


@add("ids_stream", f"SELECT DISTINCT unnest(sizes) AS id FROM {PART_SQL} WHERE p_type = 'SMALL'")
def _(spark, sf):
    return ids.extracted(parts(spark, sf), "p_type == SMALL", PARTS, "sizes")


@add("hex_ranges", "SELECT substr(sha1(p_name || p_partkey), 1, 3) AS range, count(*) AS rows FROM part GROUP BY 1")
def _(spark, sf):
    from ..plans import reindex

    return reindex.ranges(table(spark, sf, "part").select(F.sha1(F.concat("p_name", F.col("p_partkey").cast("string")).cast("binary")).alias("id")))


@add("window_tumbling", "SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS window_start, count(*) AS n FROM events GROUP BY ALL")
def _(spark, sf):
    return pipeline.windowed_counts(table(spark, sf, "events"), "1 hour", by=("event_type",)).select("event_type", "window_start", "n")


@add("session_windows", """SELECT user_id, min(ts) AS session_start, count(*) AS n FROM (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT user_id, ts, event_id, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 2 HOUR THEN 1 ELSE 0 END AS new FROM events)) GROUP BY user_id, s""")
def _(spark, sf):
    return pipeline.session_counts(table(spark, sf, "events"), "2 hours", "user_id").select("user_id", "session_start", "n")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(parts(spark, sf_dir), "p_type == ECONOMY and p_size >= 10 sortBy p_retailprice/sort.descending", PARTS, limit=20, expand_all=True)


# both names of a query that once read a part of its table and another time all of it
for _name in ("insert_ignore", "upsert_replace", "update_diff", "touch_from_join", "single_instance_title", "fn_isbn"):
    FOUND[f"{_name}_all"] = FOUND[_name]

QUERIES = {name: f for name, (f, _) in FOUND.items()}
ORACLE_SQL = {name: sql for name, (_, sql) in FOUND.items() if sql}
