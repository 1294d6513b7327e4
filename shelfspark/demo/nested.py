"""Queries over nested documents, over children kept up to date by changes, and over rebuilds by ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..engine import Engine
from ..model import Field, Resource
from ..operators import lookups
from ..operators.ids import Scroll
from ..operators.tables import Versions
from ..plans import documents, incremental, reindex
from ..session import scratch
from .catalog import PARTS, instances, parts, table
from .registry import INSTANCE_SQL, PART_SQL, add

ORDER = Resource(
    "order",
    (
        Field("id", "long"), Field("status", "keyword"), Field("lines.number", "long", True), Field("lines.mode", "keyword", True, default="none"),
        Field("lines.supplier.key", "long", True), Field("lines.supplier.notes.text", "standard", True, default="?"), Field("lines.internal", "none", True),
    ),
)


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as documents of three levels, with fields that the descriptor lacks, missing values, and values in a plain form beside.

    Lines that number, supplier and quantity leave equal stay in the order of the table."""
    note = F.struct(F.when(F.col("l_quantity") > 25, F.lit("big")).alias("plain_text"), F.lit("analysed").alias("text"), F.lit(1).alias("junk"))
    supplier = F.struct(F.col("l_suppkey").alias("key"), F.array(note, note).alias("notes"), F.lit("x").alias("junk"))
    line = F.struct(F.col("l_linenumber").alias("number"), F.when(F.col("l_returnflag") != "R", F.col("l_linestatus")).alias("mode"), supplier.alias("supplier"), F.lit("y").alias("internal"))
    place = (F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    lines = table(spark, sf_dir, "lineitem").select("*", *place).groupBy(F.col("l_orderkey").alias("id")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_suppkey", "l_quantity", "file", "row", line.alias("line")))).alias("lines")).withColumn("lines", F.col("lines.line"))
    head = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.lit(None).cast("string").alias("junk"))
    return head.join(lines, "id", "left")


@add("document_nested", """SELECT o_orderkey AS id, o_orderstatus AS status, coalesce(string_agg(l_linenumber || CASE WHEN l_returnflag <> 'R' THEN l_linestatus ELSE 'none' END || l_suppkey, ',' ORDER BY l_linenumber, l_suppkey, l_quantity), '') AS lines,
 coalesce(string_agg(CASE WHEN l_quantity > 25 THEN 'big,big' ELSE '?,?' END, ',' ORDER BY l_linenumber, l_suppkey, l_quantity) FILTER (l_orderkey IS NOT NULL), '') AS notes,
 'id,status,lines,number,mode,supplier,key,notes,text' AS fields FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL""")
def _(spark, sf):
    df = documents.projected(documents.unplained(orders(spark, sf)), ORDER)
    element = df.schema["lines"].dataType.elementType
    supplier = element["supplier"].dataType
    fields = [*df.columns, *element.fieldNames(), *supplier.fieldNames(), *supplier["notes"].dataType.elementType.fieldNames()]
    shown = F.array_join(F.transform("lines", lambda x: F.concat(x["number"], x["mode"], x["supplier"]["key"])), ",")
    notes = F.array_join(documents.at_path(df, "lines.supplier.notes.text"), ",")
    return df.select("id", "status", F.coalesce(shown, F.lit("")).alias("lines"), F.coalesce(notes, F.lit("")).alias("notes"), F.lit(",".join(fields)).alias("fields"))


@add("document_at_path", "SELECT o_orderkey AS id, coalesce(string_agg(l_suppkey::VARCHAR, ',' ORDER BY l_linenumber, l_suppkey, l_quantity), '') AS suppliers FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL")
def _(spark, sf):
    df = orders(spark, sf)
    return df.select("id", F.coalesce(F.array_join(documents.at_path(df, "lines.supplier.key").cast("array<string>"), ","), F.lit("")).alias("suppliers"))


HOLDING_SQL = "(SELECT DISTINCT l_partkey AS instance_id, l_suppkey, 't' || (l_suppkey % 4) AS tenant_id FROM lineitem)"


@add("member_assembled", f"""WITH i AS (SELECT p_partkey AS id, 't' || (p_partkey % 4) AS tenant_id, p_partkey % 5 = 0 AS shared FROM part),
 h AS (SELECT * FROM {HOLDING_SQL} WHERE tenant_id = 't1'),
 m AS (SELECT * FROM i WHERE tenant_id = 't1' UNION ALL SELECT * FROM i WHERE shared AND id IN (SELECT instance_id FROM h))
 SELECT id, tenant_id, shared, (SELECT count(*) FROM h WHERE instance_id = id) AS holdings,
 (SELECT count(*) FROM lineitem WHERE l_partkey = id AND l_suppkey % 4 = 1 AND l_linestatus = 'O') AS items FROM m""")
def _(spark, sf):
    i = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("t"), (F.col("p_partkey") % 4).cast("string")).alias("tenant_id"), (F.col("p_partkey") % 5 == 0).alias("shared"))
    li = table(spark, sf, "lineitem").withColumn("tenant_id", F.concat(F.lit("t"), (F.col("l_suppkey") % 4).cast("string")))
    holding = F.concat_ws("-", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"))
    holdings = li.select(holding.alias("id"), F.col("l_partkey").alias("instance_id"), "tenant_id").distinct()
    items = li.where("l_linestatus = 'O'").select(F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("id"), holding.alias("holding_id"), "tenant_id")
    found = reindex.member_assembled(i, i, holdings, items, "t1")
    return found.select("id", "tenant_id", "shared", F.size("holdings").cast("long").alias("holdings"), F.size("items").cast("long").alias("items"))


@add("fn_authority_lccns", """SELECT s_suppkey, array_to_string(list_sort(list_distinct(list_transform(list_filter([s_nationkey, (s_nationkey + 1) % 25], lambda k: k % 3 = 1), lambda k: lower(replace(s_name, ' ', '')) || k))), ',') AS lccn,
 array_to_string(list_sort(list_distinct(list_transform(list_filter([s_nationkey, (s_nationkey + 1) % 25], lambda k: k % 3 = 2), lambda k: lower(replace(s_name, ' ', '')) || k))), ',') AS canceled FROM supplier""")
def _(spark, sf):
    """Suppliers' identifiers by types that are nations, whose code follows from their number."""
    code = F.when(F.col("n_nationkey") % 3 == 1, "lccn").when(F.col("n_nationkey") % 3 == 2, "canceled-lccn").otherwise("other")
    reference = table(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("id"), code.alias("code"))
    one = lambda k: F.struct(F.concat(F.col("s_name"), F.lit(" "), k.cast("string")).alias("value"), k.cast("string").alias("identifierTypeId"))
    rows = table(spark, sf, "supplier").withColumn("identifiers", F.array(one(F.col("s_nationkey")), one((F.col("s_nationkey") + 1) % 25)))
    both = lookups.lccns_by_code(lookups.lccns_by_code(rows, reference), reference, canceled=True)
    return both.select("s_suppkey", F.array_join(F.array_sort("lccn"), ",").alias("lccn"), F.array_join(F.array_sort("canceledLccn"), ",").alias("canceled"))


@add("consortium_units", "SELECT n_nationkey::VARCHAR AS id, n_name AS name, 't' || n_regionkey AS tenant_id FROM nation WHERE n_regionkey = 2 ORDER BY n_name DESC, id LIMIT 4 OFFSET 1")
def _(spark, sf):
    """Campuses of one tenant, by name from the end."""
    campuses = table(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name"), F.concat(F.lit("t"), F.col("n_regionkey").cast("string")).alias("tenantId"))
    engine = Engine(spark, {"campus": campuses})
    return engine.units("campus", tenant="t2", sort_by="name", descending=True, limit=4, offset=1).withColumnRenamed("tenantId", "tenant_id")


@add("child_incremental", f"""SELECT value, type_id, tenant_id, shared, count(*) AS n FROM (SELECT unnest(string_split(CASE WHEN id::BIGINT % 3 = 0 THEN 'new ' || p_name ELSE p_name END, ' ')) AS value, p_type AS type_id, tenant_id, shared FROM {INSTANCE_SQL} WHERE id::BIGINT % 7 <> 0) GROUP BY ALL""")
def _(spark, sf):
    """Subjects after two batches: all instances, then a third of them with another subject and a seventh deleted."""
    every = instances(spark, sf).withColumn("deleted", F.lit(False))
    state = incremental.Children(spark, scratch(spark, "children"), "subject", buckets=8)
    state.apply(every, 0)
    key, more = F.col("id").cast("long"), F.col("subjects")[0].withField("value", F.lit("new"))
    changed = every.where((key % 3 == 0) | (key % 7 == 0)).withColumn("deleted", key % 7 == 0).withColumn("subjects", F.when(key % 3 == 0, F.concat(F.array(more), "subjects")).otherwise(F.col("subjects")))
    state.apply(changed, 1)
    return state.documents().select("value", "type_id", F.explode("instances").alias("x")).select("value", "type_id", "x.tenant_id", "x.shared", F.col("x.count").alias("n"))


@add("rebuild_ranges", "SELECT sha1(doc_id::VARCHAR)[1:1] AS range, count(*) AS rows, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY ALL")
def _(spark, sf):
    """Documents rebuilt by ranges of a digest, in a second run that finds the first one's failures."""
    source = table(spark, sf, "documents").select(F.sha1(F.col("doc_id").cast("string").cast("binary")).alias("id"), "n_chars")
    rebuild = reindex.Rebuild(spark, scratch(spark, "rebuild"), level=1)

    def broken(df: DataFrame) -> DataFrame:
        if not df.where(F.substring("id", 1, 1).isin("3", "c")).isEmpty():
            raise ValueError("broken")
        return df

    rebuild.run(source, broken)
    rebuild.run(source, lambda df: df)
    return rebuild.read().groupBy(F.substring("id", 1, 1).alias("range")).agg(F.count(F.lit(1)).alias("rows"), F.sum("n_chars").alias("chars"))


@add("scroll_version", f"SELECT p_partkey, p_size FROM {PART_SQL} WHERE p_type = 'SMALL' ORDER BY p_partkey LIMIT 12 OFFSET 12")
def _(spark, sf):
    """The second page of a scroll, from the version of its first, though all rows have changed between them."""
    versions, rows = Versions(spark, scratch(spark, "scroll"), 4), parts(spark, sf).select("p_partkey", "p_type", "p_size")
    versions.replace(rows, ["p_partkey"])
    scroll = Scroll(versions, PARTS)
    first, cursor = scroll.page("p_type == SMALL", 12)
    versions.replace(rows.withColumn("p_size", F.lit(-1)).where("p_partkey % 2 = 0"), ["p_partkey"])
    page = scroll.page("p_type == SMALL", 12, cursor)[0] if cursor else first.limit(0)
    return page.select("p_partkey", "p_size")
