"""Descriptors of the star-schema tables as library resources, and their views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Field, Resource

FF = ("facet", "filter")
PARTS = Resource(
    "parts",
    (
        Field("p_partkey", "long", uses=("filter", "sort")),
        Field("p_name", "standard", uses=("sort",)),
        Field("p_brand", "keyword", uses=(*FF, "sort")),
        Field("p_type", "keyword", uses=(*FF, "sort"), sort=("p_brand",)),
        Field("p_size", "long", uses=(*FF, "sort")),
        Field("p_retailprice", "double", uses=("filter", "sort")),
        Field("brand_lower", "keyword_lowercase"),
        Field("tags", "keyword", many=True, uses=FF),
        Field("sizes", "long", many=True, uses=("filter", "sort")),
        Field("note", "keyword"),
        Field("shelf", "keyword", uses=("sort",)),
    ),
    aliases={"keyword": ("p_name", "p_type"), "title": ("p_name",), "brand": ("p_brand",), "labels": ("p_brand", "p_type")},
    key="p_partkey",
)
DOCUMENTS = Resource(
    "documents",
    (
        Field("doc_id", "long", uses=("filter", "sort")),
        Field("text", "standard"),
        Field("lang", "keyword", uses=FF),
        Field("source", "keyword", uses=FF),
        Field("n_chars", "long", uses=("filter", "sort")),
    ),
    aliases={"keyword": ("text", "lang"), "cql.all": ("text", "lang", "source")},
    key="doc_id",
)
ORDERS = Resource(
    "orders",
    (Field("o_orderkey", "long", uses=("filter", "sort")), Field("o_orderdate", "date", uses=("filter", "sort")), Field("o_orderstatus", "keyword", uses=FF), Field("o_totalprice", "double", uses=("filter", "sort"))),
    key="o_orderkey",
)


SPOKEN = Resource(
    "spoken",
    (Field("doc_id", "long", uses=("sort",)), Field("text", "multilang"), Field("languages", "keyword", True)),
    key="doc_id",
    languages=("eng", "ger", "fre", "spa"),
)
#: Codes of languages as the tables have them, and as records do.
CODES = {"en": "eng", "de": "ger", "fr": "fre", "es": "spa"}


def spoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their language as a record names it."""
    code = F.create_map(*[F.lit(x) for pair in CODES.items() for x in pair])[F.col("lang")]
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang", F.array_compact(F.array(code)).alias("languages"))


HEADINGS = Resource(
    "headings",
    (
        Field("doc_id", "long", uses=("sort",)),
        Field("heading", "keyword_icu", uses=("sort",)),
        Field("first", "keyword_icu", uses=FF),
        Field("words", "keyword_icu", many=True, uses=(*FF, "sort")),
        Field("lang", "keyword", uses=FF),
    ),
    key="doc_id",
)


def headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by their first two words, which have capitals and accents."""
    words = F.slice(F.split("text", " "), 1, 2)
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(words, " ").alias("heading"), words[0].alias("first"), words.alias("words"), "lang")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with a lower-case brand, a tag array, an array of sizes, a note that some lack, and a shelf mark."""
    p = table(spark, sf_dir, "part")
    return p.withColumns(
        {
            "brand_lower": F.col("p_brand"),
            "tags": F.array(F.col("p_type"), F.split("p_name", " ")[0]),
            "sizes": F.array("p_size", (F.col("p_partkey") % 50).cast("int")),
            "note": F.when(F.col("p_partkey") % 3 == 0, F.col("p_type")),
            "shelf": shelf_mark(),
        }
    )


def shelf_mark() -> Column:
    return F.concat_ws(" ", F.regexp_replace("p_brand", "#", " "), F.concat(F.lit("."), F.col("p_size").cast("string"), F.lit(":"), (F.col("p_partkey") % 2000).cast("string")))


def instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as instances: subjects are the words of the name, the contributor is the brand, the classification brand and type."""
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").cast("string").alias("id"),
        F.concat(F.lit("t"), (F.col("p_partkey") % 4).cast("string")).alias("tenant_id"),
        (F.col("p_partkey") % 5 == 0).alias("shared"),
        F.col("p_name").alias("title"),
        F.transform(F.split("p_name", " "), lambda w: F.struct(w.alias("value"), F.lit(None).cast("string").alias("authorityId"), F.lit("s1").alias("sourceId"), F.col("p_type").alias("typeId"))).alias("subjects"),
        F.array(F.struct(F.col("p_brand").alias("name"), F.lit("n1").alias("contributorNameTypeId"), F.lit(None).cast("string").alias("authorityId"), F.when(F.col("p_size") > 25, F.col("p_type")).alias("contributorTypeId"))).alias("contributors"),
        F.array(F.struct(F.concat_ws(" ", "p_brand", "p_type").alias("classificationNumber"), F.lit("lc").alias("classificationTypeId"))).alias("classifications"),
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as items: the part is the instance, the supplier the location, status and mode the call number's parts."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("id"),
        F.col("l_partkey").cast("string").alias("instance_id"),
        F.concat(F.lit("t"), (F.col("l_suppkey") % 4).cast("string")).alias("tenant_id"),
        (F.col("l_suppkey") % 10).cast("string").alias("location_id"),
        F.concat(F.lit("CN "), (F.col("l_partkey") % 100).cast("string")).alias("call_number"),
        F.col("l_linestatus").alias("prefix"),
        F.col("l_returnflag").alias("suffix"),
        F.lit("lc").alias("type_id"),
    )
