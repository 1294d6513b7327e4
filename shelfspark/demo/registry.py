"""The registry of queries, and SQL that several of them share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
FOUND: dict[str, tuple[Query, str | None]] = {}

PART_SQL = """(SELECT *, p_brand AS brand_lower, [p_type, string_split(p_name, ' ')[1]] AS tags, [p_size, (p_partkey % 50)::INTEGER] AS sizes,
 CASE WHEN p_partkey % 3 = 0 THEN p_type END AS note,
 concat_ws(' ', replace(p_brand, '#', ' '), '.' || p_size || ':' || (p_partkey % 2000)) AS shelf FROM part)"""
FOLD_SQL = "replace(replace(replace(strip_accents(lower(text)), 'ß', 'ss'), 'æ', 'ae'), 'œ', 'oe')"
DOC_SQL = rf"""(SELECT *, regexp_split_to_array(f, '[^\p{{L}}\p{{N}}]+') AS base,
 list_transform(regexp_split_to_array(f, '\s+'), lambda w: regexp_replace(w, '[^\p{{L}}\p{{N}}]+', '', 'g')) AS whole FROM (SELECT *, {FOLD_SQL} AS f FROM documents))"""


def fold_sql(column: str) -> str:
    return FOLD_SQL.replace("text", column)


HEADING_SQL = f"""(SELECT doc_id, lang, array_to_string(w, ' ') AS heading, trim({fold_sql("array_to_string(w, ' ')")}) AS k, trim({fold_sql("w[1]")}) AS first,
 list_distinct(list_transform(w, lambda x: trim({fold_sql("x")}))) AS words FROM (SELECT *, string_split(text, ' ')[1:2] AS w FROM documents))"""


def has(token: str) -> str:
    return f"(list_contains(base, '{token}') OR list_contains(whole, '{token}'))"


def add(name: str, sql: str | None = None):
    def put(f: Query) -> Query:
        FOUND[name] = (f, sql)
        return f

    return put


INSTANCE_SQL = """(SELECT p_partkey::VARCHAR AS id, 't' || (p_partkey % 4) AS tenant_id, p_partkey % 5 = 0 AS shared, p_name, p_brand, p_type, p_size FROM part)"""
ITEM_SQL = """(SELECT l_orderkey || '-' || l_linenumber AS id, l_partkey::VARCHAR AS instance_id, 't' || (l_suppkey % 4) AS tenant_id, (l_suppkey % 10)::VARCHAR AS location_id,
 'CN ' || (l_partkey % 100) AS call_number, l_linestatus AS prefix, l_returnflag AS suffix FROM lineitem)"""
