"""Queries over headings with capitals and accents: what is compared, sorted and counted is their normalised form."""

from __future__ import annotations

from ..operators import browse as B
from ..operators import facets, search
from ..plans.ordered import Ordered
from ..session import scratch
from .catalog import HEADINGS, headings
from .registry import FOUND, HEADING_SQL, add

ORDER = B.Order(("heading", "doc_id"), "heading")
PAGE = ("doc_id", "heading", "is_anchor", "position", "prev", "next")


def around_sql(anchor: str, folded: str, before: int, behind: int, where: str = "true") -> str:
    """A page around an anchor that is wanted itself; without one that is equal a placeholder has it as it was typed."""
    h = f"(SELECT * FROM {HEADING_SQL} WHERE {where})"
    return f"""WITH b AS (SELECT doc_id, heading, k, false AS is_anchor FROM {h} WHERE k < '{folded}' ORDER BY k DESC, doc_id DESC LIMIT {before}),
 m AS (SELECT doc_id, heading, k, true AS is_anchor FROM {h} WHERE k = '{folded}'),
 f AS (SELECT * FROM m UNION ALL SELECT NULL::BIGINT, '{anchor}', '{folded}', true WHERE NOT EXISTS (FROM m) UNION ALL SELECT doc_id, heading, k, false FROM {h} WHERE k > '{folded}' OR k IS NULL),
 g AS (SELECT * FROM f ORDER BY k NULLS LAST, doc_id NULLS LAST LIMIT {behind}),
 p AS (SELECT * FROM b UNION ALL SELECT * FROM g)
 SELECT doc_id, heading, is_anchor, row_number() OVER w - 1 AS position,
 CASE WHEN (SELECT count(*) FROM {h} WHERE k < '{folded}') > {before} THEN first(heading) OVER v END AS prev,
 CASE WHEN (SELECT count(*) FROM f) > {behind} THEN last(heading) OVER v END AS next
 FROM p WINDOW w AS (ORDER BY k NULLS LAST, doc_id NULLS LAST), v AS (ORDER BY k NULLS LAST, doc_id NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"""


def on_headings(name: str, cql: str, limit: int, preceding: int | None, sql: str, stored: int | None = None) -> None:
    """``stored``: through a table stored in order, in so many ranges."""

    def run(spark, sf):
        ctx, rows = B.context(cql, HEADINGS, "heading", limit, preceding), headings(spark, sf)
        if stored is not None:
            ordered = Ordered.write(rows, HEADINGS, scratch(spark, "headings"), ORDER, stored)
            left = (lambda df: search.to_column(search.And(ctx.filters), HEADINGS, df.columns)) if ctx.filters else None
            rows = ordered.near(ctx, B.anchor_key_of(ctx, ORDER, HEADINGS), HEADINGS, left and (lambda df: df.where(left(df))))
        return B.browse(rows, ctx, ORDER, HEADINGS).select(*PAGE)

    FOUND[name] = (run, sql)


on_headings("browse_mixed_case", 'heading < "The ONEA" or heading >= "The ONEA"', 20, 8, around_sql("The ONEA", "the onea", 8, 12))
on_headings("browse_accents", 'heading < "Èr" or heading >= "Èr"', 30, None, around_sql("Èr", "er", 15, 15))
on_headings("browse_ordered", 'heading < "Édi" or heading >= "Édi"', 25, 10, around_sql("Édi", "edi", 10, 15), stored=16)
on_headings("browse_ordered_filtered", '(heading < "Ou" or heading >= "Ou") and lang == de', 40, None, around_sql("Ou", "ou", 20, 20, "lang = 'de'"), stored=16)


@add("sort_normalised", f"SELECT doc_id, heading FROM {HEADING_SQL} ORDER BY k NULLS LAST, doc_id LIMIT 60 OFFSET 40")
def _(spark, sf):
    return search.search(headings(spark, sf), "cql.allRecords=1 sortBy heading", HEADINGS, 60, 40, expand_all=True).select("doc_id", "heading")


@add("sort_normalised_collection", f"SELECT doc_id, heading FROM {HEADING_SQL} ORDER BY list_max(words) DESC NULLS LAST, doc_id LIMIT 60")
def _(spark, sf):
    return search.search(headings(spark, sf), "cql.allRecords=1 sortBy words/sort.descending", HEADINGS, 60, expand_all=True).select("doc_id", "heading")


@add("facet_normalised", f"SELECT 'first' AS facet, first AS id, count(*) AS total_records, first IN ('the', 'etre') AS selected FROM {HEADING_SQL} WHERE first IS NOT NULL GROUP BY first ORDER BY 4 DESC, 3 DESC, 2 LIMIT 12")
def _(spark, sf):
    return facets.facets(headings(spark, sf), 'first == ("The" or "Être")', ["first:12"], HEADINGS)


@add("facet_normalised_array", f"SELECT 'words' AS facet, id, count(*) AS total_records, false AS selected FROM (SELECT unnest(words) AS id FROM {HEADING_SQL} WHERE lang = 'fr') WHERE id IS NOT NULL GROUP BY id")
def _(spark, sf):
    return facets.facets(headings(spark, sf), "lang == fr", ["words"], HEADINGS)
