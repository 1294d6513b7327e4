"""Queries through stored indexes of the documents and parts, each written once for a folder of tables."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..cql.bind import bind
from ..operators import search
from ..plans import index
from ..session import scratch
from .catalog import DOCUMENTS, PARTS, parts, table
from .registry import DOC_SQL, FOUND, PART_SQL, add, has

_PATHS: dict[tuple[str, str, str], str] = {}


def once(spark: SparkSession, sf_dir: str, name: str, write) -> str:
    """Folder of a stored index, written where this session has none of that name for the tables."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _PATHS:
        path = scratch(spark, name)
        write(path)
        _PATHS[key] = path
    return _PATHS[key]


def inverted(spark: SparkSession, sf_dir: str) -> index.Inverted:
    write = lambda path: index.Inverted.of(table(spark, sf_dir, "documents"), DOCUMENTS).write(path)
    return index.Inverted.open(spark, once(spark, sf_dir, "inverted-documents", write))


def grams(spark: SparkSession, sf_dir: str) -> index.Grams:
    write = lambda path: index.Grams.of(parts(spark, sf_dir), PARTS, ("p_name", "shelf", "tags")).write(path)
    return index.Grams.open(spark, once(spark, sf_dir, "grams-parts", write))


def on_inverted(name: str, cql: str, where: str) -> None:
    """All documents that match, found in the inverted index."""

    def run(spark, sf):
        found = index.filtered(table(spark, sf, "documents"), bind(cql, DOCUMENTS)[0], DOCUMENTS, inverted(spark, sf))
        return found.select("doc_id", "lang")

    FOUND[name] = (run, f"SELECT doc_id, lang FROM {DOC_SQL} WHERE {where}")


LINE = "' ' || array_to_string(list_filter(base, lambda x: x <> ''), ' ') || ' '"
on_inverted("text_all_inverted", 'text all "the with"', f"{has('the')} AND {has('with')}")
on_inverted("text_any_inverted", 'text any "pour nicht"', f"{has('pour')} OR {has('nicht')}")
on_inverted("text_phrase_inverted", 'text == "of the"', f"contains({LINE}, ' of the ')")
on_inverted("text_phrase_repeated_inverted", 'text == "the the of the"', f"contains({LINE}, ' the the of the ')")
on_inverted("text_ne_inverted", 'text <> "the with" and lang == en and text == "and the"', f"NOT ({has('the')} AND {has('with')}) AND lang = 'en' AND contains({LINE}, ' and the ')")


@add("wildcard_indexed", f"SELECT p_partkey, p_name FROM {PART_SQL} WHERE lower(p_name) LIKE '%d%bolt%'")
def _(spark, sf):
    return index.filtered(parts(spark, sf), bind("p_name = *d*bolt*", PARTS)[0], PARTS, grams=grams(spark, sf)).select("p_partkey", "p_name")


@add("wildcard_indexed_edges", f"SELECT p_partkey, shelf FROM {PART_SQL} WHERE shelf LIKE 'Br%7_.%:1_9' AND len(list_filter(tags, lambda x: x LIKE 'r%d')) > 0")
def _(spark, sf):
    return index.filtered(parts(spark, sf), bind("shelf == Br*7?.*:1?9 and tags == r*d", PARTS)[0], PARTS, grams=grams(spark, sf)).select("p_partkey", "shelf")
