"""What only shows on larger or odder tables than those of the other tests."""

import random
import re
from collections import Counter

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
from shelfspark import analysis
from shelfspark.model import Field, Resource
from shelfspark.plans import grouping, index
from test_oracle import plain


@pytest.fixture
def compared(spark, tmp_path):
    """Writes tables by DuckDB's SQL, and compares a query over them with its own SQL, read by one thread."""
    con = duckdb.connect(config={"threads": 1})

    def check(name: str, **tables: str) -> list:
        for t, sql in tables.items():
            con.sql(f"copy ({sql}) to '{tmp_path}/{t}.parquet' (format parquet)")
            con.sql(f"create or replace view {t} as select * from '{tmp_path}/{t}.parquet'")
        df, relation = entry.queries()[name](spark, str(tmp_path)), con.sql(entry.oracle_sql()[name])
        columns = relation.columns
        rows = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
        assert rows == sorted(tuple(plain(v) for v in r) for r in relation.fetchall())
        return rows

    return check


def test_lines_that_no_key_tells_apart_stay_in_the_order_of_the_table(compared):
    lines = "select 0::bigint l_orderkey, 5::bigint l_suppkey, 1 + i // 6 l_linenumber, 7.0::double l_quantity, ['A', 'R', 'N'][1 + i % 3] l_returnflag, ['O', 'O', 'F', 'F'][1 + i % 4] l_linestatus from range(12) t(i)"
    compared("document_nested", orders="select 0::bigint o_orderkey, 'O' o_orderstatus", lineitem=lines)


def test_a_consolidated_search_returns_every_match(compared):
    rows = compared("search_consolidated", part="select i::bigint p_partkey, 7 + i % 2 p_size from range(1300) t(i)")
    assert len(rows) == 650


def test_a_phrase_is_stemmed_in_english_only(compared):
    texts = "select i::bigint doc_id, ['the thing', 'the things', 'a thing'][1 + i // 5] \"text\", ['en', 'de', 'fr', 'es', NULL][1 + i % 5] lang, 's' source, 9::bigint n_chars from range(15) t(i)"
    assert len(compared("search_stemmed_phrase", documents=texts)) == 6


def test_items_leave_the_holdings_of_their_instance_behind(compared, spark, tmp_path):
    """Each line of a part took along all of the part's lines, a square of a part's size on disk."""
    compared("holdings_of_items", lineitem="select nullif(i % 40, 7) l_partkey, i // 3 l_orderkey, 1 + (i % 3)::int l_linenumber, (i % 50)::double l_quantity from range(3000) t(i)")
    plan = entry.queries()["holdings_of_items"](spark, str(tmp_path))._jdf.queryExecution().toString()
    assert "explode(items#" in plan and not re.search(r"Generate explode\(items#\d+\), \[[^\]]*holdings", plan)


BOOKS = Resource("books", (Field("id", "keyword"), Field("names", "standard", True), Field("text", "standard")))
ROWS = [("k1", ["a-b c", "b a-b"], "x & y"), ("k2", ["The the", "", "the-the"], None), ("k3", [], "---"), ("k4", None, " & "), ("k5", ["É-ß", "the"], "AB-ab ab-ab o'c"), ("k6", ["_a_b_"], "R&B")]
ROWS += [(f"l{i:04}", ["the", f"the w{i}"], "the end, the end") for i in range(400)]


def by_hand(key, field, values):
    every, at = Counter(), {}
    for v, value in enumerate(values):
        for i, t in enumerate(analysis.text_tokens(value)):
            at.setdefault(t, []).append((v << 32) + i)
        for word in analysis.read_text(value).split():
            parts = analysis.text_tokens(word)
            every.update(parts + (["".join(parts)] if len(parts) > 1 else []))
    return [(t, field, key, n, sum(every.values()), at.get(t, [])) for t, n in every.items()]


def test_postings_of_all_documents_without_a_sort_of_their_tokens(spark, tmp_path):
    """Tokens were exploded, sorted and grouped for each document, twice over; ranges of a frequent term are told apart by key."""
    df = spark.createDataFrame(ROWS, "id string, names array<string>, text string")
    made = index.Inverted.of(df, BOOKS)
    assert "Aggregate" not in made.postings._jdf.queryExecution().toString()
    made.write(f"{tmp_path}/inverted", 5)
    stored = index.Inverted.open(spark, f"{tmp_path}/inverted")
    expected = [p for key, names, text in ROWS for p in by_hand(key, "names", names or []) + by_hand(key, "text", [text or ""])]
    for some in (made, stored):
        assert sorted(map(tuple, some.postings.select("term", "field", "key", "tf", "length", "positions").collect())) == sorted(expected)
    n = {f: sum(p[3] for p in expected if p[1] == f) for f in ("names", "text")}
    assert sorted(map(tuple, stored.lengths.select("field", "n_docs", "n_tokens").collect())) == [("names", 404, n["names"]), ("text", 404, n["text"])]
    files = [spark.read.parquet(str(f)).select("term", "key").collect() for f in (tmp_path / "inverted/postings").glob("*.parquet")]
    ends = sorted((min(map(tuple, f)), max(map(tuple, f))) for f in files if f)
    assert len(ends) == 5 and all(a[1] < b[0] for a, b in zip(ends, ends[1:])) and sum(a[0] <= "the" <= b[0] for a, b in ends) > 1


def test_batches_that_are_cut_have_the_same_postings(monkeypatch):
    base = [[["a", "b", "a"], []], [], [["b"], ["c", "a"]], [["d"] * 9], [[]], [["a", "d"]]]
    batch = pa.RecordBatch.from_pydict({"key": pa.array([1, 2, 3, 4, 5, 6]), "field": ["x", "y"] * 3, "base": pa.array(base, pa.list_(pa.list_(pa.string()))), "joined": pa.array([["ab"], [], ["ca", "bc"], [], ["q"], []], pa.list_(pa.string()))})

    def rows():
        return sorted(tuple(r.values()) for b in grouping.grouped([batch], (["a", "a", "d"], [2, 5, 4])) for r in b.to_pylist())

    whole = rows()
    assert [(r[0], r[2], r[3], r[4], r[5], r[6]) for r in whole if r[0] in "ad"] == [("a", 1, 2, 4, [0, 2], 0), ("a", 3, 1, 5, [(1 << 32) + 1], 1), ("a", 6, 1, 2, [0], 2), ("d", 4, 9, 9, list(range(9)), 2), ("d", 6, 1, 2, [1], 3)]
    for most in (1, 3, 7):
        monkeypatch.setattr(grouping, "MOST_TOKENS", most)
        assert rows() == whole


@pytest.mark.parametrize("name", ["search_relevance", "search_relevance_any", "search_ranked", "text_all_inverted", "text_any_inverted", "text_phrase_inverted", "text_phrase_repeated_inverted", "text_ne_inverted"])
def test_queries_of_the_inverted_index_over_odd_texts(compared, tmp_path, name):
    words, at = "the with of and pour nicht value of-the The w Thé -- x wi-th R&B the".split(), random.Random(4)
    texts = [None if i % 50 == 7 else (" ", "  ")[i % 2].join(at.choices(words, k=i % 60)) for i in range(600)]
    made = pa.table({"doc_id": range(600), "text": texts, "lang": [("en", "de", None)[i % 3] for i in range(600)], "source": ["s"] * 600, "n_chars": [i * 7 for i in range(600)]})
    pq.write_table(made, tmp_path / "made.parquet")
    compared(name, documents=f"select * from '{tmp_path}/made.parquet'")
