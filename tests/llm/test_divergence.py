"""Operator 12 against all terms of all pairs."""

import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfspark.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return TERM.findall((text or "").translate(LOW))


def truth(rows, least=10, top=10):
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source, found = lang or "", source or "", words(text)
        groups[lang].add(source)
        docs[lang].update(set(found))
        counts[lang, source].update(found)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        p = {}
        for s in sources:
            n = sum(counts[lang, s][t] for t in kept)
            p[s] = {t: 1 + 10**9 * (counts[lang, s][t] + 2) // (n + 2 * len(kept)) for t in kept}
        whole = Counter()
        for s in sources:
            whole.update(counts[lang, s])
        n = sum(whole[t] for t in kept)
        q = {t: 1 + 10**9 * (whole[t] + 2) // (n + 2 * len(kept)) for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = sorted(((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s))
            out += [(lang, s, "pair", o, -v, i + 1) for i, (v, _, o) in enumerate(pairs)]
            terms = sorted((-f(p[s][t], q[t]), t.encode(), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t])
            out += [(lang, s, "term", t, -v, i + 1) for i, (v, _, t) in enumerate(terms[:top])]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


@given(st.lists(st.one_of(st.none(), st.text("aZéß1 _`{@[😀", max_size=20)), max_size=6))
@settings(max_examples=100, deadline=None)
def test_terms_are_runs_of_letters(texts):
    found, row = divergence.terms(pa.array(texts, pa.string()))
    assert list(zip(row.tolist(), found.to_pylist(), strict=True)) == [(i, w) for i, t in enumerate(texts) for w in words(t)]


def test_audit_equals_brute_force(spark):
    """A hot source, ties, groups and languages without terms, nulls, clashing names, a long text."""
    rng = random.Random(4)
    rows = []
    for i in range(400):
        lang, source = rng.choice(["en", "de", None, "xx"]), rng.choice(["hot"] * 5 + ["a", "b", "é", None])
        text = " ".join(f"{chr(97 + int(rng.random() ** 2 * 20))}{rng.choice(['', 'X', 'é', 'q'])}" for _ in range(rng.randint(0, 30)))
        rows.append((text if lang != "xx" else rng.choice([None, "", "1 2 3"]), lang, source))
    rows += [("zz " * 50_000, "en", "long"), ("only once", "fr", "s"), (None, "fr", "t"), rows[0], rows[0]]
    df = spark.createDataFrame([(*r, "clash", 1, 2, 3, 4) for r in rows], "text string, lang string, source string, term string, count long, value long, docs long, rank int").repartition(4)
    assert got(divergence.audit(df)) == truth(rows)
    # without anything sent to every task the result is the same
    assert got(divergence.audit(df, divergence.Audit(least=3, top=4, few=0))) == truth(rows, 3, 4)


def test_counts_beyond_longs_are_exact(spark):
    df = spark.createDataFrame([(2**40, 2**41 + 3, 5), (0, 7, 0)], "n long, t long, k long").select(divergence.weight("n", "t", "k", 10**9))
    assert [r[0] for r in df.collect()] == [1 + 10**9 * (2**40 + 2) // (2**41 + 13), None]


def test_of_nothing(spark, none):
    assert got(divergence.audit(none)) == []
