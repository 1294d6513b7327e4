"""The stored form of a resource: documents with normalised copies of their search fields.

``norm__x`` holds keyword forms, ``tok__x`` and ``base__x`` token arrays, ``tok_eng__x`` and the like those of records in a language.  Conditions on stored copies reach the
Parquet scan, where ``lower(x) = ...`` would not; searches take them without being told.  ``Inverted`` is the other
stored form: postings sorted by term, with positions, for words, phrases and relevance.  ``Grams`` has postings of three letters for
patterns with wildcards.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import analysis
from ..cql.bind import And, Match, Not, Reader, to_column
from ..model import Resource
from . import grouping


def prepared(df: DataFrame, resource: Resource) -> DataFrame:
    """``df`` with a normalised copy of each field that needs one."""
    out = {}
    for f in resource.fields:
        if "." in f.path or f.path not in df.columns:
            continue
        c = F.col(f.path)
        if f.text:
            values = c if f.many else F.array(c)
            out[f"tok__{f.path}"] = F.transform(values, analysis.tokens)
            out[f"base__{f.path}"] = F.transform(values, analysis.base_tokens)
            for language in resource.languages if f.type == "multilang" else ():
                mine = F.array_contains(resource.language_path, language)
                for name, every in (("tok", True), ("base", False)):
                    out[f"{name}_{language}__{f.path}"] = F.when(mine, F.transform(values, _speaker(language, every)))
        if f.text and f.plain or f.type.startswith("keyword_"):
            out[f"norm__{f.path}"] = F.transform(c, partial(analysis.normalised, f.type)) if f.many else analysis.normalised(f.type, c)
    return df.withColumns(out)


def _speaker(language: str, every: bool):
    return lambda x: analysis.language_tokens(language, x, every)


def write(df: DataFrame, resource: Resource, path: str, parts: int | None = None) -> None:
    """Store ``df`` prepared, dealt by key range and sorted, so that keys and prefixes prune files by their statistics."""
    rows = prepared(df, resource)
    rows = rows.repartitionByRange(parts, resource.key) if parts else rows.repartitionByRange(resource.key)
    rows.sortWithinPartitions(resource.key).write.mode("overwrite").parquet(path)


# the inverted index: term, field, key, tf, length (tokens of the field in the document), positions

K1, B = 1.2, 0.75  # fixed values: the usual parameters of BM25


def _analysed(df: DataFrame, resource: Resource) -> DataFrame:
    """key, field, base, joined: a row for each text field of a document, with the tokens of each value and the joined ones of all."""
    each = []
    for f in resource.fields:
        if f.text and f.path in df.columns:
            values = F.col(f.path) if f.many else F.array(f.path)
            each.append(F.struct(F.lit(f.path).alias("field"), F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.coalesce(analysis.read(v), F.lit(""))).alias("values")))
    rows = df.select(F.col(resource.key).alias("key"), F.explode(F.array(*each)).alias("f")).select("key", "f.field", "f.values")
    return rows.select("key", "field", F.transform("values", analysis.parts).alias("base"), F.flatten(F.transform("values", analysis.joined)).alias("joined"))


def postings(df: DataFrame, resource: Resource, bounds: tuple | None = None) -> DataFrame:
    """One row for each term, text field and document that has it, with its positions among the field's tokens in text order; each value
    of a field has positions of its own.  Joined parts of words count, but have no position.

    Documents are dealt by key once; a document's tokens are grouped in its task, many documents at once.  With ``bounds``, terms and
    keys that divide the rows, documents are dealt to as many tasks as there are ranges, and ``part`` is how many bounds a row has below it."""
    key = df.schema[resource.key].dataType.simpleString()
    schema = f"term string, field string, key {key}, tf long, length long, positions array<long>{', part int' if bounds else ''}"
    dealt = df.repartition(F.col(resource.key)) if bounds is None else df.repartition(len(bounds[0]) + 1, F.col(resource.key))
    return _analysed(dealt, resource).mapInArrow(partial(grouping.grouped, bounds=bounds), schema)


#: Documents and postings that bounds of files are estimated from, and postings that a file should have.
SAMPLED, SAMPLED_POSTINGS, FILE = 1000, 100_000, 1_000_000


def _bounds(df: DataFrame, resource: Resource, parts: int | None) -> tuple:
    """Terms and keys that divide all postings into about equal ranges, estimated from those of some documents: where files end, and nothing
    else, depends on it."""
    every = df.count()
    share = min(1.0, SAMPLED / max(every, 1))
    some = postings(df.sample(share, 1), resource).select("term", "key")
    n = some.count()
    expected = n / share
    parts = parts or max(min(df.sparkSession.sparkContext.defaultParallelism, math.ceil(expected / 50_000)), math.ceil(expected / FILE), 1)
    rows = sorted(map(tuple, some.sample(min(1.0, SAMPLED_POSTINGS / max(n, 1)), 1).dropna().collect()))
    found = [rows[len(rows) * i // parts] for i in range(1, parts)] if rows else []
    return [r[0] for r in found], [r[1] for r in found]


def lengths(df: DataFrame, resource: Resource) -> DataFrame:
    """field, n_docs, n_tokens of each text field: documents with at least one token, and tokens of all."""
    n = F.size("joined") + F.aggregate("base", F.lit(0), lambda n, v: n + F.size(v))
    rows = _analysed(df, resource).select("field", n.cast("long").alias("n")).where("n > 0")
    return rows.groupBy("field").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("n_tokens"))


def _worded(df: DataFrame, resource: Resource) -> DataFrame:
    """field, n_docs of each text field, found without splitting or folding a text: folding makes no letters and takes none away."""
    test = lambda v: F.rlike(v, F.lit(analysis.WORDED))
    fields = [f for f in resource.fields if f.text and f.path in df.columns]
    each = F.array(*[F.when(F.exists(f.path, test) if f.many else test(F.col(f.path)), F.lit(f.path)) for f in fields])
    return df.select(F.explode(F.array_compact(each)).alias("field")).groupBy("field").agg(F.count(F.lit(1)).alias("n_docs"))


@dataclass(frozen=True)
class Inverted:
    """Postings and lengths, stored or not.  A search for words reads their postings only."""

    postings: DataFrame
    lengths: DataFrame
    source: tuple[DataFrame, Resource] | None = None

    @classmethod
    def of(cls, df: DataFrame, resource: Resource) -> Inverted:
        return cls(postings(df, resource), lengths(df, resource), (df, resource))

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Inverted:
        return cls(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/lengths"))

    def write(self, path: str, parts: int | None = None) -> None:
        """Postings are dealt by range of term and key and sorted, so a term's rows are few row groups of few files, and a frequent term many tasks.

        Postings of documents are made once: the ranges follow from a sample of documents, not from a first run over all."""
        if self.source is None:
            rows = self.postings.repartitionByRange(parts, "term", "key") if parts else self.postings.repartitionByRange("term", "key")
        else:
            bounds = _bounds(*self.source, parts)
            rows = postings(*self.source, bounds).repartitionById(len(bounds[0]) + 1, F.col("part")).drop("part")
        rows.sortWithinPartitions("term", "field", "key").write.mode("overwrite").parquet(f"{path}/postings")
        found = self.lengths
        if self.source is not None:  # what the postings say need not be counted in the texts again
            tokens = self.postings.sparkSession.read.parquet(f"{path}/postings").groupBy("field").agg(F.sum("tf").alias("n_tokens"))
            found = _worded(*self.source).join(tokens, "field")
        found.coalesce(1).write.mode("overwrite").parquet(f"{path}/lengths")

    def hits(self, text: str, fields: list[str], every: bool = True) -> DataFrame:
        """key, score: documents with every word of ``text`` in one field or another (or any word), by BM25 summed over words and fields.

        How many documents have a word is counted on the postings read: at most words times fields rows, sent to all tasks."""
        words = list(dict.fromkeys(analysis.text_tokens(text)))
        rows = self.postings.where(F.col("term").isin(*words) & F.col("field").isin(*fields))
        known = rows.groupBy("term", "field").agg(F.count(F.lit(1)).alias("df")).join(F.broadcast(self.lengths), "field")
        tf, df, n = F.col("tf"), F.col("df"), F.col("n_docs")
        idf = F.log(1 + (n - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * F.col("length") * n / F.col("n_tokens"))
        found = rows.join(F.broadcast(known), ["term", "field"]).groupBy("key").agg(F.sum(idf * tf / (tf + norm)).alias("score"), F.count_distinct("term").alias("words"))
        return found.where(F.col("words") == len(words)).drop("words") if every else found.drop("words")

    def having(self, words: list[str], fields: list[str], every: bool = True) -> DataFrame:
        """key: documents with every word (or any) in one of the fields or another."""
        rows = self.postings.where(F.col("term").isin(*words) & F.col("field").isin(*fields))
        if not every or len(words) == 1:
            return rows.select("key").distinct()
        return rows.groupBy("key").agg(F.count_distinct("term").alias("words")).where(F.col("words") == len(words)).select("key")

    def phrase(self, text: str, fields: list[str]) -> DataFrame:
        """key: documents in which the words of ``text`` stand one behind the other in a value of a field: the words' positions, moved back
        by their place in the phrase, have one in common."""
        words = analysis.text_tokens(text)
        one = list(dict.fromkeys(words))
        rows = self.postings.where(F.col("term").isin(*one) & F.col("field").isin(*fields) & (F.size("positions") > 0))
        if len(words) == 1:
            return rows.select("key").distinct()
        places = [F.flatten(F.collect_list(F.when(F.col("term") == w, F.col("positions")))).alias(f"__{i}") for i, w in enumerate(one)]
        both = rows.groupBy("field", "key", "length").agg(*places)
        at = lambda w: F.col(f"__{one.index(w)}")
        starts = at(words[0])
        for i, word in enumerate(words[1:], 1):
            starts = F.array_intersect(starts, _moved(at(word), i))
        return both.where(F.size(starts) > 0).select("key").distinct()

    def top(self, text: str, fields: list[str], limit: int = 100, every: bool = True) -> DataFrame:
        """The best hits, equal scores by key."""
        return self.hits(text, fields, every).orderBy(F.desc("score"), "key").limit(limit)


def _moved(positions, by: int):
    return F.transform(positions, lambda p: p - by)


# three-letter postings: gram, field, key

EDGES = ("\x02", "\x03")


@dataclass(frozen=True)
class Grams:
    """Postings of the runs of three characters of normalised values, a mark at each end: what a pattern with wildcards has to contain."""

    postings: DataFrame
    fields: tuple[str, ...]

    @classmethod
    def of(cls, df: DataFrame, resource: Resource, fields: tuple[str, ...]) -> Grams:
        reader, each = Reader(df.columns), []
        for path in fields:
            f = resource.get(path)
            values = reader.norm(f) if f.many else F.array(reader.norm(f))
            marked = F.transform(F.array_compact(values), lambda v: F.concat(F.lit(EDGES[0]), v, F.lit(EDGES[1])))
            cut = F.transform(F.filter(marked, lambda v: F.length(v) > 2), lambda v: F.transform(F.sequence(F.lit(1), F.length(v) - 2), lambda i: F.substring(v, i, F.lit(3))))
            each.append(F.struct(F.lit(path).alias("field"), F.coalesce(F.array_distinct(F.flatten(cut)), F.array().cast("array<string>")).alias("grams")))
        rows = df.select(F.col(resource.key).alias("key"), F.explode(F.array(*each)).alias("f"))
        return cls(rows.select(F.explode("f.grams").alias("gram"), "f.field", "key"), fields)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Grams:
        rows = spark.read.parquet(path)
        return cls(rows, tuple(sorted(r[0] for r in rows.select("field").distinct().collect())))

    def write(self, path: str, parts: int | None = None) -> None:
        rows = self.postings.repartitionByRange(parts, "gram", "key") if parts else self.postings.repartitionByRange("gram", "key")
        rows.sortWithinPartitions("gram", "field", "key").write.mode("overwrite").parquet(path)

    def candidates(self, match: Match) -> DataFrame | None:
        """key: documents that may match a wildcard condition; None if its pattern has too little text, or a field no postings."""
        found = []
        for f in {f.path: f for f in match.fields}.values():
            grams = pattern_grams(analysis.normalised_text(f.type, match.value))
            if not grams or f.path not in self.fields:
                return None
            rows = self.postings.where(F.col("gram").isin(*grams) & (F.col("field") == f.path))
            found.append(rows.groupBy("key").agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(grams)).select("key"))
        return reduce(DataFrame.unionAll, found).distinct() if found else None


def pattern_grams(pattern: str) -> list[str]:
    """Runs of three characters that every value of a wildcard pattern contains."""
    pieces = re.split(r"[*?]", f"{EDGES[0]}{pattern}{EDGES[1]}")
    return sorted({p[i : i + 3] for p in pieces for i in range(len(p) - 2)})


def filtered(df: DataFrame, node, resource: Resource, inverted: Inverted | None = None, grams: Grams | None = None) -> DataFrame:
    """Rows that match.  Conjuncts on words and phrases, and their negations, are found in the inverted index, those with wildcards are
    narrowed by three-letter postings; whatever else there is, is asked of the rows that these leave."""
    known = {r[0] for r in inverted.lengths.select("field").collect()} if inverted is not None else set()  # a row for each field
    rest, joins = [], []
    for part in node.parts if isinstance(node, And) else (node,):
        inner, how = (part.part, "left_anti") if isinstance(part, Not) else (part, "left_semi")
        keys = _keys(inner, resource, inverted, known) if isinstance(inner, Match) else None
        if keys is None:
            rest.append(part)
            if how == "left_semi" and grams is not None and isinstance(inner, Match) and inner.op == "wild" and (keys := grams.candidates(inner)) is not None:
                joins.append((keys, how))
        else:
            joins.append((keys, how))
    for keys, how in joins:
        df = df.join(keys.withColumnRenamed("key", "__key"), df[resource.key] == F.col("__key"), how)
    return df.where(to_column(And(tuple(rest)), resource, df.columns)) if rest else df


def _keys(m: Match, resource: Resource, inverted: Inverted | None, known: set[str]) -> DataFrame | None:
    """Keys of the documents that match a condition on full-text fields alone; None if the index cannot tell."""
    fields = [f.path for f in m.fields]
    if inverted is None or m.op not in ("all", "any", "phrase") or not fields or not all(f.text and f.path in known for f in m.fields):
        return None
    words = list(dict.fromkeys(analysis.text_tokens(m.value)))
    if not words or resource.languages and any(f.type == "multilang" for f in m.fields):
        return None
    return inverted.phrase(m.value, fields) if m.op == "phrase" else inverted.having(words, fields, m.op == "all")


def ranked(found: DataFrame, query: list[tuple[str, list[str], bool]], inverted: Inverted, key: str) -> DataFrame:
    """``found`` with ``score``: the sum over the full-text conditions (text, fields, every) of a query; 0 where none adds to it."""
    scores = [inverted.hits(text, fields, every) for text, fields, every in query]
    if not scores:
        return found.withColumn("score", F.lit(0.0))
    total = reduce(DataFrame.unionAll, scores).groupBy(F.col("key").alias("__key")).agg(F.sum("score").alias("score"))
    return found.join(total, found[key] == F.col("__key"), "left").drop("__key").withColumn("score", F.coalesce("score", F.lit(0.0)))


def scoring(node) -> list[tuple[str, list[str], bool]]:
    """Full-text conditions of a bound query that add to a score: (text, fields, whether every word is needed); negated ones add nothing."""
    if isinstance(node, Match):
        fields = [f.path for f in node.fields if f.text]
        return [(node.value, fields, node.op != "any")] if fields and node.op in ("all", "any", "phrase") else []
    if isinstance(node, Not):
        return []
    return [s for p in node.parts for s in scoring(p)]
