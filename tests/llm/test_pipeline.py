"""The pipeline's stages on one small table, each judged on its own input."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from shelfspark.llm import store


def test_stages_take_effect(spark, tmp_path):
    rng = random.Random(7)
    item = " ".join(f"i{rng.randrange(90)}" for _ in range(40))
    texts, labels = [], []
    for i in range(400):
        w = [f"w{rng.randrange(900)}" for _ in range(rng.randint(30, 90))]
        if i % 8 == 0:
            w[3], w[9] = "horrid", "nasty"
        texts.append(" ".join(w))
        labels.append((i, 1, int(i % 8 == 0)))
    texts[1] = texts[2]
    texts[5] = texts[3] + " tail"
    texts[7] += " " + item
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t), "more") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long, extra string")
    sf = str(tmp_path)
    docs.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = store.stored(stage(spark, docs, sf), name)
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        if name != "token_ids":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "extra"]
    toxic = {i for i, _, y in labels if y}
    assert not kept["toxicity"] & toxic and kept["toxicity"] == set(range(400)) - toxic
    assert kept["near_dedup"] == kept["toxicity"] - {2, 5}
    assert kept["decontamination"] == kept["near_dedup"] - {7}
    assert kept["source_mix"] <= kept["decontamination"] and kept["token_ids"] == kept["source_mix"]
    assert corpus_pipeline.run(spark, sf).count() == docs.count()


def test_repeated_ids_keep_distinct_texts(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g", "en", "s", 13), (1, "a b c d e f g", "en", "s", 13), (1, "other words that are not those at all", "en", "s", 37), (2, "a b c d e f g", "en", "s", 13), (None, "x y z", None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted((str(r.doc_id), r.text[0]) for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()) == [("1", "a"), ("1", "o"), ("None", "x")]


NAMES = ["__gone", "__order", "__t", "__d", "__h", "__pieces", "__toxicity", "__ID", "component", "text_hash", "score", "label", "hash", "key"]


def test_stages_take_odd_rows_and_names(spark, odd, none, tmp_path):
    """Nulls, empties, a very long text, ties, repeated rows, an empty table, and columns named as the operators' own."""
    sf = str(tmp_path)
    spark.createDataFrame([(i, 1, int(i % 7 == 0)) for i in range(60)] + [(None, None, None), (3, 0, None)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(0, "a benchmark item of some words that no document has"), (None, None), (1, "")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    long = odd.limit(1).withColumn("doc_id", F.lit(700).cast("long")).withColumn("text", F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(120_000)), lambda i: F.concat(F.lit("v"), (i * 7919 % 100_003).cast("string")))))
    wide = odd.unionByName(long)
    for n in NAMES:
        wide, none = wide.withColumn(n, F.lit(n)), none.withColumn(n, F.lit(n))
    columns = wide.columns
    for docs in (wide, none):
        for name, stage in corpus_pipeline.STAGES:
            docs = store.stored(stage(spark, docs, sf), name)
            if name != "token_ids":
                assert docs.columns == columns
                assert docs.where(" or ".join(f"{n} <> '{n}'" for n in NAMES)).count() == 0
            if name in ("toxicity", "decontamination") and docs.count():
                assert docs.where("doc_id is null").count() == 1 and docs.where("doc_id = 700").count() == 1
    assert docs.count() == 0


def test_odd_rows_are_kept_as_stated(spark, odd, tmp_path):
    """What carries no information is no duplicate, is not toxic and holds no item; the mix alone leaves out what has no words."""
    sf = str(tmp_path)
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(0, "nothing of this is anywhere here")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    empty = odd.where("doc_id in (4, 5, 6)")
    for name, stage in corpus_pipeline.STAGES[:3]:
        assert stage(spark, empty, sf).count() == 3, name
    assert corpus_pipeline.mix_sources(spark, empty, sf).count() == 0
