"""Children kept up to date by differences equal a rebuild, whatever happens in between."""

import random

import pytest

from shelfspark.plans import children, incremental

SCHEMA = """id string, tenant_id string, shared boolean, deleted boolean, subjects array<struct<value string, authorityId string, sourceId string, typeId string>>,
 contributors array<struct<name string, contributorNameTypeId string, authorityId string, contributorTypeId string>>, classifications array<struct<classificationNumber string, classificationTypeId string>>"""
COUNTED = {"subject": ("subjects", {}), "contributor": ("contributors", {"distinct_instances": True, "types": "type_id"}), "classification": ("classifications", {})}


def instance(rng, i, deleted=False):
    some = lambda make, n=3: [make() for _ in range(rng.randint(0, n))] if rng.random() < 0.9 else None
    word = lambda: rng.choice(["hot", "hot", *(f"w{j}" for j in range(12)), "", "A b"])
    return (
        str(i), f"t{i % 3}", rng.random() < 0.3, deleted, some(lambda: (word(), rng.choice([None, "a1"]), None, "x")),
        some(lambda: (word(), "n", None, rng.choice([None, "", "c1", "c2"]))), some(lambda: (word(), rng.choice(["lc", None]))),
    )


def rebuilt(spark, state, kind):
    df = spark.createDataFrame([r for r in state.values() if not r[3]], SCHEMA)
    name, how = COUNTED[kind]
    entities, relations = getattr(children, name)(df)
    return rows_of(children.counted(relations, incremental.KINDS[kind].child, entities, **how))


def rows_of(df):
    return sorted(str(r.asDict(True)) for r in df.select(*sorted(df.columns)).collect())


@pytest.mark.parametrize("kind", ["subject", "contributor", "classification"])
def test_random_batches_equal_a_rebuild(spark, tmp_path, kind):
    rng, state, number = random.Random(kind), {}, 0
    table = incremental.Children(spark, f"file://{tmp_path}", kind, buckets=4)
    batches = 20 if kind == "contributor" else 5
    for number in range(batches):
        ids = rng.sample(range(30), rng.randint(1, 8))
        batch = {i: instance(rng, i, rng.random() < 0.3) for i in ids}
        before = {r["id"] for r in table.documents().select("id").collect()} if number else set()
        state |= batch
        touched = table.apply(spark.createDataFrame(list(batch.values()), SCHEMA), number).collect()
        if number % 4 == 0 or number == batches - 1:
            after = rows_of(table.documents())
            assert after == rebuilt(spark, state, kind)
            now = {r["id"] for r in table.documents().select("id").collect()}
            assert {r["id"] for r in touched if r["instances"] is None} >= before - now and not {r["id"] for r in touched if r["instances"] is not None} - now


def test_a_run_that_ends_anywhere_may_be_repeated(spark, tmp_path, monkeypatch):
    rng = random.Random(1)
    first = {i: instance(rng, i) for i in range(12)}
    second = {i: instance(rng, i, i % 3 == 0) for i in range(4, 16)}
    for step in ("counted", "entities", "relations"):
        table = incremental.Children(spark, f"file://{tmp_path}/{step}", "contributor", buckets=3)
        table.apply(spark.createDataFrame(list(first.values()), SCHEMA), 0)
        batch = spark.createDataFrame(list(second.values()), SCHEMA)
        with monkeypatch.context() as m:
            m.setattr(getattr(table, step), "merge", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("ended")))
            with pytest.raises(RuntimeError):
                table.apply(batch, 1)
        again = incremental.Children(spark, f"file://{tmp_path}/{step}", "contributor", buckets=3)
        again.apply(batch, 1)
        again.apply(batch, 1)
        assert rows_of(again.documents()) == rebuilt(spark, first | second, "contributor")
