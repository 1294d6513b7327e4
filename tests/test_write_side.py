"""Functions, child resources, documents, upserts and streaming."""

import datetime
import json
import uuid

import pytest
from pyspark.sql import functions as F

from shelfspark.functions import identifiers, linked_data, records
from shelfspark.functions.shelving import shelving_key, shelving_orders
from shelfspark.operators import tables
from shelfspark.plans import documents, reindex
from shelfspark.plans.library import RESOURCES
from shelfspark.sources import events
from shelfspark.streaming import pipeline, progress


def value(spark, c):
    return spark.range(1).select(c.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "raw,want",
    [("1 86197 271-7 (paper)", ["1861972717", "9781861972712", "(paper)"]), ("047144250X", ["047144250x"]), ("978 0 471 44250 9 (alk. paper)", ["9780471442509", "(alk. paper)"]), ("1 2 3 4 5", ["12345"]), ("  ", []), ("9780471442509", ["9780471442509"])],
)
def test_isbn(spark, raw, want):
    assert value(spark, identifiers.isbn(F.lit(raw))) == want == identifiers.isbn_values(raw)


@pytest.mark.parametrize("raw,want", [("(OCoLC)ocm842877062", "842877062"), ("ocm0012345 800630", "12345-800630"), ("none", None), ("123*", "123*")])
def test_oclc(spark, raw, want):
    assert value(spark, identifiers.oclc(F.lit(raw))) == want == identifiers.oclc_term(raw)


@pytest.mark.parametrize("raw,kind,want", [("HD1691 .I5 1967", "LC", "HD 41691 I5 41967"), ("302.55", "DEWEY", "3302.55"), ("WB 102.5 B62 2018", "NLM", "WB 3102.5 B62 42018"), (" hd1691 ^I5 1967 ", "DEFAULT", "HD1691 ^I5 1967"), ("A 13.28:W 63", "SUDOC", "1A 3213 01 3228 02 1W 3263"), ("none", "LC", None)])
def test_shelving(spark, raw, kind, want):
    assert value(spark, shelving_key(F.lit(raw), kind)) == want


def test_sudoc_order(spark):
    order = ["A 1.1:", "A 1.2:F 76", "A 1.2:W 63/4", "A 1.10:", "A 13.28:997", "A 13.28:1000", "A 13.28:10000", "A 13.28:F 76", "B 1.1:"]
    keys = [value(spark, shelving_key(F.lit(x), "SUDOC")) for x in order]
    assert keys[0] < keys[1] < keys[2] < keys[3] and keys[8] == max(keys)
    assert value(spark, shelving_key(F.lit("A13.28:W63"), "SUDOC")) == value(spark, shelving_key(F.lit("A 13.28:W 63"), "SUDOC"))


def test_record_fields(spark):
    df = spark.sql("""select array(struct('a' as name, false as primary), struct('b' as name, true as primary)) as c, array(' x ', '', 'x', 'y') as t,
      array(struct('n1' as note, true as staffOnly), struct('n2' as note, cast(null as boolean) as staffOnly)) as n""")
    r = df.select(records.sort_contributor(F.col("c")).alias("c"), records.tags(F.col("t")).alias("t"), records.public_notes(F.col("n")).alias("n"), records.date1(F.lit("19u5")).alias("d"), records.full_call_number(F.lit(" p "), F.lit(""), F.lit("s")).alias("f")).first()
    assert (r.c, r.t, r.n, r.d, r.f) == ("b", ["x", "y"], ["n2"], 1905, "p s")
    assert value(spark, records.sha_id(F.lit("a"), F.lit(None))) == value(spark, F.sha1(F.lit("a|").cast("binary")))
    assert records.call_number_term("QA 76.5") == "qa765*" and records.classification_term("*a-1*") == "*a1*" and records.classification_term("-") == "*"


def test_ranges_cover_all_keys():
    assert tables.hex_ranges(1)[0][0] == "0" * 40 and tables.hex_ranges(1)[-1][1] == "x" * 40 and len(tables.hex_ranges()) == 4096
    ranges = tables.uuid_ranges(7)
    assert ranges[0][0] == uuid.UUID(int=0) and ranges[-1][1] == uuid.UUID(int=2**128 - 1)
    assert all(b.int + 1 == a.int for (_, b), (a, _) in zip(ranges, ranges[1:], strict=False))


def test_authorities_by_heading(spark):
    df = spark.createDataFrame([("a", "Name", ["s1", "s2"]), ("b", None, [])], "id string, personalName string, sftPersonalName array<string>")
    got = {r.document_id: (r.heading_type, r.auth_ref_type, r.heading_ref) for r in documents.authority_headings(df).collect()}
    assert got == {"personalName0_a": ("personalName", "Authorized", "Name"), "sftPersonalName0_a": ("personalName", "Reference", "s1"), "sftPersonalName1_a": ("personalName", "Reference", "s2"), "other0_b": ("Other", None, None)}


def test_events(spark):
    rows = [("k1", "x.inventory.item", json.dumps({"id": "e", "type": "CREATE", "tenant": "t", "new": json.dumps({"id": "i1"})})), ("k2", "x.authorities.authority", json.dumps({"id": "e", "type": "DELETE", "deleteEventSubType": "HARD_DELETE"})), ("k3", "x.unknown", json.dumps({"type": "DELETE_ALL"}))]
    df = spark.createDataFrame(rows, "key string, topic string, value string").withColumn("timestamp", F.current_timestamp())
    parsed = events.parsed(df)
    assert {(r.key, r.resource, r.record_id) for r in parsed.collect()} == {("k1", "item", "i1"), ("k2", "authority", "k2"), ("k3", None, "k3")}
    assert [r.key for r in events.accepted(parsed).collect()] == ["k1"]


def test_ownership_moves_keep_both(spark):
    rows = [("a", 1, "CREATE", "t1"), ("a", 2, "DELETE", "t2"), ("b", 1, "CREATE", "t1"), ("b", 2, "DELETE", "t1"), ("c", 1, "UPDATE", "t1"), ("c", 3, "UPDATE", "t2")]
    df = spark.createDataFrame(rows, "key string, ts long, type string, tenant string")
    assert sorted((r.key, r.ts) for r in tables.last_events(df, tenant="tenant").collect()) == [("a", 1), ("a", 2), ("b", 2), ("c", 3)]


def test_stream_equals_batch(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    sent = [{"key": f"k{i % 7}", "type": "DELETE" if i % 5 == 4 else "UPDATE", "ts": f"2024-01-01T00:{i:02d}:00Z", "new": str(i)} for i in range(40)]
    for n in range(4):
        (folder / f"{n}.json").write_text("\n".join(json.dumps(e) for e in sent[n::4]) + "\n\n")
    table = tables.Versions(spark, f"{tmp_path}/state")
    stream = events.files(spark, str(folder), 1)
    for _ in range(2):  # a second start finds nothing new
        pipeline.run(stream, table, f"{tmp_path}/check", ["key"]).awaitTermination(120)
    last = {e["key"]: e for e in sorted(sent, key=lambda e: e["ts"])}
    want = {k: e["new"] for k, e in last.items() if e["type"] != "DELETE"}
    got = {r.key: r.new for r in table.read().collect()}
    late = {k for k, e in last.items() if e["type"] == "DELETE"}
    assert {k: v for k, v in got.items() if k not in late} == want


def test_versions_and_staging(spark, tmp_path):
    v = tables.Versions(spark, f"{tmp_path}/t")
    assert v.read() is None
    v.merge(spark.createDataFrame([(1, "a"), (2, "b")], "id long, x string"), ["id"])
    v.merge(spark.createDataFrame([(2, "c"), (3, "d")], "id long, x string"), ["id"])
    assert sorted(map(tuple, v.read().collect())) == [(1, "a"), (2, "c"), (3, "d")]
    base = spark.sql("select 1L as id, 'old' as x, timestamp'2024-01-01' as last_updated_date")
    staging = spark.sql("select * from values (1L, 'n1', 1), (1L, 'n2', 2), (4L, 'n3', 1) as t(id, x, inserted_at)")
    assert sorted((r.id, r.x, r.last_updated_date.year) for r in reindex.staged(base, staging, ["id"]).collect()) == [(1, "n2", 2000), (4, "n3", 2000)]
    s = reindex.Status()
    for t in reindex.MERGE_TYPES:
        s.start(t, "MERGE", 2)
        assert not s.merge_complete()
        s.processed(t, 2)
    assert s.merge_complete()


def test_projection(spark):
    df = spark.createDataFrame([("1", None, "x")], "id string, sourceFileId string, junk string")
    assert documents.projected(df, RESOURCES["authority"]).columns == ["id", "sourceFileId"]
    assert documents.unplained(df.withColumn("plain_junk", F.lit("y"))).first()["junk"] == "y"


def test_linked_data_fields(spark):
    df = spark.sql("""select array(struct('a' as value), struct(' ' as value), struct('a' as value)) as titles,
      array(struct(array(struct('b' as value)) as titles), struct(cast(null as array<struct<value:string>>) as titles)) as instances,
      array(struct('n 79-1' as value, 'LCCN' as type), struct('1 2 3' as value, 'ISBN' as type)) as ids""")
    r = df.select(
        linked_data.work_and_instances(F.col("titles"), F.col("instances"), "titles", "value").alias("t"),
        linked_data.sort_title(F.col("titles")).alias("s"),
        linked_data.lccns(F.col("ids")).alias("l"),
        linked_data.isbns(F.col("ids")).alias("i"),
        linked_data.identifier_values(F.col("ids")).alias("v"),
        *[c.alias(n) for n, c in shelving_orders(F.lit("QA76 .B5")).items()],
    ).first()
    assert (r.t, r.s, r.l, r.i, r.v) == (["a", "b"], "a", ["n79-1"], ["123"], ["n79-1", "123"])
    assert r.lcShelvingOrder == "QA 276 B5" and r.deweyShelvingOrder is None


def _batches(spark, folder, batches):
    folder.mkdir(exist_ok=True)
    for name, rows in batches.items():
        (folder / f"{name}.json").write_text("\n".join(json.dumps(r) for r in rows) + "\n")
    return events.files(spark, str(folder), 1)


def test_a_late_event_does_not_bring_a_deleted_record_back(spark, tmp_path):
    at = lambda m: f"2024-01-01T00:{m:02d}:00Z"
    table = tables.Versions(spark, f"{tmp_path}/state", buckets=4)
    sent = {"0": [{"key": "k", "type": "CREATE", "ts": at(1), "new": "a"}, {"key": "m", "type": "CREATE", "ts": at(1), "new": "x"}], "1": [{"key": "k", "type": "DELETE", "ts": at(5)}], "2": [{"key": "k", "type": "UPDATE", "ts": at(3), "new": "b"}]}
    for name in sent:
        stream = _batches(spark, tmp_path / "in", {name: sent[name]})
        pipeline.run(stream, table, f"{tmp_path}/check", ["key"]).awaitTermination(120)
    assert [(r.key, r.new) for r in pipeline.live(table.read()).collect()] == [("m", "x")]
    assert {r.key: r.type for r in table.read().collect()} == {"k": "DELETE", "m": "CREATE"}
    log = table.log()
    assert log["batches"] == {f"{tmp_path}/check": 2} and log["version"] == 2 and len(set(log["parts"].values())) == 2
    assert table.prune() == 1 and table.read().count() == 2
    kept = pipeline.merged(table.read(), spark.createDataFrame([("z", "CREATE")], "key string, type string").withColumn("ts", F.lit("2024-02-01").cast("timestamp")).join(table.read().limit(0).drop("key", "type", "ts"), how="left"), ["key"], keep="7 days")
    assert {r.key for r in kept.collect()} == {"m", "z"}


def test_a_bad_record_does_not_stop_the_stream(spark, tmp_path):
    sent = [{"key": f"k{i}", "type": "CREATE", "ts": "2024-01-01T00:00:00Z", "new": "x" if i == 5 else str(i)} for i in range(9)]
    table = tables.Versions(spark, f"{tmp_path}/state")
    prepare = lambda df: df.withColumn("new", F.col("new").cast("int").cast("string"))
    pipeline.run(_batches(spark, tmp_path / "in", {"0": sent}), table, f"{tmp_path}/check", ["key"], prepare=prepare, dead_letters=f"{tmp_path}/dead").awaitTermination(240)
    assert sorted(r.key for r in table.read().collect()) == [f"k{i}" for i in range(9) if i != 5]
    (dead,) = spark.read.json(f"{tmp_path}/dead").collect()
    assert json.loads(dead.row)["key"] == "k5" and "CAST_INVALID_INPUT" in dead.error


def test_progress_is_fenced(spark, tmp_path):
    now = [1000.0]
    p = progress.Progress(spark, f"{tmp_path}/p", stale=600, clock=lambda: now[0])
    one = p.acquire("item")
    assert one == 1 and p.acquire("item") is None and p.acquire("instance") == 1
    now[0] += 601
    two = p.acquire("item")
    stamp = datetime.datetime(2024, 5, 1, tzinfo=datetime.timezone.utc)
    assert two == 2 and not p.advance("item", one, stamp) and p.mark("item") == progress.BEGINNING
    assert p.advance("item", two, stamp) and p.mark("item") == stamp
    p.release("item", two)
    assert p.acquire("item") == 3


def test_scheduled_indexing_reads_changes_once(spark, tmp_path):
    rows = [("a", "2024-01-01", False), ("b", "2024-01-02", True), ("c", "2024-01-03", None)]
    make = lambda rows: spark.createDataFrame(rows, "id string, d string, is_deleted boolean").select("id", F.col("d").cast("timestamp").alias("last_updated_date"), "is_deleted")
    seen, gone = [], []
    kinds = lambda df: {"subject": (df, lambda x: seen.append(("subject", {r.id for r in x.collect()})), lambda x: gone.append({r.id for r in x.collect()})), "instance": (df.limit(0), seen.append, gone.append)}
    p = progress.Progress(spark, f"{tmp_path}/p")
    assert progress.scheduled(p, kinds(make(rows))) == {"instance": 0, "subject": 3}
    assert seen == [("subject", {"a", "c"})] and gone == [{"b"}]
    assert progress.scheduled(p, kinds(make(rows + [("d", "2024-02-01", None)])))["subject"] == 1 and seen[-1] == ("subject", {"d"})

    def fails(_):
        raise ValueError

    with pytest.raises(ValueError):
        progress.index_changes(p, "subject", make([("e", "2024-03-01", None)]), fails, fails)
    assert progress.index_changes(p, "subject", make([("e", "2024-03-01", None)]), lambda x: x.count(), lambda x: x.count()) == 1
