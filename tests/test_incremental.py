"""Snapshot tables, incremental versions and continuous replay: what comes in parts equals one batch run."""

import datetime
import threading
import time

import pytest
from pyspark.sql import functions as F

from lexstrata.operators import incremental, replay, structure
from lexstrata.operators.extract import extract_amendments
from lexstrata.sources.tables import Conflict, SnapshotTable
from lexstrata.streaming import replay as continuous

TEXT = """DENEME YÖNETMELİĞİ
MADDE 1 – (1) Süre on gündür.
a) Birinci,
b) İkinci,
MADDE 2 – (1) Karar yazılıdır.
MADDE 3 – (1) Tutar bindir."""
HEAD = "BAŞLIK\nMADDE 1 – 1/1/2000 tarihli ve 24000 sayılı Resmî Gazete’de yayımlanan Deneme Yönetmeliğin "
AMENDING = [
    (1, "1 inci maddesinin birinci fıkrasında yer alan “on” ibaresi “yirmi” şeklinde değiştirilmiştir."),
    (2, "2 nci maddesine aşağıdaki fıkra eklenmiştir.\n“(2) Karar bildirilir.”"),
    (3, "1 inci maddesinin birinci fıkrasında yer alan “yirmi” ibaresi “otuz” şeklinde değiştirilmiştir."),
    (4, "aşağıdaki 2/A maddesi eklenmiştir.\n“MADDE 2/A – (1) Yeni madde.”"),
    (5, "1 inci maddesinin birinci fıkrasının (b) bendi yürürlükten kaldırılmıştır."),
]


@pytest.fixture(scope="module")
def units(spark):
    return structure.parse_units(spark.createDataFrame([("s", TEXT), ("t", TEXT)], "doc_id string, text string")).cache()


@pytest.fixture(scope="module")
def records(spark):
    docs = spark.createDataFrame([(f"s/{k}", HEAD + x) for k, x in AMENDING], "doc_id string, text string")
    rows = extract_amendments(docs).withColumns({"source": F.lit("s"), "seq": F.split("doc_id", "/")[1].cast("bigint")})
    return rows.withColumn("date", F.date_add(F.lit("2010-01-01").cast("date"), F.col("seq").cast("int"))).cache()


def versions(df):
    return sorted(((r.source, r.key, r.pos, r.steps, sorted(r.units, key=str), r.titles) for r in df.collect()), key=str)


def test_records_in_any_order_give_the_batch_versions(spark, tmp_path, units, records):
    table = incremental.version_table(spark, f"file://{tmp_path}/v", 4)
    assert table.read().collect() == []
    assert incremental.add_originals(table, units) == 1
    assert table.read().count() == 6 and versions(table.read()) == versions(replay.replay(units, records.limit(0)))
    for n, seqs in enumerate(((1, 2), (4, 5), (3,))):
        before = table.read().select("source", "key", "run")
        incremental.add_records(table, records.where(F.col("seq").isin(*seqs)), f"run{n}")
        folded = {(r.source, r.key) for r in table.read().where(f"run = 'run{n}'").collect()}
        assert folded == {(1, 2): {("s", "1"), ("s", "2")}, (4, 5): {("s", "2/A"), ("s", "1")}, (3,): {("s", "1")}}[seqs]
        assert {(r.source, r.key, r.run) for r in before.collect() if (r.source, r.key) not in folded} <= {(r.source, r.key, r.run) for r in table.read().collect()}
    assert versions(table.read().select(replay.replay(units, records).columns)) == versions(replay.replay(units, records))
    day = datetime.date(2010, 1, 4)
    assert sorted(map(str, replay.as_of(table.read(), day).collect())) == sorted(map(str, replay.as_of(replay.replay(units, records), day).collect()))
    incremental.add_records(table, records.where("seq = 3"), "again")
    assert versions(table.read().select(replay.replay(units, records).columns)) == versions(replay.replay(units, records))
    head = table.head()["version"]
    assert incremental.add_records(table, records.where("seq = 99"), "none") == head


def test_a_failed_run_leaves_the_old_snapshot(spark, tmp_path, units, records):
    table = incremental.version_table(spark, f"file://{tmp_path}/v", 4)
    incremental.add_originals(table, units)
    old, head = versions(table.read()), table.head()

    def broken(before, changes):
        return table.replaced(before, changes.select(before.columns)).withColumn("run", F.raise_error(F.lit("lost")).cast("string"))

    with pytest.raises(Exception, match="lost"):
        table.upsert(table.read().limit(2), broken)
    assert table.head() == head and versions(table.read()) == old
    incremental.add_records(table, records, "after")
    assert table.head()["version"] == head["version"] + 1
    table.clean(1)
    assert table.read().count() == 7


ROW = "id string, name string, note string"


def test_writers_at_once_lose_nothing(spark, tmp_path):
    table = SnapshotTable(spark, f"file://{tmp_path}/t", ROW, ["id"], 3)
    table.upsert(spark.createDataFrame([("n", "0", "keep")], ROW))
    failed = []

    def count_up(old, changes):
        more = changes.select("id", F.lit(1).alias("_m")).join(old, "id", "left")
        return table.replaced(old, more.select("id", (F.coalesce(F.col("name").cast("int"), F.lit(0)) + 1).cast("string").alias("name"), "note"))

    def write(k):
        try:
            for j in range(2):
                table.upsert(spark.createDataFrame([("n", None, None), (f"own{k}{j}", None, None)], ROW), count_up)
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed
    got = {r.id: (r.name, r.note) for r in table.read().collect()}
    assert got == {"n": ("6", "keep"), **{f"own{k}{j}": ("1", None) for k in range(3) for j in range(2)}}
    assert table.head()["version"] == 7


def test_snapshot_rules(spark, tmp_path):
    table = SnapshotTable(spark, f"file://{tmp_path}/t", ROW, ["id"], 3)
    make = lambda *x: spark.createDataFrame(list(x), ROW)
    assert table.upsert(make()) == 0 and table.read().collect() == []
    assert table.upsert(make(("a", "1", None), (None, "2", None)), batch=("q", 0)) == 1
    assert table.upsert(make(("a", "9", None)), batch=("q", 0)) == 1
    assert table.upsert(make((None, "3", None)), batch=("q", 1)) == 2
    assert sorted(map(tuple, table.read().collect()), key=str) == [("a", "1", None), (None, "3", None)]
    with pytest.raises(Conflict):
        table.upsert(make(("a", "1", None)), tries=0)


@pytest.fixture(scope="module")
def states(spark, units, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("states") / "s")
    continuous.article_states(units).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", continuous.PROVIDER)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_continuous_replay_with_restarts(spark, tmp_path, units, records, states, rocks):
    table = SnapshotTable(spark, f"file://{tmp_path}/t", replay.RESULT, ["source", "key"], 4)
    start = replay.replay(units, records.limit(0))
    table.upsert(start)
    articles = replay.original_articles(units)
    for seqs in ((1, 2), (4, 5), (3,)):
        before = {(r.source, r.key): r for r in table.read().collect()}
        replay.prepared(records.where(F.col("seq").isin(*seqs)), articles).write.mode("append").parquet(f"{tmp_path}/in")
        continuous.catch_up(spark, f"{tmp_path}/in", states, table, f"{tmp_path}/check")
        changed = {k for k, r in ((((r.source, r.key), r)) for r in table.read().collect()) if before.get(k) != r}
        assert changed == {(1, 2): {("s", "1"), ("s", "2")}, (4, 5): {("s", "2/A"), ("s", "1")}, (3,): {("s", "1")}}[seqs]
    assert versions(table.read()) == versions(replay.replay(units, records))
    # the same files again, as another file: nothing changes
    replay.prepared(records.where("seq = 3"), articles).write.mode("append").parquet(f"{tmp_path}/in")
    continuous.catch_up(spark, f"{tmp_path}/in", states, table, f"{tmp_path}/check")
    assert versions(table.read()) == versions(replay.replay(units, records))


def test_records_wait_for_their_day(spark, tmp_path, units, records, states, rocks):
    table = SnapshotTable(spark, f"file://{tmp_path}/t", replay.RESULT, ["source", "key"], 4)
    rows = replay.prepared(records.where("seq in (1, 3)"), replay.original_articles(units))
    until = datetime.datetime.now() + datetime.timedelta(seconds=30)
    rows.write.parquet(f"{tmp_path}/in")
    due = F.when(F.col("record.seq") == 3, F.lit(until))
    query = continuous.run_replay(spark, f"{tmp_path}/in", states, table, f"{tmp_path}/check", due, "1 second")
    seen = []
    try:
        for _ in range(90):
            time.sleep(1)
            got = [r.steps for r in table.read().collect()]
            n = len(got[0]) if got else 0
            if n and (not seen or seen[-1] != n):
                seen.append(n)
            if n == 2 or query.exception():
                break
    finally:
        query.stop()
    assert query.exception() is None and seen == [1, 2] and datetime.datetime.now() >= until
