"""Streaming: rejects, defaults, repeats, replay of a batch."""

import datetime as dt
import json
import time

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from fleetgauge.schemas import TELEMETRY
from fleetgauge.sources import tables
from fleetgauge.streaming import ingest, live
from fleetgauge.streaming.store import LOG, Position, Run, Store, thinned


def write(folder, name, records):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(r) for r in records))


GOOD = {"satellite_id": "A", "timestamp": "2024-01-01T12:00:00", "battery_pct": 50.0}


def run(spark, inbox, store, checkpoint, *writers):
    records = ingest.stream_ingest(ingest.stream_source_json(spark, str(inbox), files_per_batch=1))
    writer = ingest.on_batch(ingest.store_batch(str(store)), *writers)
    ingest.stream_flush(records, writer, str(checkpoint), available_now=True).awaitTermination()


def test_nothing_is_lost(spark, tmp_path):
    """Late records, repeats in one batch and across batches, and rejects of every kind."""
    inbox, store = tmp_path / "in", tmp_path / "store"
    write(inbox, "1.json", [GOOD, {**GOOD, "timestamp": "2024-01-01T12:01:00", "data_source": "lab"}, GOOD])
    write(inbox, "2.json", [GOOD, {"timestamp": "2024-01-01T00:00:00"}, {"satellite_id": "A"}, {"satellite_id": "A", "timestamp": "x"}])
    write(inbox, "3.json", [{**GOOD, "satellite_id": "B", "timestamp": "2023-06-01T00:00:00"}, {**GOOD, "timestamp": "2024-01-01T11:00:00"}])
    (inbox / "4.json").write_text("{no json")
    run(spark, inbox, store, tmp_path / "checkpoint", ingest.tap_batch(f"{tmp_path}/tap"))
    stored = ingest.read_store(spark, str(store))
    got = sorted((r.satellite_id, r.timestamp.isoformat(), r.data_source) for r in stored.collect())
    assert got == [
        ("A", "2024-01-01T11:00:00", "realtime"), ("A", "2024-01-01T12:00:00", "realtime"), ("A", "2024-01-01T12:01:00", "lab"),
        ("B", "2023-06-01T00:00:00", "realtime"),
    ]
    assert sorted(r.id for r in stored.collect()) == [1, 2, 3, 4]
    rejects = ingest.read_rejects(spark, str(store)).collect()
    assert sorted(r.reject_reason for r in rejects) == ["no satellite", "no time", "time not readable", "unreadable"]
    assert [r.unreadable for r in rejects if r.reject_reason == "unreadable"] == ["{no json"]
    totals = ingest.stream_totals(ingest.stream_stats(spark, str(store))).first()
    assert (totals.received_total, totals.valid_total, totals.accepted_total, totals.repeated_total, totals.rejected_total) == (10, 6, 4, 2, 4)
    assert totals.flushed_batches >= 4
    assert spark.read.json(f"{tmp_path}/tap").selectExpr("sum(count)").first()[0] == 6


def test_a_second_stream_adds_to_the_store(spark, tmp_path):
    store = tmp_path / "store"
    for n, records in enumerate([[GOOD], [GOOD, {**GOOD, "satellite_id": "C"}]]):
        write(tmp_path / f"in{n}", "1.json", records)
        run(spark, tmp_path / f"in{n}", store, tmp_path / f"checkpoint{n}")
    stored = ingest.read_store(spark, str(store))
    assert sorted((r.satellite_id, r.id) for r in stored.collect()) == [("A", 1), ("C", 2)]


def test_repeated_batch_replaces_itself(spark, tmp_path):
    batch = spark.createDataFrame([("A", "2024-01-01T00:00:00")], "satellite_id string, timestamp string")
    other = spark.createDataFrame([("B", "2024-01-01T00:00:00")], "satellite_id string, timestamp string")
    writer = ingest.store_batch(str(tmp_path / "store"))
    writer(batch, 0), writer(batch, 0), writer(other, 1), writer(other, 1)
    stored = ingest.read_store(spark, str(tmp_path / "store"))
    assert sorted((r.satellite_id, r.id) for r in stored.collect()) == [("A", 1), ("B", 2)]


def test_ids_of_a_partition_of_any_size(spark, tmp_path):
    rows = tables.numbered(spark.range(10_000_000, numPartitions=1).selectExpr("id AS n"), str(tmp_path / "coming"), 5)
    assert rows.selectExpr("min(id)", "max(id)", "count(DISTINCT id)").first() == (5, 10_000_004, 10_000_000)


def test_appends_have_ids_of_their_own(spark, tmp_path):
    batch = spark.createDataFrame([("A",), ("B",)], "satellite_id string")
    for _ in range(2):
        tables.write_result_table(batch, "anomaly_records", str(tmp_path / "t"))
        tables.append_telemetry(batch, str(tmp_path / "u"))
    for table, place in (("anomaly_records", "t"), ("telemetry", "u")):
        stored = tables.read_result_table(spark, table, str(tmp_path / place))
        assert stored.count() == 4 and stored.select("id").distinct().count() == 4


def test_messages_hold_one_record_or_many(spark):
    one = '{"satellite_id": "A", "timestamp": "2024-01-01T00:00:00"}'
    messages = spark.createDataFrame([(one,), (f"[{one}, {one}]",), ("broken",), (None,)], "value string")
    records = ingest.stream_ingest(ingest.parse_messages(messages)).collect()
    assert sorted((r.satellite_id or "", r.reject_reason or "") for r in records) == [("", "no satellite"), ("", "unreadable"), ("A", ""), ("A", ""), ("A", "")]


def test_windows_wait_for_late_readings_only_so_long(spark, tmp_path):
    """Append mode: a window is given out once, when the watermark has passed it; later readings are left out of it."""
    inbox = tmp_path / "in"
    reading = lambda time, value: {"satellite_id": "A", "timestamp": time, "battery_pct": value}
    for name, rows in [
        ("1.json", [reading("2024-01-01T10:05:00", 90.0), reading("2024-01-01T10:50:00", 90.0)]),
        ("2.json", [reading("2024-01-01T11:05:00", 90.0), reading("2024-01-01T10:55:00", 30.0)]),
        ("3.json", [reading("2024-01-01T13:00:00", 90.0)]),
        ("4.json", [reading("2024-01-01T10:01:00", 0.0), reading("2024-01-01T15:00:00", 90.0)]),
    ]:
        write(inbox, name, rows)
        records = ingest.accepted_records(ingest.stream_ingest(ingest.stream_source_json(spark, str(inbox))))
        windows = live.stream_window_health(records.select("satellite_id", "timestamp", "battery_pct"), "1 hour", "10 minutes")
        ingest.stream_flush(windows, live.table_writer(f"{tmp_path}/out"), f"{tmp_path}/checkpoint", available_now=True).awaitTermination()
    out = spark.read.parquet(f"{tmp_path}/out").orderBy("window_start").collect()
    batch = live.stream_window_health(
        spark.createDataFrame([("A", t, v) for t, v in [("2024-01-01 10:05:00", 90.0), ("2024-01-01 10:50:00", 90.0), ("2024-01-01 10:55:00", 30.0)]],
                              "satellite_id string, timestamp string, battery_pct double").selectExpr("satellite_id", "timestamp(timestamp) AS timestamp", "battery_pct"),
        "1 hour",
    ).first()
    assert [r.window_start.hour for r in out] == [10, 11, 13]
    assert out[0].health_score == batch.health_score


def test_latest_of_some(spark, tmp_path):
    records = spark.createDataFrame(
        [("A", "2024-01-01 00:00:00", 1), ("A", "2024-01-01 00:01:00", 2), ("B", "2024-01-01 00:00:00", 3)],
        "satellite_id string, timestamp string, n int",
    ).selectExpr("satellite_id", "timestamp(timestamp) AS timestamp", "n")
    assert [r.n for r in live.stream_latest(records, ["A"]).collect()] == [2]


def test_registry_file_and_versions(spark, tmp_path):
    (tmp_path / "registry.json").write_text(json.dumps([{"satellite_id": "A", "name": "a"}, {"satellite_id": "B", "name": "b"}]))
    registry = tables.load_registry(spark, str(tmp_path / "registry.json"), one_list=True)
    assert registry.count() == 2
    tables.save_registry(registry, str(tmp_path / "saved"))
    tables.save_registry(registry.where("name = 'a'"), str(tmp_path / "saved"))
    assert tables.load_saved_registry(spark, str(tmp_path / "saved")).count() == 1


def deduplicated(spark, inbox, store, checkpoint, seconds=600):
    records = ingest.stream_dedup(ingest.stream_ingest(ingest.stream_source_json(spark, str(inbox), files_per_batch=1)), seconds=seconds)
    query = ingest.stream_flush(records, ingest.on_batch(ingest.store_batch(str(store))), str(checkpoint), available_now=True)
    query.awaitTermination()
    return query


def test_keys_survive_a_restart(spark, tmp_path):
    """The state knows what came before the query was started again; rejects are never repeats of each other."""
    inbox, store, checkpoint = (tmp_path / n for n in ("in", "store", "checkpoint"))
    bad = {"satellite_id": "A", "timestamp": "x"}
    write(inbox, "1.json", [GOOD, bad, bad, {**GOOD, "satellite_id": "B"}])
    first = deduplicated(spark, inbox, store, checkpoint)
    assert first.lastProgress["stateOperators"][0]["numRowsTotal"] == 4
    write(inbox, "2.json", [GOOD, bad, {**GOOD, "timestamp": "2024-01-01T11:00:00"}])
    second = deduplicated(spark, inbox, store, checkpoint)
    assert sum(int(p["stateOperators"][0]["customMetrics"]["numDroppedDuplicateRows"]) for p in second.recentProgress) == 1
    assert second.lastProgress["stateOperators"][0]["numRowsTotal"] == 6
    stored = ingest.read_store(spark, str(store))
    assert sorted((r.satellite_id, r.timestamp.hour) for r in stored.collect()) == [("A", 11), ("A", 12), ("B", 12)]
    assert sorted(r.id for r in stored.collect()) == [1, 2, 3]
    totals = ingest.stream_totals(ingest.stream_stats(spark, str(store))).first()
    assert (totals.received_total, totals.valid_total, totals.accepted_total, totals.repeated_total, totals.rejected_total) == (7, 4, 3, 1, 3)


def test_state_forgets_and_the_store_does_not(spark, tmp_path):
    """A repeat that comes when the state has dropped its key is found in the store; a new late record is stored."""
    inbox, store, checkpoint = (tmp_path / n for n in ("in", "store", "checkpoint"))
    for name, records in [("1", [GOOD]), ("2", [{**GOOD, "satellite_id": "B"}]), ("3", [{**GOOD, "satellite_id": "C"}])]:
        write(inbox, f"{name}.json", records)
        deduplicated(spark, inbox, store, checkpoint, seconds=1)
        time.sleep(3)
    write(inbox, "4.json", [GOOD, {**GOOD, "timestamp": "2024-01-01T10:00:00"}])
    query = deduplicated(spark, inbox, store, checkpoint, seconds=1)
    assert sum(int(p["stateOperators"][0]["customMetrics"]["numDroppedDuplicateRows"]) for p in query.recentProgress) == 0
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 3
    stored = ingest.read_store(spark, str(store))
    assert sorted((r.satellite_id, r.timestamp.hour) for r in stored.collect()) == [("A", 10), ("A", 12), ("B", 12), ("C", 12)]
    assert sorted(r.id for r in stored.collect()) == [1, 2, 3, 4]


def test_a_stream_that_knows_its_keys_does_not_ask_the_store(spark, tmp_path, monkeypatch):
    """Records in no order of time: only what another stream has stored is looked up, and in its runs alone."""
    inbox, store, asked = tmp_path / "in", tmp_path / "store", []
    rows = Store.rows
    monkeypatch.setattr(Store, "rows", lambda self, runs, days=None: asked.append(sorted(r.first for r in runs)) or rows(self, runs, days))
    at = lambda hour: {**GOOD, "timestamp": f"2024-01-01T{hour:02d}:00:00"}
    for n, hours in enumerate([[12, 8], [9, 7, 12], [10, 6, 9]]):
        write(inbox, f"{n}.json", [at(h) for h in hours])
        time.sleep(0.01)
    deduplicated(spark, inbox, store, tmp_path / "checkpoint")
    assert asked == []
    for n, hours in enumerate([[20, 8], [5, 9, 15], [6, 15, 4]]):
        write(tmp_path / "other", f"{n}.json", [at(h) for h in hours])
        time.sleep(0.01)
    deduplicated(spark, tmp_path / "other", store, tmp_path / "checkpoint-2")
    assert asked and all(runs == [0, 1, 2] for runs in asked)
    stored = ingest.read_store(spark, str(store))
    assert sorted(r.timestamp.hour for r in stored.collect()) == [4, 5, 6, 7, 8, 9, 10, 12, 15, 20]
    assert sorted(r.id for r in stored.collect()) == list(range(1, 11))
    totals = ingest.stream_totals(ingest.stream_stats(spark, str(store))).first()
    assert (totals.received_total, totals.accepted_total, totals.rejected_total) == (16, 10, 0)


def test_what_may_be_stored(spark):
    """Others have stored up to 9:00, this stream up to 12:00 since it began at 10:00; one history entry says 11:00 at 10:30."""
    at = lambda hour, minute=0: dt.datetime(2024, 1, 1, hour, minute)
    asked = [(t, k) for t in (at(9), at(9, 1), at(11, 1), at(12, 1)) for k in (at(9, 50), at(10, 20), at(10, 40))]
    rows = spark.createDataFrame(asked, "timestamp timestamp, known_since timestamp")
    history = [(at(10, 30), at(11))]
    for floor, want in ((at(9), [True] * 3 + [False, True, True] + [False, False, True] + [False] * 3), (None, [False, True, True] * 2 + [False, False, True] + [False] * 3)):
        maybe = Position(3, 9, floor, at(12), history, at(10)).maybe_stored(F.col("timestamp"), F.col("known_since"))
        assert [r.maybe for r in rows.select(maybe.alias("maybe")).collect()] == want
    # Without a beginning, as in logs of before, the history decides.
    maybe = Position(3, 9, None, at(12), history).maybe_stored(F.col("timestamp"), F.col("known_since"))
    assert [r.maybe for r in rows.select(maybe.alias("maybe")).collect()] == [True] * 6 + [False, False, True] + [False] * 3


def test_a_batch_of_many_days_leaves_few_files(spark, tmp_path):
    """Each task has all days; the batches are merged then."""
    known = {ingest.ARRIVED: F.lit("2024-02-01").cast("timestamp"), ingest.KNOWN_SINCE: F.lit("2024-01-31").cast("timestamp")}
    writer, folder = ingest.store_batch(str(tmp_path / "store"), merge_every=2), tmp_path / "store" / "telemetry"
    most = []
    for n, count in enumerate((20_000, 400, 400, 400)):
        rows = spark.range(count, numPartitions=8).selectExpr("concat('S', id % 7) AS satellite_id", f"timestamp'2024-01-01' + make_interval(0, 0, 0, int(id % 40), 0, {n}, id) AS timestamp")
        writer(ingest.stream_ingest(rows).withColumns(known), n)
        most.append(len(list(folder.rglob("*.parquet"))))
    assert most[0] <= 40 + 8 and most[2] <= 3 * (40 + 8) and len(list(folder.rglob("level=1/*/*.parquet"))) <= 40 + 8
    stored = ingest.read_store(spark, str(tmp_path / "store"))
    assert stored.agg(F.count("id"), F.countDistinct("id"), F.min("id"), F.max("id"), F.countDistinct("satellite_id", "timestamp")).first() == (21_200, 21_200, 1, 21_200, 21_200)


def folders(path):
    return sum(p.is_dir() for p in path.rglob("*"))


def put(folder, schema, rows):
    """A finished folder of one small file, without a job."""
    folder.mkdir(parents=True)
    pq.write_table(pa.Table.from_pylist(rows, to_arrow_schema(schema)), folder / "part-0.parquet", coerce_timestamps="us")
    (folder / "_SUCCESS").touch()


def test_cost_of_a_batch_does_not_grow(spark, tmp_path):
    """Three hundred batches: few folders are left, the newest is found among them, and no row is lost."""
    path, most = tmp_path / "store", 0
    log_schema = spark.createDataFrame([], LOG).schema
    at = Position()
    for n in range(300):
        if n % 10 == 1:
            Store(spark, str(path)).merge(10)
        if n % 100 == 50:
            store = Store(spark, str(path))
            assert store.position("stream", n) == at and len(at.history) <= 40
            most = max(most, len(store.runs), folders(path / "_log"))
        run, time_ = Run.of_batch(n, "stream", n), dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(minutes=7 * n)
        put(path / "telemetry" / f"day={time_:%Y-%m-%d}" / run.place, TELEMETRY, [{"id": n + 1, "satellite_id": "A", "timestamp": time_}])
        row = dict.fromkeys(ingest.COUNTS, 0) | dict(received=1, valid=1, accepted=1)
        history = [{"arrived": a, "newest": b} for a, b in at.history]
        row |= dict(number=n, source="stream", batch=n, dropped_before=0, first_id=n + 1, next_id=n + 2, before=at.before, newest=time_, arrived=time_, history=history, days=[f"{time_:%Y-%m-%d}"])
        put(path / "_log" / run.place, log_schema, [row])
        plain = time_.replace(tzinfo=None)
        at = Position(n + 1, n + 2, None, plain, thinned(at.history, plain, plain))
    stored = ingest.read_store(spark, str(path))
    assert stored.agg(F.count("id"), F.countDistinct("id"), F.max("id")).first() == (300, 300, 300)
    assert ingest.stream_totals(ingest.stream_stats(spark, str(path))).first().accepted_total == 300
    # Two rounds of runs per level, three levels, each with a folder of its own.
    assert most <= 3 * (2 * 11 + 3)
    assert folders(path / "telemetry") <= 2 * (1 + 3 + 3 * 22)


def test_many_batches_of_a_writer(spark, tmp_path):
    """Late, repeated and new records in batches that are merged again and again: ids have no gaps, counts are whole."""
    store, partitions = tmp_path / "store", spark.conf.get("spark.sql.shuffle.partitions")
    writer = ingest.store_batch(str(store), merge_every=4)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        for n in range(22):
            minutes = [n, n + 1, 5]
            rows = [("A", f"2024-01-0{1 + n % 3}T00:{m:02d}:00", float(n)) for m in minutes]
            batch = spark.createDataFrame(rows, "satellite_id string, timestamp string, battery_pct double").coalesce(1)
            writer(batch, n)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
    want = {(1 + n % 3, m) for n in range(22) for m in (n, n + 1, 5)}
    stored = ingest.read_store(spark, str(store)).collect()
    assert sorted((r.timestamp.day, r.timestamp.minute) for r in stored) == sorted(want)
    assert sorted(r.id for r in stored) == list(range(1, len(want) + 1))
    assert {r.level for r in Store(spark, str(store)).live()} == {0, 1, 2}
    totals = ingest.stream_totals(ingest.stream_stats(spark, str(store))).first()
    assert (totals.received_total, totals.accepted_total, totals.repeated_total) == (66, len(want), 66 - len(want))
    assert not list((store / "_coming").iterdir())


def test_a_merge_that_was_cut_off_is_made_again(spark, tmp_path):
    store = str(tmp_path / "store")
    writer = ingest.store_batch(store, merge_every=3)
    record = lambda n: spark.createDataFrame([("A", f"2024-01-01T00:{n:02d}:00")], "satellite_id string, timestamp string")
    for n in range(5):
        writer(record(n), n)
    assert {r.level for r in Store(spark, store).live()} == {0, 1}
    before = sorted((r.id, r.timestamp) for r in ingest.read_store(spark, store).collect())
    # As if the merged rows were there, but not yet their rows of the log.
    merged = next(r for r in Store(spark, store).runs if r.level == 1)
    tables.remove_path(spark, f"{store}/_log/{merged.place}")
    assert sorted((r.id, r.timestamp) for r in ingest.read_store(spark, store).collect()) == before
    for n in range(5, 12):
        writer(record(n), n)
    stored = ingest.read_store(spark, store).collect()
    assert sorted(r.id for r in stored) == list(range(1, 13)) and len({r.timestamp for r in stored}) == 12


def test_newest_values_are_upserted(spark, tmp_path):
    """Each batch writes what changed; merging keeps the newest of each; equal times are decided by the other values."""
    inbox, path = tmp_path / "in", tmp_path / "latest"
    at = lambda sat, minute, battery: {"satellite_id": sat, "timestamp": f"2024-01-01T00:{minute:02d}:00", "battery_pct": battery}
    for n in range(8):
        write(inbox, f"{n}.json", [at("A", n, float(n)), at("A", n, n + 0.5), at("B", 30 - n, float(n)), *([at("C", 1, 1.0)] if n == 2 else [])])
        time.sleep(0.01)
    records = ingest.accepted_records(ingest.stream_ingest(ingest.stream_source_json(spark, str(inbox), files_per_batch=1)))
    newest = live.stream_latest(records.select("satellite_id", "timestamp", "battery_pct"))
    sizes = []
    upsert = live.upsert_batch(str(path), merge_every=3)

    def writer(batch, n):
        upsert(batch, n)
        sizes.append(pq.read_table(path / f"versions={n}-{n}").num_rows)

    ingest.stream_flush(newest, writer, str(tmp_path / "checkpoint"), available_now=True, mode="update").awaitTermination()
    got = live.read_latest(spark, str(path), newest)
    assert sorted((r.satellite_id, r.timestamp.minute, r.battery_pct) for r in got.collect()) == [("A", 7, 7.5), ("B", 30, 0.0), ("C", 1, 1.0)]
    assert max(sizes) <= 3 and len(list(path.glob("versions=*"))) <= 8
    assert live.read_latest(spark, str(tmp_path / "none"), newest).count() == 0


def test_user_sql_leaves_the_session_as_it_was(spark):
    spark.range(3).createOrReplaceTempView("mine")
    before = sorted(t.name for t in spark.catalog.listTables())
    out = tables.sql_query(spark, "SELECT count(*) AS n FROM mine JOIN other ON mine.id = other.id WHERE other.id < :top", {"mine": spark.range(10), "other": spark.range(20)}, {"top": 7})
    with pytest.raises(Exception, match="nowhere"):
        tables.sql_query(spark, "SELECT * FROM nowhere", {"mine": spark.range(1), "third": spark.range(1)})
    assert sorted(t.name for t in spark.catalog.listTables()) == before and spark.table("mine").count() == 3
    assert out.first().n == 7
    spark.catalog.dropTempView("mine")
