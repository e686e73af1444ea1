"""Live records into the telemetry store: parse, check, fill, deduplicate, write, count.

Repeats that follow each other soon are dropped by the stream itself, in a state that forgets a key some time
after it came. A record may be as late as it likes all the same: the time that runs the state is that of
arrival, and a record that may have been stored before the state knew its key is looked up in the store when
its batch is written. Each batch leaves its accepted rows, its rejects with the reason, and one row of counts;
a batch that failed half-way is written again in full. Sources are throttled by their own limits, so a burst
waits. A store has one writer at a time; several streams may follow each other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from fleetgauge import constants as C
from fleetgauge import schemas
from fleetgauge.operators.select import fill_ingest_defaults, parsed_timestamp
from fleetgauge.sources.tables import JSON_TIME, coerce_batch, path_exists, remove_path, scan_telemetry, with_numbers
from fleetgauge.streaming.store import COUNTS, Run, Store, by_day, log_row, read_batches, read_stored

BatchWriter = Callable[[DataFrame, int], None]

#: Holds the text of a message that is no record.
UNREADABLE = "unreadable"
KEY = ("satellite_id", "timestamp")
#: When a batch came, and since when the stream knows all keys.
ARRIVED, KNOWN_SINCE = "arrived_at", "known_since"
#: The queries that `stream_flush` has started, by id.
_RUNNING: dict[str, StreamingQuery] = {}
#: What a reject tells, and up to how many keys every task may hold at once.
_TOLD = ("received_time", UNREADABLE, "reject_reason")
_FEW_KEYS = 500_000
_REJECTED = f"satellite_id string, received_time string, {UNREADABLE} string, reject_reason string, source string, batch long"


def stream_source_json(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """Records from JSON lines that arrive as files in a folder; a line that is no JSON is kept in `unreadable`."""
    reader = spark.readStream.schema(schemas.live_schema().add(UNREADABLE, T.StringType()))
    return reader.option("maxFilesPerTrigger", files_per_batch).option("columnNameOfCorruptRecord", UNREADABLE).json(folder)


def parse_messages(messages: DataFrame, column: str = "value") -> DataFrame:
    """Records from messages that hold one JSON record or a list of them; others are kept in `unreadable`."""
    text = F.col(column).cast("string")
    records = F.from_json(text, T.ArrayType(schemas.live_schema()))
    return messages.select(text.alias(UNREADABLE), F.explode_outer(F.when(F.size(records) > 0, records)).alias("r")).select(
        "r.*", F.when(F.col("r").isNull(), F.col(UNREADABLE)).alias(UNREADABLE)
    )


def stream_ingest(records: DataFrame) -> DataFrame:
    """Records with typed times and defaults filled; `reject_reason` says why one can't be stored, null if it can."""
    raw = records if UNREADABLE in records.columns else records.withColumn(UNREADABLE, F.lit(None).cast("string"))
    time = parsed_timestamp(raw)
    reason = (
        F.when(F.col(UNREADABLE).isNotNull(), "unreadable").when(F.col("satellite_id").isNull(), "no satellite")
        .when(F.col("timestamp").isNull(), "no time").when(time.isNull(), "time not readable")
    )
    marked = raw.withColumns({"reject_reason": reason, "received_time": F.col("timestamp").cast("string"), "timestamp": time})
    return fill_ingest_defaults(marked)


def accepted_records(ingested: DataFrame) -> DataFrame:
    return ingested.where("reject_reason IS NULL").drop("reject_reason", "received_time", UNREADABLE)


def stream_dedup(records: DataFrame, stored: DataFrame | None = None, seconds: int = C.DEDUP_SECONDS) -> DataFrame:
    """The records whose (satellite, timestamp) is new: one of equals, and none that `stored` has.

    On a stream, repeats that arrive up to `seconds` after the first are dropped by a state, which forgets a key
    after twice that time at most; the columns added say when a record came and since when keys are known, and
    `store_batch` looks up the rest. Records with a reject reason are no repeats of each other. In a batch, of
    equal keys the record that sorts first, column by column.
    """
    if records.isStreaming:
        own = F.when(F.col("reject_reason").isNotNull(), F.uuid()) if "reject_reason" in records.columns else F.lit(None).cast("string")
        came = records.withColumn(ARRIVED, F.current_timestamp()).withColumn("_own", own).withWatermark(ARRIVED, f"{seconds} seconds")
        known = F.col(ARRIVED) - F.make_interval(secs=F.lit(seconds))
        return came.dropDuplicatesWithinWatermark([*KEY, "_own"]).drop("_own").withColumn(KNOWN_SINCE, known)
    others = [c for c in records.columns if c not in KEY]
    one = records.groupBy(*KEY).agg(F.min(F.struct(*others)).alias("_first")).select(*KEY, "_first.*").select(*records.columns)
    return one if stored is None else one.join(stored.select(*KEY), list(KEY), "left_anti").select(*records.columns)


def _source_of(spark: SparkSession) -> str:
    """The id of the running query, which its checkpoint keeps; `batches` outside a query."""
    return spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "batches"


def _dropped_before(source: str, batch_id: int) -> int:
    """Repeats that the state dropped from the batch before, as its progress says."""
    for progress in reversed(_RUNNING[source].recentProgress if source in _RUNNING else []):
        if progress["batchId"] == batch_id - 1:
            return sum(int(s["customMetrics"].get("numDroppedDuplicateRows", 0)) for s in progress["stateOperators"])
    return 0


def _day(timestamp: Column) -> Column:
    return F.date_format(timestamp, "yyyy-MM-dd")


def _typed_once(ingested: DataFrame, maybe: Column) -> DataFrame:
    """All records as telemetry rows with their kind: new, maybe (stored already), or reject, which keep what is told of them."""
    kind = F.when(F.col("reject_reason").isNotNull(), "reject").when(maybe, "maybe").otherwise("new")
    return coerce_batch(ingested.withColumn("kind", kind), keep=("kind", *_TOLD))


def store_batch(path: str, merge_every: int = C.MERGE_EVERY) -> BatchWriter:
    """Stores each batch as a run of the store; a repeated batch replaces its first attempt.

    A batch whose repeats the stream has dropped is read once and written twice: by kind, and with ids by day.
    Only records that may be stored already are looked up, in the days they are of and the runs that may have
    them; counts come from the jobs that write. After every `merge_every` batches their runs are merged.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        source = _source_of(spark)
        Store(spark, path).merge(merge_every)
        store = Store(spark, path)
        at = store.position(source, batch_id)
        run = Run.of_batch(at.number, source, batch_id)
        coming = f"{path}/_coming/{run.name}"

        ingested = batch if "reject_reason" in batch.columns else stream_ingest(batch)
        known = KNOWN_SINCE in ingested.columns
        for name in (ARRIVED, KNOWN_SINCE):
            if not known:
                ingested = ingested.withColumn(name, F.lit(None).cast("timestamp"))
        received, unique = Observation(), Observation()
        counted = ingested.observe(
            received, F.count(F.lit(1)).alias("received"), F.count_if(F.col("reject_reason").isNull()).alias("valid"),
            F.count_if(F.col("reject_reason") == "unreadable").alias("unreadable"), F.min(ARRIVED).alias("arrived"), F.min(KNOWN_SINCE).alias("since"),
        )
        maybe = at.maybe_stored(F.col("timestamp"), F.col(KNOWN_SINCE))
        typed = _typed_once(counted, maybe)
        single = typed if known else stream_dedup(typed.where("kind != 'reject'"))
        asked, day = F.col("kind") == "maybe", F.when(F.col("kind") != "reject", _day(F.col("timestamp")))
        single = single.observe(
            unique, F.count_if(asked).alias("maybe"), F.collect_set(F.when(asked, day)).alias("days"), F.count(day).alias("rows"), F.collect_set(day).alias("of_days"),
        )
        single.write.mode("overwrite").partitionBy("kind").parquet(f"{coming}/unique")
        counts, doubts = received.get, unique.get
        of_kind = {kind: f"{coming}/unique/kind={kind}" for kind in ("new", "maybe", "reject")}
        files = [of_kind["new"]] if path_exists(spark, of_kind["new"]) else []
        schema = single.drop("kind").schema
        if doubts.get("maybe"):
            asking = spark.read.schema(schema).parquet(of_kind["maybe"])
            runs = store.runs_before(counts.get("since"), source)
            stored = store.rows([r for r in runs if r != run], doubts["days"]).select(*KEY)
            if doubts["maybe"] <= _FEW_KEYS:
                # What is stored is read, but not shuffled.
                stored = stored.join(F.broadcast(asking.select(*KEY)), list(KEY), "left_semi")
            files.append(f"{coming}/fresh")
            asking.join(stored, list(KEY), "left_anti").write.mode("overwrite").parquet(files[-1])

        written = Observation()
        placed = with_numbers(spark.read.schema(schema).parquet(*files), at.first_id) if files else spark.createDataFrame([], schema).withColumn("id", F.lit(0))
        rows = placed.select(*schemas.TELEMETRY.names, _day(F.col("timestamp")).alias("day"))
        rows = by_day(rows, doubts.get("rows") or 0, len(doubts.get("of_days") or []))
        store.write_rows(
            rows.observe(written, F.count(F.lit(1)).alias("accepted"), F.max("timestamp").alias("newest"), F.sort_array(F.collect_set("day")).alias("days")), run
        )
        total, valid, accepted = counts.get("received") or 0, counts.get("valid") or 0, written.get.get("accepted") or 0
        if total > valid:
            rejects = spark.read.schema(schema).parquet(of_kind["reject"]) if known else ingested.where("reject_reason IS NOT NULL")
            rejects.select("satellite_id", "received_time", UNREADABLE, "reject_reason").write.mode("overwrite").parquet(f"{path}/_rejects/source={source}/batch={batch_id}")
        newest = max((t for t in (at.before, written.get.get("newest")) if t), default=None)
        row = (
            at.number, source, batch_id, total, valid, accepted, valid - accepted, total - valid, counts.get("unreadable") or 0,
            _dropped_before(source, batch_id), at.first_id, at.first_id + accepted, at.floor, at.before, newest, counts.get("arrived"), at.history, written.get.get("days") or [],
            at.began or counts.get("arrived"),
        )
        store.write_log(log_row(spark, row), run)
        remove_path(spark, coming)

    return write


def read_store(spark: SparkSession, path: str) -> DataFrame:
    return scan_telemetry(read_stored(spark, path))


def read_rejects(spark: SparkSession, path: str) -> DataFrame:
    """What could not be stored, with the reason."""
    if not path_exists(spark, f"{path}/_rejects"):
        return spark.createDataFrame([], _REJECTED)
    return spark.read.schema(_REJECTED).parquet(f"{path}/_rejects")


def tap_batch(path: str, records: int = C.TAP_RECORDS) -> BatchWriter:
    """Writes an envelope with the first records of each batch, in time order, for live subscribers."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = accepted_records(batch) if "reject_reason" in batch.columns else batch
        first = rows.orderBy("timestamp", "satellite_id").limit(records).agg(
            F.sort_array(F.collect_list(F.struct("timestamp", "satellite_id", F.struct(*rows.columns).alias("record")))).alias("sorted")
        )
        envelope = first.select(
            F.lit("telemetry").alias("type"), F.lit(rows.count()).alias("count"),
            F.current_timestamp().alias("timestamp"), F.col("sorted.record").alias("records"),
        )
        envelope.write.mode("overwrite").option("timestampFormat", JSON_TIME).json(f"{path}/source={_source_of(batch.sparkSession)}/batch={batch_id}")

    return write


def on_batch(*writers: BatchWriter) -> BatchWriter:
    """Runs several writers on one computed batch; a single one gets the batch as it comes."""
    if len(writers) == 1:
        return writers[0]

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for writer in writers:
                writer(batch, batch_id)
        finally:
            batch.unpersist()

    return write


def stream_flush(
    records: DataFrame, writer: BatchWriter, checkpoint: str, *, available_now: bool = False,
    milliseconds: int = C.FLUSH_MILLISECONDS, mode: str = "append",
) -> StreamingQuery:
    """Starts the query that hands over what has arrived every so many milliseconds."""
    sink = records.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(writer)
    trigger = {"availableNow": True} if available_now else {"processingTime": f"{milliseconds} milliseconds"}
    query = sink.trigger(**trigger).start()
    for ended in [k for k, q in _RUNNING.items() if not q.isActive]:
        del _RUNNING[ended]
    _RUNNING[query.id] = query
    return query


def stream_stats(spark: SparkSession, path: str) -> DataFrame:
    """Counts of every batch since the store began."""
    return read_batches(spark, path).select("source", "batch", *COUNTS)


def stream_totals(stats: DataFrame) -> DataFrame:
    return stats.agg(F.count(F.lit(1)).alias("flushed_batches"), *[F.coalesce(F.sum(c), F.lit(0)).alias(f"{c}_total") for c in COUNTS])


def recent_satellites(stored: DataFrame, rows: int = 20) -> DataFrame:
    """The satellites with the newest readings."""
    newest = stored.groupBy("satellite_id").agg(F.max("timestamp").alias("newest"))
    return newest.orderBy(F.desc("newest"), "satellite_id").limit(rows)
