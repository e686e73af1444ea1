"""Quality checks of telemetry: one row per satellite, or per satellite and column."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetgauge import constants as C
from fleetgauge.operators.grouping import KEYS, Spread, join_groups, ordering, present, scoped, spread_of
from fleetgauge.operators.ordering import over_readings
from fleetgauge.operators.quantiles import quantiles_of_counts
from fleetgauge.operators.select import parsed_timestamp

Ranges = Mapping[str, tuple[float, float]]


def missing_columns(df: DataFrame, expected: Sequence[str] = C.EXPECTED_COLUMNS) -> list[str]:
    return [c for c in expected if c not in df.columns]


# The wording of the issues in this module is part of the reports' format.
def dtype_issues(df: DataFrame, numeric: Sequence[str] = C.MUST_BE_NUMERIC) -> list[str]:
    wrong = [
        f.name for f in df.schema.fields
        if f.name in numeric and not isinstance(f.dataType, T.NumericType)
    ]
    return [f"Column '{c}' is not numeric" for c in numeric if c in wrong]


def _outside(metric: str, ranges: Ranges) -> Column:
    low, high = ranges[metric]
    return (F.col(metric) < low) | (F.col(metric) > high)


def range_flags(df: DataFrame, ranges: Ranges = C.VALUE_RANGES) -> DataFrame:
    """Adds `out_of_range`, the names of the row's metrics that leave their range."""
    names = [F.when(_outside(m, ranges), F.lit(m)) for m in present(df, list(ranges))]
    return df.withColumn("out_of_range", F.array_compact(F.array(*names)))


def percent(part: Column, whole: Column) -> Column:
    return F.round(F.coalesce(F.try_divide(part, whole) * 100, F.lit(0.0)), 2)


def missing_profile(
    df: DataFrame, *, keys: Sequence[str] = KEYS, limit: float = C.MAX_MISSING_PCT
) -> DataFrame:
    """Nulls of each column: count, percentage, and whether the percentage is above the limit."""
    columns = df.columns
    df, keys = scoped(df, keys)
    counts = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_records"),
        *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in columns],
    )
    cells = [
        F.struct(F.lit(c).alias("column_name"), F.col(f"null_{c}").alias("missing_count")) for c in columns
    ]
    long = counts.select(*keys, "total_records", F.explode(F.array(*cells)).alias("c"))
    pct = percent(F.col("missing_count"), F.col("total_records"))
    return long.select(*keys, "total_records", "c.*").withColumns(
        {"missing_pct": pct, "over_limit": pct > limit}
    )


def duplicate_profile(
    df: DataFrame, *, keys: Sequence[str] = KEYS, limit: float = C.MAX_DUPLICATE_PCT
) -> DataFrame:
    """Exact copies beyond the first; what is shuffled is the keys and a mark of 128 bits, not the rows."""
    columns = df.columns
    df, keys = scoped(df, keys)
    # Nulls leave a hash as it is, so their places go into it.
    nulls = F.concat(*[F.when(F.col(c).isNull(), "1").otherwise("0") for c in columns])
    marks = df.select(*keys, F.xxhash64(*columns, nulls).alias("_mark"), F.xxhash64(nulls, F.lit(128), *reversed(columns)).alias("_mark_2"))
    copies = marks.groupBy(*keys, "_mark", "_mark_2").agg(F.count(F.lit(1)).alias("_copies"))
    sums = copies.groupBy(*keys).agg(
        F.sum("_copies").alias("total_records"), F.sum(F.col("_copies") - 1).alias("duplicate_count")
    )
    pct = percent(F.col("duplicate_count"), F.col("total_records"))
    return sums.withColumns({"duplicate_pct": pct, "duplicate_issue": pct > limit})


def range_text(low: float, high: float) -> str:
    return f"[{low}, {high}]"


def range_violations(
    df: DataFrame, *, keys: Sequence[str] = KEYS, ranges: Ranges = C.VALUE_RANGES
) -> DataFrame:
    """Metrics with values outside their range, with the range met."""
    df, keys = scoped(df, keys)
    metrics = present(df, list(ranges))
    counts = df.groupBy(*keys).agg(
        *[
            F.struct(
                F.count_if(_outside(m, ranges)).alias("violations"),
                F.min(m).cast("double").alias("lowest"), F.max(m).cast("double").alias("highest"),
                F.lit(range_text(*ranges[m])).alias("expected"),
            ).alias(m)
            for m in metrics
        ]
    )
    long = counts.unpivot(keys, metrics, "metric", "s").where(F.col("s.violations") > 0)
    actual = F.format_string("[%.2f, %.2f]", F.round("s.lowest", 2), F.round("s.highest", 2))
    return long.select(*keys, "metric", "s.violations", "s.expected", actual.alias("actual_range"))


def timestamp_issues(df: DataFrame, *, keys: Sequence[str] = KEYS, split: Spread | bool | None = None) -> DataFrame:
    """Unreadable and repeated timestamps, and gaps above five times the median gap."""
    time = parsed_timestamp(df)
    order = ordering(df)
    df, keys = scoped(df, keys)
    split = spread_of(df, keys, split)
    times = df.select(*keys, *order, (F.col("timestamp").isNotNull() & time.isNull()).alias("_unread"))
    times = times.withColumn("timestamp", time)
    per_time = times.groupBy(*keys, "timestamp").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("_unread").alias("unread")
    )
    counts = per_time.groupBy(*keys).agg(
        F.sum("unread").alias("unparseable_timestamps"),
        F.coalesce(F.sum(F.when(F.col("timestamp").isNotNull(), F.col("n") - 1)), F.lit(0)).alias(
            "duplicate_timestamps"
        ),
    )
    seconds = F.unix_micros("timestamp") / 1e6
    gap = lambda w: {"gap": seconds - F.lag(seconds).over(w)}
    known = times.drop("_unread").where(F.col("timestamp").isNotNull())
    gaps = over_readings(known, gap, before=1, keys=keys, order=order, split=split)
    gaps = gaps.where(F.col("gap").isNotNull()).groupBy(*keys, "gap").agg(F.count(F.lit(1)).alias("copies"))
    median = quantiles_of_counts(gaps, keys, "gap", {"median_gap": 0.5}, copies="copies", split=split)
    wide = join_groups(gaps, median, keys, few=split.few).groupBy(*keys).agg(
        F.first("median_gap").alias("median_gap_seconds"),
        F.sum(F.when(F.col("gap") > F.col("median_gap") * 5, F.col("copies")).otherwise(0)).alias("large_gaps"),
    )
    result = join_groups(counts, wide, keys)
    kinds = [F.col(c) > 0 for c in ("unparseable_timestamps", "duplicate_timestamps", "large_gaps")]
    return result.withColumn("large_gaps", F.coalesce("large_gaps", F.lit(0))).withColumn(
        "issue_kinds", sum((k.cast("int") for k in kinds), F.lit(0))
    )


def quality_score(profile: DataFrame) -> DataFrame:
    """Score of rows that carry the counts of `quality_profile`: 100 less capped deductions."""
    deductions = (
        F.least(F.lit(30.0), F.col("missing_pct_total"))
        + F.least(F.lit(20.0), F.col("duplicate_pct") * 2)
        + F.size("missing_columns") * 5
        + F.size("dtype_issues") * 3
        + F.col("range_deduction")
        + F.col("issue_kinds") * 5
    )
    return profile.withColumns(
        {
            "deductions": F.round(deductions, 1),
            "quality_score": F.round(F.greatest(F.lit(0.0), 100 - deductions), 1),
        }
    )


def _texts(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def quality_profile(
    df: DataFrame, *, keys: Sequence[str] = KEYS, ranges: Ranges = C.VALUE_RANGES,
    expected: Sequence[str] = C.EXPECTED_COLUMNS, split: Spread | bool | None = None,
) -> DataFrame:
    """All counts that the quality score and the report need, one row per group."""
    columns = df.columns
    absent, wrong = missing_columns(df, expected), dtype_issues(df)
    scope, keys = scoped(df, keys)
    split = spread_of(scope, keys, split)
    numeric = {f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)}
    metrics = [m for m in ranges if m in numeric]
    nulls = sum((F.count_if(F.col(c).isNull()) for c in columns), F.lit(0))
    counts = scope.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_records"), nulls.alias("missing_total"),
        *[F.count_if(_outside(m, ranges)).alias(f"_out_{m}") for m in metrics],
    )
    out = {m: F.col(f"_out_{m}") for m in metrics}
    issue = [
        F.when(
            out[m] > 0,
            F.concat(F.lit(f"Range violation in {m}: "), out[m].cast("string"),
                     F.lit(f" values outside {range_text(*ranges[m])}")),
        )
        for m in metrics
    ]
    cells = F.col("total_records") * len(columns)
    counts = counts.select(
        *keys, "total_records", F.lit(len(columns)).alias("total_columns"),
        _texts(absent).alias("missing_columns"), _texts(wrong).alias("dtype_issues"), "missing_total",
        percent(F.col("missing_total"), cells).alias("missing_pct_total"),
        sum(out.values(), F.lit(0)).alias("range_violation_count"),
        sum((F.least(F.lit(10.0), c * 0.1) for c in out.values()), F.lit(0.0)).alias("range_deduction"),
        (F.array_compact(F.array(*issue)) if issue else _texts([])).alias("range_issues"),
    )
    copies = duplicate_profile(scope, keys=keys).drop("total_records")
    result = join_groups(counts, copies, keys)
    if "timestamp" not in columns:
        return result.withColumns({"issue_kinds": F.lit(0), "timestamp_issues": _texts([])})
    times = timestamp_issues(scope, keys=keys, split=split)

    def text(count: str, words: str) -> Column:
        return F.when(F.col(count) > 0, F.concat(F.col(count).cast("string"), F.lit(words)))

    issues = F.array_compact(
        F.array(
            F.when(F.col("unparseable_timestamps") > 0, "Timestamp column cannot be parsed as datetime"),
            text("duplicate_timestamps", " duplicate timestamps found"),
            text("large_gaps", " unusually large timestamp gaps detected"),
        )
    )
    return join_groups(result, times.withColumn("timestamp_issues", issues), keys)


def validate(df: DataFrame, *, keys: Sequence[str] = KEYS, **options) -> DataFrame:
    """The whole quality report, one row per satellite (or one for the frame, with `keys=()`)."""
    scored = quality_score(quality_profile(df, keys=keys, **options))
    absent = F.when(
        F.size("missing_columns") > 0,
        F.array(F.concat(F.lit("Missing columns: "), F.array_join("missing_columns", ", "))),
    ).otherwise(_texts([]))
    issues = F.concat(absent, F.col("dtype_issues"), F.col("range_issues"), F.col("timestamp_issues"))
    return scored.withColumn("issues", issues).drop("range_issues", "timestamp_issues", "range_deduction")


def validation_records(report: DataFrame) -> DataFrame:
    """A report in the shape of the stored validation table, without id."""
    return report.select(
        "satellite_id", F.current_timestamp().alias("timestamp"), "quality_score",
        F.col("missing_total").cast("int").alias("missing_count"),
        F.col("duplicate_count").cast("int").alias("duplicate_count"),
        F.col("range_violation_count").cast("int").alias("invalid_count"), "issues",
        F.current_timestamp().alias("created_at"),
    )
