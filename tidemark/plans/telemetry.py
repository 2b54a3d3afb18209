"""Queries over the driver's tables and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import calendar, catalog, integrity, payload, profile, recharge, reports, sampling
from ..operators.adapters import events, hourly, series, shifted
from ..session import once
from ..sources.csvs import parsed_times
from ..streaming import monitor

ASSETS = ["click", "error", "purchase", "scroll", "view"]
HOUR = 60
ZONE = "America/Santiago"
TIES = ("event_id",)
EVENTS_A_MESSAGE, ENTITIES_A_PAGE = 1000, 100


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to so many digits, so that engines agree on the last bit; minutes are one exact division and stay."""
    return df.select(*(F.round(c, digits).alias(c) if t == "double" and not c.endswith("_minutes") else F.col(c) for c, t in df.dtypes))


def _customers(spark: SparkSession, d: str) -> DataFrame:
    """id, label, name from the customer table; some labels and names empty or null."""
    k = F.col("c_custkey")
    return spark.read.parquet(f"{d}/customer.parquet").select(
        k.alias("n"), k.cast("string").alias("id"),
        F.when(k % 5 == 0, "").when(k % 7 == 0, None).otherwise(F.concat(F.lit(" Tank: "), F.col("c_name"), F.lit("  / A\t"))).alias("label"),
        F.when(k % 3 == 0, None).when(k % 11 == 0, "").otherwise(F.col("c_name")).alias("name"),
    )


CUSTOMERS = r"""customers AS (SELECT c_custkey AS n, c_custkey::VARCHAR AS id,
  CASE WHEN c_custkey % 5 = 0 THEN '' WHEN c_custkey % 7 = 0 THEN NULL ELSE ' Tank: ' || c_name || '  / A' || chr(9) END AS label,
  CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 11 = 0 THEN '' ELSE c_name END AS name FROM customer)"""


def _payloads(spark: SparkSession, d: str) -> DataFrame:
    """A payload of points for each event type and hour, with repeated points, so that none grows with the number of days."""
    ms = F.unix_millis(F.date_trunc("minute", "ts").cast("timestamp"))
    point = F.struct(F.col("event_id"), F.struct(ms.alias("ts"), F.col("value").cast("string").alias("value")).alias("p"))
    rows = events(spark, d).withColumn("key", F.when(F.col("event_id") % 2 == 0, "nivelPorcentual").otherwise("nivelEstanque"))
    rows = rows.groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.hour("ts").alias("hour"), "key").agg(F.array_sort(F.collect_list(point)).alias("points"))
    points = F.transform("points", lambda p: p["p"])
    rows = rows.groupBy("event_type", "day", "hour").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("key", points)))).alias("payload"))
    return rows.drop("hour")


def _messages(spark: SparkSession, d: str) -> DataFrame:
    """Messages of one event type and at most EVENTS_A_MESSAGE successive event ids, so that none grows with the table."""
    ms = F.unix_millis(F.col("ts").cast("timestamp")).cast("string")
    rows = events(spark, d).groupBy("event_type", F.floor(F.col("event_id") / EVENTS_A_MESSAGE)).agg(F.collect_list(F.array(ms, F.col("value").cast("string"))).alias("points"))
    data = F.struct(F.lit(1).alias("cmdId"), F.create_map(F.lit("timeOn"), F.col("points")).alias("data"))
    return rows.select("event_type", F.to_json(data).alias("message"))


def _entity_messages(spark: SparkSession, d: str) -> DataFrame:
    """Pages of at most ENTITIES_A_PAGE entities; customers of nation 0 are no assets, every id stands on two pages."""
    c = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", "c_nationkey").join(_customers(spark, d), F.col("c_custkey") == F.col("n"))
    value = lambda name: F.struct(F.col(name).alias("value"))
    entity = F.struct(
        F.struct(F.when(F.col("c_nationkey") == 0, "DEVICE").otherwise("ASSET").alias("entityType"), F.col("id").alias("id")).alias("entityId"),
        F.struct(F.struct(value("label").alias("label"), value("name").alias("name")).alias("ENTITY_FIELD")).alias("latest"),
        F.concat(F.lit("type"), F.col("n") % 4).alias("type"), F.col("name"),
    )
    first = 2 * F.floor(F.col("n") / ENTITIES_A_PAGE)
    rows = c.withColumn("page", F.explode(F.array(first, first + 1)))
    rows = rows.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("n", entity.alias("e")))).alias("es"))
    data = F.struct(F.transform("es", lambda x: x["e"]).alias("data"), F.lit(False).alias("hasNext"))
    return rows.select("page", F.to_json(F.struct(F.lit(1).alias("cmdId"), data.alias("data"))).alias("message"))


def asset_filter_range(spark: SparkSession, d: str) -> DataFrame:
    from datetime import datetime

    return integrity.bounded(series(spark, d), datetime(2024, 1, 5), datetime(2024, 1, 20), "(C|R)").select("asset_id", "timestamp", "event_id")


def epoch_unit_inference(spark: SparkSession, d: str) -> DataFrame:
    """One "file" of times for each event type in another unit; view as text, error with unreadable cells."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    cell = (
        F.when(F.col("event_type") == "click", F.floor(us / 1_000_000).cast("string")).when(F.col("event_type") == "purchase", F.floor(us / 1000).cast("string"))
        .when(F.col("event_type") == "view", F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).when((F.col("event_type") == "error") & (F.col("event_id") % 3 == 0), "12d").otherwise(us.cast("string"))
    )
    rows = parsed_times(events(spark, d).select("event_id", F.col("event_type").alias("_file"), cell.alias("cell")), "cell")
    return rows.select("event_id", "strategy", F.coalesce(F.unix_seconds(F.col("timestamp").cast("timestamp")), F.lit(-1)).alias("epoch_s"))


def ts_strategy(spark: SparkSession, d: str) -> DataFrame:
    found = epoch_unit_inference(spark, d).select("strategy")
    return reports.strategy(found).select("strategy", F.array_join("strategies", ",").alias("strategies"))


def numeric_coerce(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id") % 6
    cell = F.when(k == 0, F.concat(F.col("value").cast("string"), F.lit("d"))).when(k == 1, " 1.5e2 ").when(k == 2, "N/A").when(k == 3, ".5").when(k == 4, "-7.").otherwise("0x1F")
    return events(spark, d).select("event_id", scalars.to_number(scalars.not_available(cell)).alias("number"))


def asset_resolution(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.csvs import asset_ids

    rows = _customers(spark, d).select("n", "label", F.concat(F.lit("file:/data/Tank "), F.col("n") % 3, F.lit("/x_2024-01.csv")).alias("_file"))
    return rows.select("n", asset_ids(rows, "label").alias("asset_id"))


def payload_pivot(spark: SparkSession, d: str) -> DataFrame:
    points = payload.explode_points(_payloads(spark, d))
    return payload.widen(points, ["nivelEstanque", "nivelPorcentual"], ["event_type", "day"])


def payload_explode(spark: SparkSession, d: str) -> DataFrame:
    return payload.explode_messages(_messages(spark, d)).select("event_type", "timestamp_ms", "key", "value", F.col("datetime").cast("timestamp_ntz").alias("datetime"))


def catalog_extract(spark: SparkSession, d: str) -> DataFrame:
    return catalog.extract_assets(_entity_messages(spark, d)).select("page", "id", "label", "name")


def catalog_dedupe(spark: SparkSession, d: str) -> DataFrame:
    found = catalog.extract_assets(_entity_messages(spark, d)).withColumn("type", F.lit("ESTANQUES"))
    return catalog.catalog(catalog.last_of_each(found, "id", ["page", "at"]))


def asset_types_regex(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit('noise {"assetTypes" : ["'), F.col("p_type"), F.lit('", " '), F.col("p_brand"), F.lit(' ", 7, ""]} {"assetTypes":[broken]}'))
    return catalog.asset_types(spark.read.parquet(f"{d}/part.parquet").select(text.alias("t")), "t")


def asset_walk(spark: SparkSession, d: str) -> DataFrame:
    return catalog.walk_entities(_entity_messages(spark, d), "message").select("page", "id", "name")


def asset_walk_types(spark: SparkSession, d: str) -> DataFrame:
    c = _customers(spark, d)
    node = F.struct(F.struct(F.struct(F.lit("ASSET").alias("entityType"), F.col("name"), F.col("label"), F.concat(F.lit("t"), F.col("n") % 4).alias("assetType")).alias("inner")).alias("outer"))
    return catalog.walk_types(c.select(F.to_json(F.array(node)).alias("t")), "t")


def sample_manifest(spark: SparkSession, d: str) -> DataFrame:
    rows = sampling.manifest(series(spark, d).drop("event_id"), "timestamp", "asset_id")
    return rows.select(F.array_join("assets_included", ",").alias("assets"), "date_range.min", "date_range.max", F.array_join("columns", ",").alias("columns"), F.to_json("rows_per_asset").alias("rows_per_asset"))


def resume_worklist(spark: SparkSession, d: str) -> DataFrame:
    work = export_worklist(spark, d)
    done = work.where("(c_custkey + month) % 3 = 0")
    return calendar.still_to_do(work, done, ["c_custkey", "year", "month"])


def export_worklist(spark: SparkSession, d: str) -> DataFrame:
    assets = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey")
    return calendar.work_list(assets, calendar.month_ranges(spark, "2024-11", "2025-02", ZONE).select("year", "month"))


def month_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Observations of each asset in the export's months, by the clock of ZONE."""
    local = F.from_utc_timestamp(F.col("timestamp").cast("timestamp"), ZONE)
    rows = shifted(spark, d).select("asset_id", "timestamp", F.year(local).alias("year"), F.month(local).alias("month"))
    first, last = rows.agg(*(F.date_format(f(F.make_date("year", "month", F.lit(1))), "yyyy-MM") for f in (F.min, F.max))).first()
    months = calendar.month_ranges(spark, first, last, ZONE)
    inside = rows.join(F.broadcast(months), ["year", "month"]).where(F.unix_millis(F.col("timestamp").cast("timestamp")).between(F.col("start_ms"), F.col("end_ms")))
    return inside.groupBy("asset_id", *months.columns).agg(F.count("*").alias("obs"))


def month_spans(spark: SparkSession, d: str) -> DataFrame:
    """Observations of each asset in the months from the first day on to midnight of the last day."""
    rows = shifted(spark, d).select("asset_id", "timestamp", F.date_trunc("month", "timestamp").cast("timestamp_ntz").alias("start"))
    first, last = rows.agg(*(F.date_format(f("timestamp"), "yyyy-MM-dd") for f in (F.min, F.max))).first()
    inside = rows.join(F.broadcast(calendar.month_spans(spark, first, last)), "start").where("timestamp <= end")
    return inside.groupBy("asset_id", "start", "end").agg(F.count("*").alias("obs"))


def secrets(spark: SparkSession, d: str) -> DataFrame:
    c = spark.read.parquet(f"{d}/customer.parquet")
    text = F.when(F.col("c_custkey") % 4 == 0, F.substring("c_name", 1, 8)).when(F.col("c_custkey") % 9 == 0, None).otherwise(F.col("c_name"))
    return c.select("c_custkey", scalars.redact(text).alias("redacted"))


QUERIES = {
    "integrity_summary": lambda s, d: rounded(integrity.summary(hourly(s, d), HOUR)),
    "gaps_top10": lambda s, d: rounded(integrity.gaps(series(s, d), HOUR)),
    "duplicate_timestamps": lambda s, d: integrity.duplicates(hourly(s, d)),
    "duplicate_examples": lambda s, d: integrity.duplicate_examples(hourly(s, d)),
    "monthly_completeness": lambda s, d: rounded(integrity.monthly(shifted(s, d), HOUR)),
    "monthly_completeness_full": lambda s, d: rounded(integrity.monthly(shifted(s, d), HOUR, month_end="full")),
    "monthly_pivot": lambda s, d: rounded(integrity.monthly_pivot(integrity.monthly(shifted(s, d), HOUR), ASSETS)),
    "level_stats": lambda s, d: rounded(profile.stats(series(s, d))),
    "level_percentiles": lambda s, d: rounded(profile.percentiles(series(s, d))),
    "level_histogram": lambda s, d: rounded(profile.histogram(series(s, d), "nivelPorcentual", 20, ["asset_id"])),
    "rolling_median": lambda s, d: rounded(recharge.smoothed(series(s, d), tiebreak=TIES)),
    "local_extrema": lambda s, d: rounded(recharge.turning_points(series(s, d), tiebreak=TIES)),
    "recharge_events": lambda s, d: rounded(recharge.recharge_events(series(s, d), tiebreak=TIES)),
    "amplitude_histogram": lambda s, d: rounded(profile.histogram(once(recharge.recharge_events(series(s, d), tiebreak=TIES)), "amplitude", 10)),
    "correlation": lambda s, d: rounded(profile.correlation(series(s, d))),
    "scatter_pairs": lambda s, d: profile.scatter(series(s, d)),
    "missing_level_notes": lambda s, d: profile.missing_level_notes(series(s, d).withColumn("nivelEstanque", F.when(F.col("asset_id") > "error", F.col("nivelEstanque")))),
    "asset_filter_range": asset_filter_range,
    "epoch_unit_inference": epoch_unit_inference,
    "ts_strategy": ts_strategy,
    "numeric_coerce": numeric_coerce,
    "asset_resolution": asset_resolution,
    "label_fallback": lambda s, d: _customers(s, d).select("n", scalars.label_or_name_or_id(F.col("label"), F.col("name"), F.col("id")).alias("label")),
    "sanitize_label": lambda s, d: _customers(s, d).select("n", scalars.sanitize(F.col("label")).alias("label")),
    "redact": secrets,
    "name_filter": lambda s, d: _customers(s, d).where(scalars.named(F.col("name"), F.col("label"), ["Customer#000000001", "Tank: Customer#000000002  / A"])).select("n"),
    "month_ranges": month_ranges,
    "month_ranges_ms": month_spans,
    "export_worklist": export_worklist,
    "resume_worklist": resume_worklist,
    "payload_pivot": payload_pivot,
    "payload_explode": payload_explode,
    "catalog_extract": catalog_extract,
    "catalog_dedupe": catalog_dedupe,
    "asset_types_regex": asset_types_regex,
    "asset_walk": asset_walk,
    "asset_walk_types": asset_walk_types,
    "sample_head": lambda s, d: sampling.head(series(s, d), 7, ["timestamp", "event_id"], "asset_id").select("asset_id", "event_id"),
    "sample_alias": lambda s, d: sampling.aliases(series(s, d), "asset_id", ["timestamp", "event_id"]),
    "sample_anonymised": lambda s, d: sampling.anonymised(series(s, d), "asset_id", ["timestamp", "event_id"]).select("asset_id", "event_id"),
    "sample_first_assets": lambda s, d: sampling.first_assets(series(s, d), "asset_id", 2, ["timestamp", "event_id"]).select("asset_id", "event_id"),
    "sample_round": lambda s, d: sampling.rounded(series(s, d).select("event_id", (F.col("event_id") / 8).alias("x")), 2),
    "sample_manifest": sample_manifest,
    "stream_completeness": monitor.batch_completeness,
}

_SERIES = r"""series AS (SELECT event_type AS asset_id, ts AS timestamp, event_id, CASE WHEN event_id % 17 <> 0 THEN value END AS "nivelPorcentual",
  TRY_CAST(regexp_extract(props, '(\d+)', 1) AS DOUBLE) AS "nivelEstanque" FROM events),
hourly AS (SELECT * REPLACE (date_trunc('hour', timestamp) AS timestamp) FROM series),
shifted AS (SELECT * REPLACE (timestamp + INTERVAL 5 DAY AS timestamp) FROM hourly)"""

_GAPS = """diffs AS (SELECT asset_id, lag(timestamp) OVER (PARTITION BY asset_id ORDER BY timestamp) AS gap_start, timestamp AS gap_end FROM {rows}),
gaps AS (SELECT *, epoch_us(gap_end) - epoch_us(gap_start) AS gap FROM diffs WHERE epoch_us(gap_end) - epoch_us(gap_start) > 3600000000)"""


def _monthly(last: str) -> str:
    return f"""months AS (SELECT asset_id, date_trunc('month', timestamp)::TIMESTAMP AS first, {last} AS last,
  count(*) FILTER (timestamp <= {last}) AS obs FROM shifted GROUP BY ALL),
ranges AS (SELECT asset_id, min(timestamp) AS lo, max(timestamp) AS hi FROM shifted GROUP BY asset_id),
slots AS (SELECT asset_id, strftime(first, '%Y-%m') AS month, obs, (epoch_us(least(last, hi)) - epoch_us(greatest(first, lo))) // 3600000000 + 1 AS expected
  FROM months JOIN ranges USING (asset_id) WHERE greatest(first, lo) <= least(last, hi)),
monthly AS (SELECT asset_id AS asset, month, obs, expected, round(greatest(expected - obs, 0) / expected * 100, 6) AS missing_pct FROM slots)"""


_MIDNIGHT = _monthly("last_day(timestamp)::TIMESTAMP")
_SMOOTH = f"""{_SERIES}, smooth AS (SELECT asset_id, timestamp, event_id, row_number() OVER o AS i,
  median("nivelPorcentual") OVER (PARTITION BY asset_id ORDER BY timestamp, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS v
  FROM series WHERE "nivelPorcentual" IS NOT NULL WINDOW o AS (PARTITION BY asset_id ORDER BY timestamp, event_id))"""
_EXTREMA = f"""{_SMOOTH}, near AS (SELECT *, lag(v) OVER o AS b, lead(v) OVER o AS a FROM smooth WINDOW o AS (PARTITION BY asset_id ORDER BY i)),
extrema AS (SELECT asset_id, timestamp, event_id, i, v, coalesce(b > v AND v <= a, false) AS is_min, coalesce(b < v AND v >= a, false) AS is_max FROM near)"""
_EVENTS = f"""{_EXTREMA}, marked AS (SELECT *, sum(is_min::INT) OVER o AS k, sum(is_max::INT) OVER o AS c FROM extrema WHERE is_min OR is_max
  WINDOW o AS (PARTITION BY asset_id ORDER BY i ROWS UNBOUNDED PRECEDING)),
minima AS (SELECT *, k + max(1 + c - k) OVER (PARTITION BY asset_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS p FROM marked WHERE is_min),
recharge AS (SELECT a.asset_id, a.timestamp AS start_time, b.timestamp AS end_time, (epoch_us(b.timestamp) - epoch_us(a.timestamp)) / 60000000 AS duration_minutes,
  a.v AS level_start, b.v AS level_end, b.v - a.v AS amplitude FROM minima a JOIN marked b ON a.asset_id = b.asset_id AND b.is_max AND b.c = a.p
  WHERE b.v - a.v >= 10 AND epoch_us(b.timestamp) - epoch_us(a.timestamp) >= 1800000000)"""


def _histogram(rows: str, value: str, bins: int, key: str) -> str:
    edge = lambda i: f"CASE WHEN {i} = {bins} THEN hi ELSE lo + {i} * ((hi - lo) / {bins}) END"
    k = f"{key}, " if key else ""
    using = f"USING ({key})" if key else "ON true"
    return f"""vals AS (SELECT {k}{value} AS x FROM {rows} WHERE {value} IS NOT NULL),
ends AS (SELECT {k}CASE WHEN min(x) = max(x) THEN min(x) - 0.5 ELSE min(x) END AS lo, CASE WHEN min(x) = max(x) THEN max(x) + 0.5 ELSE max(x) END AS hi
  FROM vals {f'GROUP BY {key}' if key else 'HAVING count(*) > 0'}),
rough AS (SELECT *, least(floor((x - lo) / (hi - lo) * {bins})::INT, {bins - 1}) AS i FROM vals JOIN ends {using}),
placed AS (SELECT {k}CASE WHEN x < {edge('i')} THEN i - 1 WHEN x >= {edge('(i + 1)')} AND i < {bins - 1} THEN i + 1 ELSE i END AS i, count(*) AS n FROM rough GROUP BY ALL),
every AS (SELECT *, unnest(range({bins}))::INT AS i FROM ends)
SELECT {k}round({edge('i')}, 6) AS bin_left, round({edge('(i + 1)')}, 6) AS bin_right, coalesce(n, 0)::BIGINT AS count
FROM every LEFT JOIN placed USING ({k}i)"""


def _stats(v: str) -> str:
    return f"""round(min("{v}"), 6) AS "{v}_min", round(max("{v}"), 6) AS "{v}_max", round(avg("{v}"), 6) AS "{v}_mean", round(median("{v}"), 6) AS "{v}_median",
  round(stddev_samp("{v}"), 6) AS "{v}_std", count(*) AS "{v}_n_total", count("{v}") AS "{v}_n_valid", round((count(*) - count("{v}")) * 100.0::DOUBLE / count(*), 6) AS "{v}_missing_pct" """


_PAGES = f"""{CUSTOMERS}, pages AS (SELECT n, id, label, name, c_nationkey, unnest([2 * (n // 100), 2 * (n // 100) + 1]) AS page FROM customers JOIN customer ON n = c_custkey),
assets AS (SELECT page, n, id, coalesce(nullif(label, ''), nullif(name, ''), id) AS label, coalesce(nullif(name, ''), nullif(label, ''), id) AS name FROM pages WHERE c_nationkey <> 0)"""
_CELLS = r"""cells AS (SELECT event_id, event_type, CASE event_type WHEN 'click' THEN 'epoch_s' WHEN 'purchase' THEN 'epoch_ms' WHEN 'view' THEN 'string' ELSE 'epoch_us' END AS strategy,
  CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN -1 ELSE epoch_us(ts) // 1000000 END AS epoch_s FROM events)"""
_WORK = """work AS (SELECT c_custkey, year, month FROM customer, (VALUES (2024, 11), (2024, 12), (2025, 1), (2025, 2)) AS m(year, month))"""

SQL: dict[str, str] = {
    "integrity_summary": f"""WITH {_SERIES}, {_GAPS.format(rows='hourly')},
per AS (SELECT asset_id, count(*) AS obs, count(*) - count(DISTINCT timestamp) AS dup_count, min(timestamp) AS date_min, max(timestamp) AS date_max FROM hourly GROUP BY asset_id),
slots AS (SELECT *, (epoch_us(date_max) - epoch_us(date_min)) // 3600000000 + 1 AS expected FROM per)
SELECT asset_id AS asset, obs, expected, round(greatest(expected - obs, 0) / expected * 100, 6) AS missing_pct, dup_count,
  coalesce((SELECT max(gap) / 60000000 FROM gaps WHERE gaps.asset_id = slots.asset_id), 0) AS max_gap_minutes, date_min, date_max FROM slots""",
    "gaps_top10": f"""WITH {_SERIES}, {_GAPS.format(rows='series')}
SELECT asset_id AS asset, gap_start, gap_end, gap / 60000000 AS gap_minutes, greatest(gap // 3600000000 - 1, 0)::BIGINT AS missing_points_est FROM gaps
QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY gap DESC, gap_start) <= 10""",
    "duplicate_timestamps": f"WITH {_SERIES} SELECT asset_id AS asset, timestamp, count(*) AS count FROM hourly GROUP BY ALL HAVING count(*) > 1",
    "duplicate_examples": f"""WITH {_SERIES}, g AS (SELECT asset_id, timestamp FROM hourly GROUP BY ALL HAVING count(*) > 1),
d AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY timestamp) <= 5)
SELECT asset_id AS asset, string_agg(strftime(timestamp, '%Y-%m-%d %H:%M:%S'), ', ' ORDER BY timestamp) AS examples FROM d GROUP BY asset_id""",
    "monthly_completeness": f"WITH {_SERIES}, {_MIDNIGHT} SELECT * FROM monthly",
    "monthly_completeness_full": f"WITH {_SERIES}, {_monthly('last_day(timestamp)::TIMESTAMP + INTERVAL 23 HOUR')} SELECT * FROM monthly",
    "monthly_pivot": f"WITH {_SERIES}, {_MIDNIGHT} SELECT month, " + ", ".join(f"coalesce(max(missing_pct) FILTER (asset = '{a}'), 0) AS \"{a}\"" for a in ASSETS) + " FROM monthly GROUP BY month",
    "level_stats": f"WITH {_SERIES} SELECT asset_id, min(timestamp) AS date_min, max(timestamp) AS date_max, {_stats('nivelPorcentual')}, {_stats('nivelEstanque')} FROM series GROUP BY asset_id",
    "level_percentiles": f"""WITH {_SERIES}, l AS (SELECT asset_id, 'nivelPorcentual' AS variable, "nivelPorcentual" AS x FROM series UNION ALL SELECT asset_id, 'nivelEstanque', "nivelEstanque" FROM series)
SELECT asset_id, variable, unnest(['P1', 'P5', 'P10', 'P25', 'P50', 'P75', 'P90', 'P95', 'P99']) AS percentile,
  unnest([round(v, 6) FOR v IN quantile_cont(x, [0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99])]) AS value FROM l GROUP BY asset_id, variable""",
    "level_histogram": f"WITH {_SERIES}, " + _histogram("series", '"nivelPorcentual"', 20, "asset_id"),
    "rolling_median": f"WITH {_SMOOTH} SELECT asset_id, timestamp, event_id, i::INT AS i, round(v, 6) AS v FROM smooth",
    "local_extrema": f"WITH {_EXTREMA} SELECT asset_id, timestamp, event_id, i::INT AS i, round(v, 6) AS v, is_min, is_max FROM extrema WHERE is_min OR is_max",
    "recharge_events": f"""WITH {_EVENTS} SELECT asset_id, start_time, end_time, duration_minutes, round(level_start, 6) AS level_start,
  round(level_end, 6) AS level_end, round(amplitude, 6) AS amplitude FROM recharge""",
    "amplitude_histogram": f"WITH {_EVENTS}, " + _histogram("recharge", "amplitude", 10, ""),
    "correlation": f"""WITH {_SERIES} SELECT asset_id, round(corr("nivelEstanque", "nivelPorcentual"), 6) AS pearson_r, round(regr_slope("nivelEstanque", "nivelPorcentual"), 6) AS slope,
  round(regr_intercept("nivelEstanque", "nivelPorcentual"), 6) AS intercept, round(regr_r2("nivelEstanque", "nivelPorcentual"), 6) AS r2
FROM series WHERE "nivelPorcentual" IS NOT NULL AND "nivelEstanque" IS NOT NULL GROUP BY asset_id HAVING count(*) >= 2""",
    "scatter_pairs": f"""WITH {_SERIES} SELECT asset_id, "nivelPorcentual", "nivelEstanque" FROM series WHERE "nivelPorcentual" IS NOT NULL AND "nivelEstanque" IS NOT NULL
QUALIFY count(*) OVER (PARTITION BY asset_id) >= 2""",
    "missing_level_notes": """SELECT 'nivelEstanque' AS variable, string_agg(asset, '; ' ORDER BY asset) AS assets FROM (SELECT DISTINCT event_type AS asset FROM events WHERE event_type <= 'error')""",
    "asset_filter_range": """SELECT event_type AS asset_id, ts AS timestamp, event_id FROM events
WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20' AND regexp_matches(event_type, '(C|R)', 'i')""",
    "epoch_unit_inference": f"WITH {_CELLS} SELECT event_id, strategy, epoch_s FROM cells",
    "ts_strategy": f"WITH {_CELLS} SELECT CASE WHEN count(DISTINCT strategy) > 1 THEN 'mixed' ELSE any_value(strategy) END AS strategy, string_agg(DISTINCT strategy, ',' ORDER BY strategy) AS strategies FROM cells",
    "numeric_coerce": "SELECT event_id, CASE event_id % 6 WHEN 1 THEN 150.0 WHEN 3 THEN 0.5 WHEN 4 THEN -7.0 END::DOUBLE AS number FROM events",
    "asset_resolution": f"WITH {CUSTOMERS} SELECT n, coalesce(nullif(trim(label), ''), 'Tank ' || n % 3) AS asset_id FROM customers",
    "label_fallback": f"WITH {CUSTOMERS} SELECT n, coalesce(nullif(label, ''), nullif(name, ''), id) AS label FROM customers",
    "sanitize_label": rf"""WITH {CUSTOMERS} SELECT n, regexp_replace(regexp_replace(regexp_replace(coalesce(label, ''), '^\s+|\s+$', '', 'g'), '[<>:"/\\|?*\x00-\x1F]+', '_', 'g'), '\s+', ' ', 'g') AS label FROM customers""",
    "redact": """WITH t AS (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN left(c_name, 8) WHEN c_custkey % 9 = 0 THEN NULL ELSE c_name END AS x FROM customer)
SELECT c_custkey, CASE WHEN x IS NULL THEN NULL WHEN length(x) <= 8 THEN '***' ELSE left(x, 4) || '...' || right(x, 4) END AS redacted FROM t""",
    "name_filter": rf"""WITH {CUSTOMERS} SELECT n FROM customers WHERE trim(name) IN ('Customer#000000001', 'Tank: Customer#000000002  / A') OR trim(label) IN ('Customer#000000001', 'Tank: Customer#000000002  / A')""",
    # the zone is three hours behind UTC in all months that the table has
    "month_ranges": f"""WITH {_SERIES}, local AS (SELECT asset_id, date_trunc('month', timestamp - INTERVAL 3 HOUR)::TIMESTAMP AS start, timestamp FROM shifted),
months AS (SELECT DISTINCT start, start + INTERVAL 1 MONTH - INTERVAL 1 SECOND AS "end" FROM local)
SELECT asset_id, year(start) AS year, month(start) AS month, start, "end", epoch_ms(start + INTERVAL 3 HOUR) AS start_ms, epoch_ms("end" + INTERVAL 3 HOUR) AS end_ms, count(*) AS obs
FROM local JOIN months USING (start) WHERE timestamp <= "end" + INTERVAL 3 HOUR GROUP BY ALL""",
    "month_ranges_ms": f"""WITH {_SERIES}, bounds AS (SELECT date_trunc('day', max(timestamp))::TIMESTAMP AS last FROM shifted),
spans AS (SELECT DISTINCT date_trunc('month', timestamp)::TIMESTAMP AS start, least(date_trunc('month', timestamp) + INTERVAL 1 MONTH - INTERVAL 1 MILLISECOND, last) AS "end" FROM shifted, bounds)
SELECT asset_id, start, "end", count(*) AS obs FROM shifted JOIN spans ON date_trunc('month', timestamp) = start WHERE timestamp <= "end" GROUP BY ALL""",
    "export_worklist": f"WITH {_WORK} SELECT * FROM work",
    "resume_worklist": f"WITH {_WORK} SELECT * FROM work WHERE (c_custkey + month) % 3 <> 0",
    "payload_pivot": """WITH p AS (SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, epoch_us(date_trunc('minute', ts)) // 1000 AS ts, event_id, value::VARCHAR AS value FROM events)
SELECT event_type, day, ts, arg_max(value, event_id) FILTER (event_id % 2 = 1) AS "nivelEstanque", arg_max(value, event_id) FILTER (event_id % 2 = 0) AS "nivelPorcentual" FROM p GROUP BY ALL""",
    "payload_explode": """SELECT event_type, epoch_us(ts) // 1000 AS timestamp_ms, 'timeOn' AS key, value::VARCHAR AS value, make_timestamp(epoch_us(ts) // 1000 * 1000) AS datetime FROM events""",
    "catalog_extract": f"WITH {_PAGES} SELECT page, id, label, name FROM assets",
    "catalog_dedupe": f"WITH {_PAGES} SELECT DISTINCT label AS asset_label, id AS asset_id, name AS asset_name, 'ESTANQUES' AS asset_type FROM assets",
    "asset_types_regex": "SELECT DISTINCT type FROM (SELECT trim(p_type) AS type FROM part UNION ALL SELECT trim(p_brand) FROM part)",
    "asset_walk": f"WITH {_PAGES} SELECT page, id, name FROM pages WHERE name <> ''",
    "asset_walk_types": f"WITH {CUSTOMERS} SELECT DISTINCT coalesce(nullif(name, ''), nullif(label, '')) AS name, 't' || n % 4 AS type FROM customers WHERE coalesce(nullif(name, ''), nullif(label, '')) IS NOT NULL",
    "sample_head": "SELECT event_type AS asset_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) <= 7",
    "sample_alias": """WITH f AS (SELECT event_type AS asset_id, ts, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) = 1)
SELECT asset_id, printf('ASSET_%03d', row_number() OVER (ORDER BY ts, event_id)) AS alias FROM f""",
    "sample_anonymised": """WITH f AS (SELECT event_type, ts, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) = 1),
a AS (SELECT event_type, printf('ASSET_%03d', row_number() OVER (ORDER BY ts, event_id)) AS asset_id FROM f) SELECT asset_id, event_id FROM events JOIN a USING (event_type)""",
    "sample_first_assets": """WITH f AS (SELECT event_type FROM events GROUP BY event_type ORDER BY min((ts, event_id)) LIMIT 2) SELECT event_type AS asset_id, event_id FROM events JOIN f USING (event_type)""",
    "sample_round": "SELECT event_id, round_even(event_id / 8, 2)::DOUBLE AS x FROM events",
    "sample_manifest": """SELECT (SELECT string_agg(DISTINCT event_type, ',' ORDER BY event_type) FROM events) AS assets, strftime(min(ts), '%Y-%m-%dT%H:%M:%S') AS min, strftime(max(ts), '%Y-%m-%dT%H:%M:%S') AS max,
  'asset_id,timestamp,nivelPorcentual,nivelEstanque' AS columns, '{' || (SELECT string_agg('"' || event_type || '":' || n, ',' ORDER BY event_type) FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)) || '}' AS rows_per_asset FROM events""",
    "stream_completeness": """SELECT event_type AS asset_id, date_trunc('hour', ts) AS "window_start", count(*) AS obs, round(avg(value), 6) AS mean FROM events GROUP BY ALL""",
}
