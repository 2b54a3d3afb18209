"""``python -m tidemark integrity|tanks|sample|export|catalog``: reports, samples, exports and catalogs from the command line."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions import bounds, scalars
from .operators import calendar, catalog, payload, reports, sampling
from .roles import GROUP_KEYS
from .session import configured
from .sources import csvs, rest, writers


# The names of the options.
def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    top = argparse.ArgumentParser(prog="tidemark")
    kinds = top.add_subparsers(dest="kind", required=True)
    for kind in ("integrity", "tanks"):
        p = kinds.add_parser(kind)
        p.add_argument("--input-dir", required=True)
        p.add_argument("--group", default="")
        which = p.add_mutually_exclusive_group()
        which.add_argument("--asset", help="pattern found in the asset's name")
        which.add_argument("--all", action="store_true")
        p.add_argument("--start-date")
        p.add_argument("--end-date")
        p.add_argument("--freq-minutes", type=int, default=1)
        p.add_argument("--output", required=True)
        p.add_argument("--format", choices=("parquet", "csv"), default="parquet")
    p = kinds.add_parser("sample")
    p.add_argument("--input", required=True)
    p.add_argument("--out-dir", required=True)
    p.add_argument("--group", required=True)
    p.add_argument("--assets", type=int, help="the first so many assets to appear")
    p.add_argument("--asset-labels", nargs="+", help="these assets; comes before --assets")
    p.add_argument("--max-rows", type=int)
    p.add_argument("--round", type=int, dest="digits")
    p.add_argument("--drop-identifiers", action="store_true")
    p = kinds.add_parser("export")
    p.add_argument("--url", help="the service; default TIDEMARK_URL")
    p.add_argument("--asset-type", nargs="+", default=[], metavar="GROUP=TYPE", help="the service's name for the assets of a group; default the group's name")
    p.add_argument("--timezone", help="default TIDEMARK_TIMEZONE, else UTC")
    p.add_argument("--headers", help="a JSON file of more request headers")
    p.add_argument("--start-ym", required=True)
    p.add_argument("--end-ym", required=True)
    p.add_argument("--outdir", default="output/monthly")
    p.add_argument("--groups", nargs="+", choices=sorted(GROUP_KEYS), default=sorted(GROUP_KEYS))
    p.add_argument("--only", help="names or labels, comma-separated")
    p.add_argument("--resume", action="store_true")
    p.add_argument("--overwrite", action="store_true")
    p = kinds.add_parser("catalog")
    p.add_argument("--url", help="the service; default TIDEMARK_URL, needed with --asset-type")
    p.add_argument("--asset-type", nargs="+", default=[], metavar="TYPE", help="list the service's assets of these types")
    p.add_argument("--headers", help="a JSON file of more request headers")
    p.add_argument("--messages", help="a folder of landed JSON messages, one a file")
    p.add_argument("--output", required=True)
    return top.parse_args(argv)


def report(spark: SparkSession, a: argparse.Namespace) -> dict:
    start, end = bounds.parse_bound(a.start_date), bounds.parse_bound(a.end_date, True, max(1, a.freq_minutes))
    scan = csvs.read_series(spark, a.input_dir, levels=a.kind == "tanks")
    run = {"group": a.group, "input": a.input_dir, "output": a.output}
    if a.kind == "integrity":
        tables = reports.integrity_report(scan.rows, a.freq_minutes, start, end, a.asset, scan.files, run)
    else:
        tables = reports.tank_report(scan.rows, 20, start, end, a.asset, (csvs.FILE,), scan.files, run)
    tables["Skipped"] = scan.skipped
    tables["Files"] = scan.files if a.format == "parquet" else scan.files.withColumn("columns", F.array_join("columns", ","))
    writers.write_report(tables, a.output, a.format)
    return tables


def sample(spark: SparkSession, a: argparse.Namespace) -> None:
    rows, _, asset = csvs.read_sample_input(spark, a.input)
    rows = rows.where("timestamp IS NOT NULL")
    order = ["timestamp", *(f"`{c}`" for c in rows.columns if c != "timestamp")]  # no ties but those of equal rows
    if asset and a.asset_labels:
        rows = sampling.only_assets(rows, asset, a.asset_labels)
    elif asset and a.assets:
        rows = sampling.first_assets(rows, asset, a.assets, order)
    rows = sampling.head(rows, a.max_rows, order, asset)
    if a.digits is not None:
        others = [c for c in rows.columns if c not in ("timestamp", asset)]
        odd = rows.agg(*(F.count(F.when(F.col(f"`{c}`").isNotNull() & scalars.to_number(F.col(f"`{c}`")).isNull(), 1)) for c in others)).first() if others else ()
        numbers = [c for c, n in zip(others, odd, strict=True) if not n]
        rows = sampling.rounded(rows.withColumns({c: scalars.to_number(F.col(f"`{c}`")) for c in numbers}), a.digits)
    if asset:
        rows = sampling.anonymised(rows, asset, order, a.drop_identifiers)
    writers.write_samples(rows.orderBy(*order), f"{a.out_dir}/sample_{a.group}", asset)
    given = {"input": a.input, "group": a.group, "max_rows": str(a.max_rows), "round": str(a.digits)}
    writers.write_manifest(sampling.manifest(rows, "timestamp", asset, given), f"{a.out_dir}/manifest")


def _headers(a: argparse.Namespace, settings: bounds.Settings) -> dict[str, str]:
    given = bounds.request_headers(settings.cookie, settings.authorization) + (bounds.headers_from(a.headers) if a.headers else [])
    return dict(h.split(": ", 1) for h in given)


def list_catalog(spark: SparkSession, a: argparse.Namespace) -> None:
    """Write the assets of the service's types and of landed messages, one row an id, and the types that messages name."""
    rows = spark.createDataFrame([], "id string, name string, label string, type string, source int, at string")
    if a.asset_type:
        rest.register(spark)
        settings = bounds.Settings.from_env(url=a.url)
        headers = _headers(a, settings)
        for kind in a.asset_type:
            url = rest.assets_url(settings.url.rstrip("/"), headers, kind)
            found = spark.read.format("telemetry_service").options(kind="assets", url=url, headers=json.dumps(headers)).load()
            label, name, id_ = F.col("label"), F.col("name"), F.col("id")
            rows = rows.unionByName(found.select("id", scalars.label_or_name_or_id(name, label, id_).alias("name"), scalars.label_or_name_or_id(label, name, id_).alias("label"), F.lit(kind).alias("type"), F.lit(2).alias("source"), F.lit("").alias("at")))
    types = spark.createDataFrame([(t,) for t in a.asset_type], "type string")
    if a.messages:
        texts = spark.read.option("recursiveFileLookup", True).text(a.messages, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
        walked = catalog.walk_entities(texts, "value").select("id", "name", F.col("name").alias("label"), F.lit(None).cast("string").alias("type"), F.lit(0).alias("source"), F.col("file").alias("at"))
        listed = catalog.extract_assets(texts, "value").select("id", "name", "label", F.lit(None).cast("string").alias("type"), F.lit(1).alias("source"), F.format_string("%s %09d", "file", "at").alias("at"))
        rows = rows.unionByName(walked).unionByName(listed)
        types = types.unionByName(catalog.asset_types(texts, "value")).unionByName(catalog.walk_types(texts, "value").select("type"))
    # of what messages say of an id the listing counts, the service before both
    writers.write_catalog(catalog.catalog(catalog.last_of_each(rows, "id", ["source", "at", "name", "label"])), f"{a.output}/assets")
    writers.write_catalog(types.distinct().orderBy("type"), f"{a.output}/types")


def export(spark: SparkSession, a: argparse.Namespace) -> int:
    """Fetch what is asked for and not there yet, group by group; gives the number of asset-months fetched."""
    rest.register(spark)
    settings = bounds.Settings.from_env(url=a.url, zone=a.timezone)
    headers = _headers(a, settings)
    kinds = dict(t.split("=", 1) for t in a.asset_type)
    months = calendar.month_ranges(spark, a.start_ym, a.end_ym, settings.zone).drop("start", "end")
    return sum(_export_group(spark, a, settings.url.rstrip("/"), headers, group, kinds.get(group, group), months) for group in a.groups)


def _export_group(spark: SparkSession, a: argparse.Namespace, base: str, headers: dict[str, str], group: str, kind: str, months) -> int:
    service = spark.read.format("telemetry_service").option("headers", json.dumps(headers))
    assets = service.options(kind="assets", url=rest.assets_url(base, headers, kind)).load()
    assets = assets.where(scalars.named(F.col("name"), F.col("label"), bounds.name_list(a.only)))
    assets = assets.select(F.col("id").alias("asset_id"), F.col("name").alias("asset_name"), scalars.label_or_name_or_id(F.col("label"), F.col("name"), F.col("id")).alias("asset_label"))
    work = calendar.work_list(assets, months)
    if a.resume and not a.overwrite and (done := writers.written(spark, a.outdir)) is not None:
        done = done.where(F.col("group") == group)
        work = work.withColumn("asset", scalars.sanitize(F.col("asset_label"))).join(done.drop("group"), ["asset", "year", "month"], "left_anti").drop("asset")
    todo = [r.asDict() for r in work.toLocalIterator()]  # a list of requests to make
    if not todo:
        return 0
    keys = GROUP_KEYS[group]
    points = service.options(kind="series", url=f"{base}/api/plugins/telemetry/ASSET", keys=",".join(keys), work=json.dumps(todo)).load()
    whole = F.when(F.col("truncated"), F.raise_error(F.lit("a millisecond holds more points than one answer"))).otherwise(F.col("value"))
    wide = payload.widen(points.withColumn("value", whole), list(keys), ["asset_id", "year", "month"])
    asked = spark.createDataFrame([(t["asset_id"], t["asset_name"], t["asset_label"], t["year"], t["month"]) for t in todo], "asset_id string, asset_name string, asset_label string, year int, month int")
    columns = ["asset_id", "asset_name", "asset_label", "year", "month", "ts", *sorted(keys)]
    writers.write_wide(wide.join(asked.select("asset_id", "asset_name", "asset_label").distinct(), "asset_id").select(columns), a.outdir, group)
    writers.mark_fetched(asked, a.outdir, group)
    return len(todo)


def main(argv: list[str] | None = None) -> None:
    a = arguments(argv)
    spark = configured(SparkSession.builder.appName("tidemark")).getOrCreate()
    {"integrity": report, "tanks": report, "sample": sample, "export": export, "catalog": list_catalog}[a.kind](spark, a)


if __name__ == "__main__":
    main(sys.argv[1:])
