"""Exports: metric and event tables as text, plot data, project files, report tables."""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Sequence
from dataclasses import asdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cells import safe_cell, shown_number
from ..plans.config import EvalConfig
from ..plans.registry import TIMING_SUMMARY


def metric_table(metrics: DataFrame, registry: DataFrame, runs: list[str]) -> DataFrame:
    """A row a metric in display order, a column a run, numbers with the metric's digits."""
    x = metrics.join(F.broadcast(registry.select("metric_id", "label", "ordinal", "digits")), "metric_id")
    text = F.lit("n/a")
    for d in range(5):
        text = F.when(F.col("digits") == d, shown_number(F.col("value"), d)).otherwise(text)
    return x.withColumn("text", text).groupBy("ordinal", "metric_id", "label").pivot("series_id", runs).agg(F.first("text"))


def with_intervals(metrics: DataFrame, ci: DataFrame) -> DataFrame:
    return metrics.join(ci, ["series_id", "metric_id"], "left").select("series_id", "metric_id", "value", "lo", "hi")


def write_text(df: DataFrame, path: str, sep: str = ",") -> None:
    """Delimited text with a header; cells are guarded against being read as formulas."""
    safe = df.select(*[safe_cell(F.col(f"`{c}`").cast("string")).alias(c) for c in df.columns])
    safe.write.mode("overwrite").options(header=True, sep=sep, escape='"').csv(path)


def plot_rows(traces: dict[str, DataFrame], x: str, y: str) -> DataFrame:
    """(trace, x, y) of several plots' data."""
    parts = [df.select(F.lit(name).alias("trace"), F.col(x).cast("string").alias("x"), F.col(y).cast("double").alias("y")) for name, df in traces.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def project_documents(series: DataFrame, dataset_id: str = "dataset") -> DataFrame:
    """One JSON document a data set, missing values as null: dates, observed and runs in time order. Values sit in one document, as
    the file format asks, so this is for data sets that one file can hold."""
    by_run = series.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("ts", "obs", "sim"))).alias("v"))
    run = F.struct(F.col("series_id").alias("id"), F.col("series_id").alias("name"), F.lit(True).alias("visible"), F.transform("v", lambda x: x["sim"]).alias("values"))
    first = F.min_by(F.struct(F.transform("v", lambda x: F.unix_millis(x["ts"])).alias("dates"), F.struct(F.transform("v", lambda x: x["obs"]).alias("values")).alias("observed")), "series_id")
    doc = by_run.agg(first.alias("f"), F.array_sort(F.collect_list(run)).alias("runs"))
    data = F.struct(F.lit(dataset_id).alias("id"), F.col("f.dates").alias("dates"), F.col("f.observed").alias("observed"), "runs")
    return doc.select(F.to_json(F.struct(F.lit(1).alias("schemaVersion"), F.lit(dataset_id).alias("activeDatasetId"), F.array(data).alias("datasets")), {"ignoreNullFields": "false"}).alias("value"))


def report_tables(metrics: DataFrame, registry: DataFrame, errors: DataFrame, runs: list[str], chunk: int = 4, events: int = 12) -> dict[str, DataFrame]:
    """The tables of a report: metrics in groups of run columns, and the first events in time order."""
    parts = {f"metrics_{i // chunk + 1}": metric_table(metrics, registry, runs[i : i + chunk]) for i in range(0, len(runs), chunk)}
    return parts | {"events": errors.where(F.col("event_no") < events).orderBy("series_id", "event_no")}


def write_markdown(df: DataFrame, path: str) -> None:
    """A table as Markdown text, all rows: a folder with the head in one file, and the rows in others after it."""
    shown = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("n/a")) for c in df.columns]
    bar = lambda cells: F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    head = "\n".join("| " + " | ".join(x) + " |" for x in (df.columns, ["---"] * len(df.columns)))
    first = df.sparkSession.range(1, numPartitions=1).select(F.lit(head).alias("value"))
    first.union(df.select(bar(shown).alias("value"))).write.mode("overwrite").text(path)


def write_one_file(lines: DataFrame, order: list[str | Column], path: str, head: Sequence[str] = ()) -> None:
    """``lines`` (value, ...) as one text file called ``path``: the lines of ``head``, then the values by ``order``. The rows are sorted
    and written in ranges by all tasks; the parts are then joined by their order, as a stream of bytes, and put in place under their name
    when whole. Without rows the file is the head alone."""
    spark, parts = lines.sparkSession, f"{path}.{uuid.uuid4().hex}"
    lines.orderBy(*order).select("value").write.text(parts)
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    where = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    target, folder, joining = where(path), where(parts), where(f"{parts}.joined")
    files = target.getFileSystem(conf)
    out = files.create(joining, True)
    try:
        out.write(bytearray("".join(f"{x}\n" for x in head).encode()))
        for part in sorted(f.getPath().toString() for f in files.listStatus(folder) if f.getPath().getName().startswith("part-")):
            rows = files.open(where(part))
            try:
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(rows, out, 1 << 20, False)
            finally:
                rows.close()
    finally:
        out.close()
    files.delete(target, True)
    files.rename(joining, target)
    files.delete(folder, True)


def export_head(dataset: str, rows: int, step: str, unit: str, cfg: EvalConfig, when: dt.datetime | None = None) -> list[str]:
    """The five lines before an exported table: what made it, when, from which data, and under which settings."""
    when = when or dt.datetime.now(dt.timezone.utc)
    return [
        "# freshet metrics", f"# exported {when.isoformat(timespec='seconds')}", f"# dataset: {dataset} ({rows} rows, step {step}, unit {unit})",
        f"# settings: nan={cfg.nan_policy}; transform={cfg.transform}; benchmark={cfg.benchmark}", f"# timing config: {json.dumps(asdict(cfg.timing))}",
    ]


def metric_columns(metrics: DataFrame, registry: DataFrame, runs: list[str], ci: DataFrame | None = None) -> DataFrame:
    """(ordinal, metric, group, optimum, and for each run its value): the exported table, values as they are. With ``ci`` (series_id,
    metric_id, lo, hi) each run also has the ends of its interval, except for timing metrics, which have none."""
    x = with_intervals(metrics, ci) if ci is not None else metrics
    x = x.join(F.broadcast(registry.select("ordinal", "metric_id", F.col("label").alias("metric"), F.col("grp").alias("group"), "optimum", "timing")), "metric_id")
    cells = [F.first("value", ignorenulls=True).alias("v")]
    if ci is not None:
        cells += [F.first(F.when(~F.col("timing"), F.col(c)), ignorenulls=True).alias(c) for c in ("lo", "hi")]
    wide = x.groupBy("ordinal", "metric", "group", "optimum").pivot("series_id", runs).agg(*cells)
    if ci is None:
        return wide
    named = lambda r, c, name: F.col(f"`{r}_{c}`").alias(name)
    return wide.select("ordinal", "metric", "group", "optimum", *[y for r in runs for y in (named(r, "v", r), named(r, "lo", f"{r} ci95_lo"), named(r, "hi", f"{r} ci95_hi"))])


def write_metrics_file(metrics: DataFrame, registry: DataFrame, runs: list[str], path: str, head: Sequence[str], ci: DataFrame | None = None, sep: str = ",") -> None:
    """The exported table as one file in display order: the five lines of ``export_head``, a header, a line a metric. What is not
    available is an empty cell; text is guarded against being read as a formula."""
    table = metric_columns(metrics, registry, runs, ci)
    options = {"sep": sep, "escape": '"', "emptyValue": "", "nullValue": "", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    names = [c for c in table.columns if c != "ordinal"]
    cells = [safe_cell(F.col(f"`{c}`").cast("string")).alias(f"c{i}") for i, c in enumerate(names)]
    line = lambda struct: F.to_csv(struct, options)
    title = table.sparkSession.range(1).select(line(F.struct(*[safe_cell(F.lit(c)).alias(f"c{i}") for i, c in enumerate(names)])).alias("value"), F.lit(-1).alias("ordinal"))
    write_one_file(title.unionByName(table.select(line(F.struct(*cells)).alias("value"), "ordinal")), ["ordinal"], path, head)


def read_metrics_file(spark: SparkSession, path: str, runs: list[str], sep: str = ",") -> DataFrame:
    """(series_id, metric, value, lo, hi) of a file of ``write_metrics_file``; without interval columns lo and hi are NULL."""
    table = spark.read.options(header=True, sep=sep, escape='"', comment="#").csv(path)
    number = lambda c: F.col(f"`{c}`").cast("double") if c in table.columns else F.lit(None).cast("double")
    cells = F.array(*[F.struct(F.lit(r).alias("series_id"), number(r).alias("value"), number(f"{r} ci95_lo").alias("lo"), number(f"{r} ci95_hi").alias("hi")) for r in runs])
    return table.select("metric", F.inline(cells)).select("series_id", "metric", "value", "lo", "hi")


def write_markdown_file(df: DataFrame, path: str, order: list[str | Column]) -> None:
    """A table as one Markdown file with its rows by ``order``; bars in cells are escaped and line breaks become spaces."""
    safe = lambda c: F.regexp_replace(F.regexp_replace(c, r"\r?\n", " "), r"\|", r"\\|")
    shown = [F.coalesce(safe(F.col(f"`{c}`").cast("string")), F.lit("n/a")) for c in df.columns]
    bar = F.concat(F.lit("| "), F.concat_ws(" | ", *shown), F.lit(" |"))
    head = ["| " + " | ".join(c.replace("|", "\\|") for c in x) + " |" for x in (df.columns, ["---"] * len(df.columns))]
    write_one_file(df.withColumn("value", bar), order, path, head)


def timing_summary(metrics: DataFrame, registry: DataFrame, runs: list[str]) -> DataFrame:
    """(ordinal, metric_id, label, optimum, a column a run): the timing metrics of the short preset, with their digits."""
    ids = registry.where(F.col("metric_id").isin(list(TIMING_SUMMARY))).select("ordinal", "metric_id", "label", "optimum", "digits")
    table = metric_table(metrics, ids, runs)
    return ids.select("metric_id", "optimum").join(table, "metric_id").select("ordinal", "metric_id", "label", "optimum", *[F.col(f"`{r}`") for r in runs])
