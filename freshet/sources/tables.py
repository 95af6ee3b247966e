"""Text tables, workbooks and project files as DataFrames."""

from __future__ import annotations

import io
import itertools
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cells import date_format_of, parsed_date, value_cell
from ..operators.frame import aligned, checks

SEPARATORS = (",", "\t", ";", "|")


def sniffed(line: str) -> str:
    """The most frequent separator of a line, the comma if there is none."""
    return max(SEPARATORS, key=lambda s: (line.count(s), s == ","))


def unique_names(names: list[str]) -> list[str]:
    """Header cells as column names: without a byte order mark and spaces; empty ones are called by their place, and of equal ones (in any
    case, as Spark takes names) the second is "name (2)" and so on."""
    out: list[str] = []
    for i, name in enumerate(names):
        name = (name or "").lstrip("\ufeff").strip() or f"column {i + 1}"
        taken, n, base = {c.lower() for c in out}, 1, name
        while name.lower() in taken:
            n += 1
            name = f"{base} ({n})"
        out.append(name)
    return out


def read_delimited(spark: SparkSession, path: str) -> DataFrame:
    """All cells as trimmed strings; the first row that is not blank is the header; blank rows go, short ones end in nulls, and cells
    beyond the header are dropped. A quoted cell may hold separators, line breaks and doubled quotes.

    Columns are read by place, so a header may hold dots or equal names. Files are split at line breaks between tasks unless
    the text has a quoted line break, which needs whole files a task; one pass over the lines finds that out: a line
    whose quotes do not pair goes on in the next one."""
    lines = spark.read.text(path)
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"')))
    look = lines.agg(F.max((quotes % 2 == 1).cast("int"))).first()[0] == 1
    first = lines.where(F.trim(F.replace("value", F.lit("\ufeff"))) != "").limit(1).collect()
    sep = sniffed(first[0][0]) if first else ","
    how = {"sep": sep, "mode": "PERMISSIVE", "quote": '"', "escape": '"', "multiLine": look, "ignoreLeadingWhiteSpace": True, "ignoreTrailingWhiteSpace": True}
    head = spark.read.options(header=False, **how).csv(path)
    filled = F.concat_ws("", *[F.trim(F.coalesce(F.col(c), F.lit(""))) for c in head.columns])
    header = head.where(filled != "").limit(1).collect() if head.columns else []
    if not header:
        return spark.createDataFrame([], T.StructType([]))
    cells = list(header[0])
    while len(cells) > 1 and not (cells[-1] or "").strip():
        cells.pop()
    names = unique_names(cells)
    # With a schema the rows are read by place; the header's own row, wherever a file has it, is left out.
    places = [f"c{i}" for i in range(len(names))]
    rows = spark.read.options(header=False, enforceSchema=True, **how).schema(T.StructType([T.StructField(c, T.StringType()) for c in places])).csv(path)
    same = F.lit(True)
    for c, cell in zip(places, cells, strict=True):
        rows_cell = F.coalesce(F.trim(F.replace(F.col(c), F.lit("\ufeff"))), F.lit(""))
        same = same & (rows_cell == (cell or "").lstrip("\ufeff").strip())
    blank = F.concat_ws("", *[F.coalesce(F.trim(c), F.lit("")) for c in places]) == ""
    return rows.where(~blank & ~same).select(*[F.trim(c).alias(n) for c, n in zip(places, names, strict=True)])


_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
#: Number formats that show a date.
_DATE_FORMATS = {*range(14, 23), *range(45, 48)}


def _cells(content: bytes) -> Iterator[tuple[int, int, list[str]]]:
    """(sheet, row, cells) of a workbook, row by row, blank rows aside. Dates come as ISO text."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        root = lambda name: ElementTree.fromstring(z.read(name)) if name in names else ElementTree.Element("none")
        shared = ["".join(t.text or "" for t in si.iter(f"{_NS}t")) for si in root("xl/sharedStrings.xml").iter(f"{_NS}si")]
        styles = root("xl/styles.xml")
        own = {int(f.get("numFmtId")): re.sub(r'"[^"]*"|\[[^\]]*\]', "", f.get("formatCode", "")) for f in styles.iter(f"{_NS}numFmt")}
        is_date = [(i := int(x.get("numFmtId", 0))) in _DATE_FORMATS or bool(re.search("[ymdhs]", own.get(i, ""), re.I)) for xs in styles.iter(f"{_NS}cellXfs") for x in xs]
        base = "1904-01-01" if any(p.get("date1904") in ("1", "true") for p in root("xl/workbook.xml").iter(f"{_NS}workbookPr")) else "1899-12-30"
        sheets = sorted((int(m[1]), n) for n in names if (m := re.fullmatch(r"xl/worksheets/sheet(\d+)\.xml", n)))
        for number, sheet in sheets:
            row_no = 0
            with z.open(sheet) as f:
                for _, row in ElementTree.iterparse(f):
                    if row.tag != f"{_NS}row":
                        continue
                    cells: dict[int, str] = {}
                    for c in row.iter(f"{_NS}c"):
                        v, kind = c.find(f"{_NS}v"), c.get("t")
                        text = "".join(t.text or "" for t in c.iter(f"{_NS}t")) if kind == "inlineStr" else (v.text or "" if v is not None else "")
                        at = 0
                        for x in re.match(r"[A-Z]+", c.get("r", "A1"))[0]:
                            at = at * 26 + ord(x) - 64
                        style = int(c.get("s", 0))
                        if kind == "s" and text:
                            text = shared[int(text)]
                        elif kind is None and text and style < len(is_date) and is_date[style]:
                            text = str(datetime.fromisoformat(base) + timedelta(seconds=round(float(text) * 86400)))
                        cells[at - 1] = text
                    row.clear()
                    if any(x.strip() for x in cells.values()):
                        yield number, row_no, [cells.get(i, "") for i in range(max(cells) + 1)]
                        row_no += 1


def workbook_rows(spark: SparkSession, path: str) -> DataFrame:
    """(path, sheet, row_no, cells) of all workbooks under a path, each read by one task, row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = _cells(content)
                while part := list(itertools.islice(rows, 5000)):
                    sheet, row_no, cells = zip(*part, strict=True)
                    yield pa.RecordBatch.from_pydict({"path": [name] * len(part), "sheet": pa.array(sheet, pa.int32()), "row_no": pa.array(row_no, pa.int32()), "cells": pa.array(cells, pa.list_(pa.string()))})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, sheet int, row_no int, cells array<string>")


def _sheets(rows: DataFrame) -> list[int]:
    """Sheets with two or more rows that are not blank."""
    return [r[0] for r in rows.groupBy("sheet").count().where("count > 1").orderBy("sheet").collect()]


def read_workbook(spark: SparkSession, path: str) -> DataFrame:
    """The first sheet of a workbook with two or more rows that are not blank, all cells as strings. Only the header row comes to the
    driver."""
    rows = workbook_rows(spark, path)
    sheets = _sheets(rows)
    if not sheets:
        return spark.createDataFrame([], T.StructType([]))
    first = rows.where(F.col("sheet") == sheets[0])
    names = [c.strip() or f"c{i}" for i, c in enumerate(first.where("row_no = 0").select("cells").collect()[0][0])]
    return first.where("row_no > 0").select(*[F.coalesce(F.get("cells", F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(names)])


def workbook_notes(spark: SparkSession, path: str) -> list[str]:
    """What a reader of a workbook should know: other sheets that are left out."""
    more = len(_sheets(workbook_rows(spark, path))) - 1
    return [f"{more} other sheets with data are left out"] if more > 0 else []


def from_grid(spark: SparkSession, rows: list[tuple], runs: int = 1) -> DataFrame:
    """Cells of a grid on screen by position; see ``from_paste`` for text."""
    return from_paste(spark, "\n".join("\t".join("" if x is None else str(x) for x in r) for r in rows), runs)


def from_paste(spark: SparkSession, text: str, runs: int = 1) -> DataFrame:
    """Pasted cells, separated by tabs (else commas or semicolons) and line ends, by position: date, observed, simulated 1 to n. Blank rows
    go."""
    names = ["Date", "Observed", *[f"Simulated {i + 1}" for i in range(runs)]]
    lines = spark.createDataFrame([(text,)], "text string").select(F.explode(F.split("text", r"\r?\n")).alias("line"))
    cells = F.when(F.contains("line", F.lit("\t")), F.split("line", "\t")).otherwise(F.split("line", "[,;]"))
    table = lines.select(*[F.trim(F.coalesce(F.get(cells, F.lit(i)), F.lit(""))).alias(n) for i, n in enumerate(names)])
    return table.where(F.concat_ws("", *[F.col(f"`{n}`") for n in names]) != "")


def unit_of(header: str) -> tuple[str, str | None]:
    """(name, unit) of a header such as ``flow [cfs]``."""
    m = re.search(r"\[\s*(m3/s|cfs|l/s)\s*\]", header, re.IGNORECASE)
    return re.sub(r"\s*\[[^\]]*\]\s*", "", header).strip(), {"m3/s": "m3s", "cfs": "cfs", "l/s": "ls"}[m[1].lower()] if m else None


def guessed_roles(header: list[str]) -> list[str]:
    """date, observed, run or ignore for each column: the first is the date; without an observed one the first run is it."""
    roles = ["date" if i == 0 else "observed" if re.search("obs", h, re.I) else "ignore" if re.search("date|time", h, re.I) else "run" for i, h in enumerate(header)]
    for i, r in enumerate(roles):
        if r == "observed" and "observed" in roles[:i]:
            roles[i] = "run"
    if "observed" not in roles and "run" in roles:
        roles[roles.index("run")] = "observed"
    return roles


def staged(table: DataFrame, roles: list[str] | None = None, date_format: str = "auto", missing: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(series, checks) of a text table: dates and values parsed, repeated dates dropped (the first row wins), a series a run.
    Dates of an ambiguous order are an error, as is a table without a date, an observed and a run column."""
    roles = roles or guessed_roles(table.columns)
    pick = lambda r: [c for c, x in zip(table.columns, roles, strict=True) if x == r]
    if not (pick("date") and pick("observed") and pick("run")):
        raise ValueError("a table needs a date, an observed and a run column")
    date, observed = pick("date")[0], pick("observed")[0]
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    kind = date_format_of(table.select(quoted(date).alias("date")), "date") if date_format == "auto" else date_format
    if kind == "ambiguous":
        raise ValueError("day and month can't be told apart; give the date format")
    numbered = table.withColumn("row_no", F.monotonically_increasing_id())
    runs = unique_names([unit_of(r)[0] for r in pick("run")])  # two runs may differ in their unit only
    values = F.array(*[F.struct(F.lit(n).alias("series_id"), value_cell(quoted(c), missing).alias("sim")) for n, c in zip(runs, pick("run"), strict=True)])
    long = numbered.select("row_no", parsed_date(quoted(date), kind).alias("ts"), value_cell(quoted(observed), missing).alias("obs"), F.inline(values))
    return aligned(long).select("series_id", "ts", "obs", "sim"), checks(long.select("series_id", "ts", "obs", "sim"))


_SERIES = "struct<name:string,unit:string,values:array<double>>"
PROJECT = f"schemaVersion int, activeDatasetId string, datasets array<struct<id:string,name:string,unit:string,lat:double,lon:double,area:double,dates:array<bigint>,observed:{_SERIES},runs:array<struct<id:string,name:string,visible:boolean,values:array<double>>>>>"


def read_project(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(series, skipped) of a project file: keys outside the schema are dropped, data sets whose arrays differ in length are skipped
    with a reason, and rows are put in order with the first of a date kept."""
    doc = spark.read.schema(PROJECT).option("multiLine", True).json(path)
    if doc.where("schemaVersion <> 1 or schemaVersion is null").limit(1).count():
        raise ValueError("not a project file of schema version 1")
    d = doc.select(F.explode("datasets").alias("d")).select("d.*")
    n = F.size("dates")
    bad = F.when(F.col("dates").isNull() | (n == 0), "no dates").when(F.size(F.col("observed.values")) != n, "observed values do not fit the dates").when(F.exists("runs", lambda r: F.size(r["values"]) != n), "a run's values do not fit the dates")
    good = d.where(bad.isNull())
    r = good.select("id", "dates", "observed", F.explode("runs").alias("r"))
    z = r.select(F.concat_ws("/", "id", "r.id").alias("series_id"), F.posexplode(F.arrays_zip("dates", F.col("observed.values").alias("o"), F.col("r.values").alias("s"))).alias("row_no", "z"))
    long = z.select("series_id", "row_no", F.timestamp_millis(F.col("z.dates")).alias("ts"), F.col("z.o").alias("obs"), F.col("z.s").alias("sim"))
    return aligned(long).drop("row_no"), d.where(bad.isNotNull()).select("id", bad.alias("reason"))


def read_series(spark: SparkSession, path: str) -> DataFrame:
    """Series as Parquet; time stamps without a zone count as UTC."""
    df = spark.read.parquet(path)
    return df.withColumn("ts", F.col("ts").cast("timestamp"))
