"""Workbooks, report files and written tables, each read back after writing."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from datetime import date

import pandas as pd
from pyspark.sql import functions as F

from fleetcast.catalog.accuracy import AGGREGATE_SQL, NAIVE, naive_forecast
from fleetcast.catalog.base import query, sql
from fleetcast.functions import dates
from fleetcast.operators import metrics, validate
from fleetcast.plans import assemble
from fleetcast.session import materialize, scratch_folder
from fleetcast.sources import sinks, star, workbook

_NS = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def workbook_bytes(name: str, days: list[date], values: list[float]) -> bytes:
    """A minimal workbook: shared and inline texts, serial dates, numbers."""
    rows = ['<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="C1" t="inlineStr"><is><t>Unnamed: 3</t></is></c></row>']
    for i, (day, value) in enumerate(zip(days, values), start=2):
        rows.append(f'<row r="{i}"><c r="A{i}" s="1"><v>{(day - workbook.DAY_ZERO).days}</v></c><c r="B{i}"><v>{value!r}</v></c></row>')
    parts = {
        "xl/workbook.xml": f'<workbook xmlns="{_NS}" xmlns:r="{_REL}"><sheets><sheet name="data" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/sharedStrings.xml": f'<sst xmlns="{_NS}"><si><t>Date</t></si><si><t>{name}</t></si></sst>',
        "xl/styles.xml": f'<styleSheet xmlns="{_NS}"><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{_NS}"><sheetData>{"".join(rows)}</sheetData></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for path, text in parts.items():
            archive.writestr(path, text)
    return out.getvalue()


def workbook_files(product):
    """One workbook per series, in the layout of a folder of binary files."""
    packed = product.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("ds", "y"))).alias("rows"))

    def batches(pages: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for page in pages:
            yield pd.DataFrame({
                "path": page["series_id"].map(lambda s: f"/{s}.xlsx"),
                "content": [workbook_bytes(s, list(d), [float(v) for v in y]) for s, d, y in zip(page["series_id"], page["ds"], page["y"])]})

    return packed.select("series_id", "rows.ds", "rows.y").mapInPandas(batches, "path string, content binary")


@query("s3_workbook_source", sql("SELECT series_id, ds, y FROM product_monthly"))
def s3(spark, d):
    cells = workbook.parse_workbooks(workbook_files(star.product_monthly(spark, d)))
    return validate.typed_long(workbook.cells_to_long(cells))


_METHODS = ("last_value", "seasonal_naive")


@query("s6_csv_sink", sql("""
SELECT series_id, strftime(ds, '%d-%m-%Y') AS "Date", MAX(yhat) FILTER (WHERE method = 'last_value') AS last_value,
       MAX(yhat) FILTER (WHERE method = 'seasonal_naive') AS seasonal_naive FROM fc GROUP BY 1, ds""", NAIVE))
def s6(spark, d):
    wide = assemble.methods_wide(naive_forecast(spark, d), _METHODS).select(
        "series_id", dates.report_date(F.col("ds")).alias("Date"), *_METHODS)
    path = scratch_folder(spark, "forecast-csv")
    sinks.write_csv(wide, path)
    return sinks.read_report_csv(spark, path, "series_id string, Date string, last_value double, seasonal_naive double")


@query("s7_report_bundle", sql(f"""
SELECT series_id, method, 'MAPE' AS family, {AGGREGATE_SQL['mape']} AS average, {AGGREGATE_SQL['mape_total']} AS total FROM fc GROUP BY 1, 2
UNION ALL SELECT series_id, method, 'SMAPE', {AGGREGATE_SQL['smape']}, {AGGREGATE_SQL['smape_total']} FROM fc GROUP BY 1, 2
UNION ALL SELECT series_id, method, 'MAE', {AGGREGATE_SQL['mae']}, {AGGREGATE_SQL['mae_total']} FROM fc GROUP BY 1, 2""", NAIVE))
def s7(spark, d):
    """Report families written as a bundle and read back from their folders."""
    report = metrics.report(materialize(naive_forecast(spark, d), "compared"))
    written = sinks.write_bundle({f: report[f][0] for f in ("MAPE", "SMAPE", "MAE")}, scratch_folder(spark, "bundle"), "run", ("parquet",))
    parts = []
    for family in ("MAPE", "SMAPE", "MAE"):
        average, total, *_ = metrics.FAMILIES[family][0]
        parts.append(spark.read.parquet(written[f"parquet:{family}"]).select(
            "series_id", "method", F.lit(family).alias("family"), F.col(average).alias("average"), F.col(total).alias("total")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("s8_written_tables", sql("SELECT series_id, ds, y FROM product_daily"))
def s8(spark, d):
    return materialize(star.product_daily(spark, d), "daily")
