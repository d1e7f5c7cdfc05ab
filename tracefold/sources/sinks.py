"""Answers in other forms: CSV, calendar entries, Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefold.operators.catalog import csv_cell


def write_csv(rows: DataFrame, columns: dict[str, Column], path: str) -> None:
    """CSV part files with a header in each, CRLF line ends, and cells that no spreadsheet takes for formulas."""
    header = ",".join(columns)
    lines = rows.select(F.concat(F.concat_ws(",", *[csv_cell(c) for c in columns.values()]), F.lit("\r")).alias("value"))
    lines.write.mode("overwrite").text(path + "/rows")
    rows.sparkSession.createDataFrame([(header + "\r",)], "value string").coalesce(1).write.mode("overwrite").text(path + "/header")


def calendar_text(s: Column) -> Column:
    """A text as calendars escape it."""
    s = F.regexp_replace(F.coalesce(s, F.lit("")), r"([\;,])", r"\\$1")
    return F.regexp_replace(s, r"\r?\n", r"\\n")


def calendar_entry(uid: Column, title: Column, starts: Column, ends: Column, place: Column, url: Column) -> Column:
    """An event as a VEVENT; times in UTC."""
    stamp = lambda t: F.date_format(t, "yyyyMMdd'T'HHmmss'Z'")
    parts = [
        F.lit("BEGIN:VEVENT"), F.concat(F.lit("UID:"), uid), F.concat(F.lit("DTSTART:"), stamp(starts)), F.concat(F.lit("DTEND:"), stamp(F.coalesce(ends, starts))),
        F.concat(F.lit("SUMMARY:"), calendar_text(title)), F.concat(F.lit("LOCATION:"), calendar_text(place)), F.concat(F.lit("URL:"), F.coalesce(url, F.lit(""))), F.lit("END:VEVENT"),
    ]
    return F.concat_ws("\r\n", *parts)


def markdown_row(cells: list[Column]) -> Column:
    bare = [F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"([|\r\n])", " ") for c in cells]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *bare), F.lit(" |"))
