"""Literal rows for tests: fields as tuples, tables with the ledger schemas."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession

from hearthbook import schema as S

MISSING = (None, "none", "missing", None, None)


def confirmed(value, source="userConfirmed"):
    return (value, source, "confirmed", None, None)


def suggested(value, source="billExtraction"):
    return (value, source, "suggested", None, None)


def day(text: str | None) -> dt.date | None:
    return None if text is None else dt.date.fromisoformat(text)


def bill(bill_id, amount=MISSING, due=None, *, household=1, kind="electricity", status="unknown",
         provider=MISSING, frequency="monthly", period_start=None, updated="2026-01-01", document=None):
    when = confirmed(day(due)) if isinstance(due, str) else (due or MISSING)
    stamp = dt.datetime.fromisoformat(updated)
    return (bill_id, household, kind, provider, amount, when, day(period_start), None, frequency,
            status, document, None, stamp, stamp)


def slot(kind, provider=MISSING, amount=MISSING, due=None, *, household=1, frequency="monthly",
         keys=(), account=MISSING):
    when = confirmed(day(due)) if due else MISSING
    return (f"svc-{household}-{kind}", household, kind, provider, account, amount, when, frequency,
            list(keys), None)


def bills(spark: SparkSession, rows) -> DataFrame:
    return spark.createDataFrame(list(rows), S.BILLS)


def slots(spark: SparkSession, rows) -> DataFrame:
    return spark.createDataFrame(list(rows), S.SERVICE_SLOTS)


def households(spark: SparkSession, *keys, current=None) -> DataFrame:
    rows = [(k, f"Home {k}", f"prop-{k}", current, True) for k in keys]
    return spark.createDataFrame(rows, S.HOUSEHOLDS)


def ids(frame: DataFrame, column: str) -> list:
    return [row[column] for row in frame.collect()]
