"""Ledger tables as stored: field columns may be JSON text, transcripts are private."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from hearthbook import schema as S
from hearthbook.functions import coerce, fields as P
from hearthbook.sources.documents import value_text

FIELD_COLUMNS = {
    "service_slots": {
        "provider": S.TEXT_FIELD,
        "account_number": S.TEXT_FIELD,
        "amount_minor": S.MONEY_FIELD,
        "next_due_date": S.DATE_FIELD,
    },
    "bills": {
        "provider": S.TEXT_FIELD,
        "amount_minor": S.MONEY_FIELD,
        "due_date": S.DATE_FIELD,
    },
}


def _camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(part.title() for part in rest)


_READERS = {"string": value_text, "bigint": coerce.as_int, "date": coerce.as_date}


def _stored(text: Column) -> Column:
    """The members of a field's JSON text, still undecoded; null for what is no JSON object."""
    return coerce.whole_object(text, f"struct<{P.STORED}>")


def field_from_json(text: Column, field: T.StructType) -> Column:
    """A field from its JSON text, read as tolerantly as those of documents.

    Values are read by what they are (`"12"` is an amount of 12), unknown names fall back, and text
    that can't be read gives a missing field; ``unreadable_fields`` says what was not understood.
    """
    reader = _READERS[field["value"].dataType.simpleString()]
    return F.get(F.transform(F.array(_stored(text)), lambda stored: P.decode(stored, reader)), F.lit(0))


def decode_fields(table: DataFrame, name: str) -> DataFrame:
    """Turn the JSON text columns of a stored table into field structs."""
    fields = FIELD_COLUMNS[name]
    return table.withColumns({c: field_from_json(F.col(c), t) for c, t in fields.items()})


def _problems(text: Column, field: T.StructType) -> Column:
    """Codes of what decoding a field's text left out; none for null text."""
    reader = _READERS[field["value"].dataType.simpleString()]

    def codes(stored: Column) -> Column:
        when = stored["recordedAt"]
        return F.array_compact(F.array(
            F.when(stored.isNull(), "not_an_object"),
            F.when(P.undecodable(stored, reader), "unreadable_value"),
            F.when(~F.coalesce(stored["source"], F.lit("none")).isin(*S.FIELD_SOURCES), "unknown_source"),
            F.when(~F.coalesce(stored["status"], F.lit("missing")).isin(*S.FIELD_STATUSES), "unknown_status"),
            F.when(when.isNotNull() & coerce.timestamp(when).isNull(), "unreadable_time"),
        ))

    found = F.get(F.transform(F.array(_stored(text)), codes), F.lit(0))
    return F.when(text.isNotNull(), found).otherwise(F.array().cast("array<string>"))


def unreadable_fields(table: DataFrame, name: str, *keys: str) -> DataFrame:
    """``*keys, field, codes, text``: the stored fields of which decoding leaves something out."""
    each = F.array(*[
        F.struct(F.lit(c).alias("field"), _problems(F.col(c), t).alias("codes"), F.col(c).alias("text")) for c, t in FIELD_COLUMNS[name].items()
    ])
    return table.select(*keys, F.inline(F.filter(each, lambda e: F.size(e["codes"]) > 0)))


def encode_fields(table: DataFrame, name: str) -> DataFrame:
    """Field structs back to JSON text, nulls written out."""
    def text(column: str) -> Column:
        renamed = F.struct(*[F.col(column)[f].alias(_camel(f)) for f in S.TEXT_FIELD.names])
        return F.to_json(renamed, {"ignoreNullFields": "false"})

    return table.withColumns({c: text(c) for c in FIELD_COLUMNS[name]})


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A stored Parquet ledger table with decoded fields."""
    table = spark.read.parquet(path)
    return decode_fields(table, name) if name in FIELD_COLUMNS else table


def write_table(table: DataFrame, path: str, name: str) -> None:
    """Write a ledger table as Parquet, field columns as JSON text."""
    stored = encode_fields(table, name) if name in FIELD_COLUMNS else table
    stored.write.mode("overwrite").parquet(path)


# ---- tables in buckets ------------------------------------------------------

#: Folders that the households of a table are dealt to.
BUCKETS = 256


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(S.KEY)), F.lit(buckets)).cast("int")


def write_buckets(table: DataFrame, path: str, name: str, buckets: int = BUCKETS) -> None:
    """Write a ledger table as Parquet in a folder per bucket of households, so that batches can be applied to parts of it.

    The rows of a bucket are spread over as many tasks as they need: a large household does not make a large task.
    """
    _write(table, path, name, buckets, "static")


def read_buckets(spark: SparkSession, path: str, name: str, only: list[int] | None = None) -> DataFrame:
    """The table that ``write_buckets`` wrote, or the buckets of it that are asked for."""
    stored = spark.read.parquet(path)
    if only is not None:
        stored = stored.where(F.col("bucket").isin(only))
    table = stored.where("in_use").drop("bucket", "in_use")
    return decode_fields(table, name) if name in FIELD_COLUMNS else table


def change_buckets(spark: SparkSession, path: str, name: str, households: DataFrame,
                   change: Callable[[DataFrame], DataFrame], buckets: int = BUCKETS) -> list[int]:
    """Apply a batch to a table in buckets: only buckets with a household that it names are read and rewritten.

    ``households`` has the household of every row that the batch may touch or add; ``change`` gets the rows of
    those buckets and returns what shall be there. The folds of ``operators.commands`` may be applied
    again, so a batch that failed half way is simply run once more. Returns the buckets, of
    which there are never more than ``buckets``.
    """
    named = [r["bucket"] for r in households.select(_bucket(buckets).alias("bucket")).distinct().collect()]
    if named:
        changed = change(read_buckets(spark, path, name, named))
        # A row out of use in each of them: a bucket that ends up empty is overwritten as well.
        _write(changed, path, name, buckets, "dynamic", spark.createDataFrame([(n,) for n in named], "bucket int"))
    return sorted(named)


def _write(table: DataFrame, path: str, name: str, buckets: int, mode: str, named: DataFrame | None = None) -> None:
    stored = encode_fields(table, name) if name in FIELD_COLUMNS else table
    rows = stored.withColumns({"in_use": F.lit(True), "bucket": _bucket(buckets)})
    if named is not None:
        rows = rows.unionByName(named.withColumn("in_use", F.lit(False)), allowMissingColumns=True)
    rows.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy("bucket").parquet(path)


# ---- listings ---------------------------------------------------------------


def list_documents(documents: DataFrame, include_text: bool = False) -> DataFrame:
    """Documents per household, newest first; transcripts only on request."""
    listed = documents if include_text else documents.drop("extracted_text")
    return listed.orderBy(S.KEY, F.desc("created_at"), "document_id")
