"""What the operators share: tables, the shared folder, folds, and functions over Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

#: Words are runs of other bytes than ASCII white space; bytes.split() cuts the same way.
WORD_GAPS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of sf_dir. Python workers started from now on look for this package where the driver has it.

    (Executors that have it elsewhere, or by --py-files, are not disturbed.)
    """
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spare_name(frame: DataFrame, wanted: str) -> str:
    """A column name that the table doesn't have yet, in any case of letters."""
    taken = {c.lower() for c in frame.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def text_of(column: str = "text") -> Column:
    """A text column; null counts as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, everything else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fold_of(folds: int, column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo folds; a null id is in fold 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % folds, F.lit(0)).cast("int")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Where the setting is missing, a local session gets a folder of its own; on a cluster
    that is an error, as executors don't see each other's local disks.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = Path(tempfile.mkdtemp(prefix="hearthbook-")).as_uri()
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that no other run uses; its owner clears it by application."""
    app = spark.sparkContext.applicationId
    return f"{shared_folder(spark)}/hearthbook/{app}/{name}-{uuid.uuid4().hex}"


def written(frame: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: computed once, safe from lost executors."""
    spark = frame.sparkSession
    path = new_path(spark, name)
    frame.write.parquet(path)
    found = spark.read.schema(frame.schema).parquet(path)
    found._written_to = path
    return found


def discard(*frames: DataFrame) -> None:
    """Deletes tables that written() made, once nothing will be computed from them any more."""
    for frame in frames:
        jvm, session = frame.sparkSession._jvm, frame.sparkSession._jsparkSession
        path = jvm.org.apache.hadoop.fs.Path(frame._written_to)
        path.getFileSystem(session.sessionState().newHadoopConf()).delete(path, True)


def map_batches(frame: DataFrame, function: Callable[[pa.RecordBatch], dict], schema: str | StructType, rows: int | None = None) -> DataFrame:
    """function(batch) -> {column: values} for each Arrow batch; values in the order of schema.

    With rows, a batch is handed over in parts of so many rows.
    """
    wanted = _arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = rows or max(batch.num_rows, 1)
            for at in range(0, max(batch.num_rows, 1), step):
                yield as_batch(function(batch.slice(at, step)), wanted)

    return frame.mapInArrow(run, schema)


_memory: dict = {"owner": None, "value": None}


def remembered(owner: tuple, make: Callable[[], object]):
    """What an operator keeps between batches and tasks of one Python worker.

    A worker serves one stage after another; when another owner comes, the last one's memory goes.
    """
    if _memory["owner"] != owner:
        _memory["owner"] = _memory["value"] = None
        _memory["value"] = make()
        _memory["owner"] = owner
    return _memory["value"]


def as_batch(values: dict, wanted: pa.Schema) -> pa.RecordBatch:
    arrays = [
        v if isinstance(v, pa.Array) else pa.array(v, type=f.type)
        for f, v in ((f, values[f.name]) for f in wanted)
    ]
    return pa.RecordBatch.from_arrays(arrays, schema=wanted)


def _arrow_schema(schema: str | StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kinds = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    return to_arrow_schema(kinds)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    return [t or "" for t in batch.column(name).to_pylist()]
