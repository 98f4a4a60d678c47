"""Running a Python step over Arrow batches, and tables written between stages."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DataType, StructType, _parse_datatype_string

#: Rows that a step holds as Python objects at once; long texts make batches large.
SLICE_ROWS = 256

WHITE = " \t\n\v\f\r"
#: A word of the contracts: a run without the six ASCII white-space characters.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def arrow_schema(schema: str | StructType) -> pa.Schema:
    kind: DataType = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    return to_arrow_schema(kind)


def map_columns(df: DataFrame, start: Callable[[], Callable[..., Iterable[tuple]]], schema: str) -> DataFrame:
    """Run a step over slices of rows; ``start()`` is called once for each partition.

    The step gets one list for each column of ``df`` and returns an iterable of
    output rows (tuples in the order of ``schema``).
    """
    target = arrow_schema(schema)

    def run(batches):
        step = start()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                rows = list(step(*(c.to_pylist() for c in part.columns)))
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(col, t.type) for col, t in zip(zip(*rows), target)], schema=target)

    return df.mapInArrow(run, schema)


def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of Arrow batches as Python values, a slice at a time: a number in an array column takes five times its place in Arrow."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            part = batch.slice(at, SLICE_ROWS)
            yield from zip(*(c.to_pylist() for c in part.columns))


def sliced(values: pa.Array) -> Iterator:
    """Python values of an Arrow array, a slice at a time: a batch holds up to 64 MB of text."""
    for at in range(0, len(values), SLICE_ROWS):
        yield from values.slice(at, SLICE_ROWS).to_pylist()


def text_udf(start: Callable[[], Callable[[str], tuple]], schema: str):
    """Column function text -> struct; a null text counts as empty.  ``start()`` runs once for each batch."""
    fields = arrow_schema(schema)
    kind = _parse_datatype_string(schema)

    @F.arrow_udf(kind)
    def call(texts: pa.Array) -> pa.Array:
        step = start()
        rows = [step(t or "") for t in sliced(texts)]
        cols = list(zip(*rows)) or [()] * len(fields)
        return pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(cols, fields)], fields=list(fields))

    return call


def written(df: DataFrame, name: str = "stage") -> DataFrame:
    """``df`` written as Parquet under ``spark.checkpoint.dir`` and read back.

    Cuts the lineage in the shared folder: a lost executor costs nothing that
    was written, and each reader prunes columns.
    """
    from textcontrols.session import checkpoint_dir

    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    spark.sparkContext._jvm.System.gc()  # the cleaner drops the shuffle files of what is written once the driver lets go
    return spark.read.schema(df.schema).parquet(path)


def ship() -> None:
    """Send this package to the executors once for each application, so that their workers can import it."""
    context = SparkSession.active().sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent.parent
    folder = tempfile.TemporaryDirectory(prefix="ship-", ignore_cleanup_errors=True)  # goes when the driver ends
    path = Path(folder.name) / f"{package.name}-src.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    context.addPyFile(str(path))
    _SHIPPED[context.applicationId] = folder


_SHIPPED: dict[str, tempfile.TemporaryDirectory] = {}


def require(df: DataFrame, *names: str) -> None:
    """The columns an operator reads must be there; its code goes to the executors."""
    ship()
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
