"""Small helpers shared by the training-data operators.

Conventions of every operator here: it takes a DataFrame plus the names of the
columns it reads (``id_col``, ``text_col`` ...), selects only those, and
returns only its documented columns, so further columns of the input, whatever
their names, can neither clash nor change the result. A null text is an empty
text. A repeated row is a row of its own.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillsight.session import scratch_path

#: A word of a text, in Spark's regular expressions.
WORD = r"[^\x20\x09-\x0D]+"
#: The same white space as bytes, for Python kernels.
SPACE = b" \t\n\x0b\x0c\r"


def text_of(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared checkpoint folder and read it
    back: cuts lineage in a way that survives lost executors."""
    path = scratch_path(df.sparkSession, f"llm-{name}-{uuid.uuid4().hex}")
    schema = df.schema
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def rows(spark: SparkSession, data: list, schema: str) -> DataFrame:
    """A small driver-made frame of JVM literals (no Python worker reads it)."""
    if not data:
        return spark.createDataFrame([], schema)
    import json
    names = [f.split()[0] for f in schema.split(",")]
    js = json.dumps([dict(zip(names, r)) for r in data])
    one = spark.range(1).select(F.explode(F.from_json(F.lit(js), f"array<struct<{re.sub(r'(\w+) (\w+)', r'\1:\2', schema)}>>")).alias("r"))
    return one.select("r.*")


def batches_of(texts: list, most: int = 1 << 22):
    """Cut a list of byte strings into runs of about ``most`` bytes: (from, to)."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def text_bytes(column) -> list:
    """The texts of an Arrow column as UTF-8 byte strings, null as empty."""
    import pyarrow as pa
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


_SHIPPED: set = set()


def ship(df: DataFrame) -> DataFrame:
    """``df``, after its session's Python workers have been given this package
    (unless their path has it already), as its kernels run in them."""
    import os
    import tempfile
    import zipfile

    import tillsight
    home = os.path.dirname(os.path.abspath(tillsight.__file__))
    context = df.sparkSession.sparkContext
    paths = {os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    if context.applicationId not in _SHIPPED and os.path.realpath(os.path.dirname(home)) not in paths:
        target = os.path.join(tempfile.mkdtemp(prefix="tillsight-"), "tillsight.zip")  # the driver serves it to workers
        with zipfile.ZipFile(target, "w") as z:
            for d, _, names in os.walk(home):
                for n in names:
                    if n.endswith(".py"):
                        z.write(os.path.join(d, n), os.path.join("tillsight", os.path.relpath(os.path.join(d, n), home)))
        context.addPyFile(target)
    _SHIPPED.add(context.applicationId)
    return df
