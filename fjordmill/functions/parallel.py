"""A Python function over the rows of a DataFrame, for what no expression can say."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame


def parallel_map(df: DataFrame, function: Callable, columns: list[str], result: str, kind: str = "string", error: str = "error") -> DataFrame:
    """The rows with ``result``, the function of the given columns, and ``error``. A row on which the function fails gets
    a null and the message; no other row is touched. Batches go to the function row by row, so this is the slow path: use
    it only where expressions and whole-batch functions can't do it."""

    def run(batches):
        for b in batches:
            out, told = [], []
            for args in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in columns)):
                try:
                    out.append(function(*args))
                    told.append(None)
                except Exception as e:
                    out.append(None)
                    told.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, b_type), pa.array(told, pa.string())], names=[*b.schema.names, result, error])

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    schema = StructType(list(df.schema.fields)).add(result, kind).add(error, "string")
    b_type = to_arrow_type(schema[result].dataType)
    return df.mapInArrow(run, schema)
