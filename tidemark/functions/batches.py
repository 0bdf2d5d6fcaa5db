"""Python functions of one value over Arrow batches, a few rows at a time."""

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

#: Rows of a batch that are Python objects at once, with what is made of them.
ROWS = 32


def each(function: Callable, kind: str, column: Column) -> Column:
    """``function`` of each value, as a column of type ``kind``; a batch itself stays in Arrow, however many rows it has."""
    of = to_arrow_type(DataType.fromDDL(kind))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for start in range(0, len(batch), ROWS):
                yield pa.array([function(x) for x in batch.slice(start, ROWS).to_pylist()], of)

    return F.arrow_udf(run, kind)(column)
