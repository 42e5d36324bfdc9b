"""Python functions of columns that hold a few rows at a time as Python objects."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rows, and bytes of input, that are Python objects at a time; one row may be larger.
ROWS, BYTES = 256, 1 << 20


def pieces(array: pa.Array, rows: int = ROWS, most: int = BYTES) -> Iterator[pa.Array]:
    """An array in slices of up to so many rows and bytes, one row at least."""
    at = 0
    while at < len(array):
        n = min(rows, len(array) - at)
        while n > 1 and array.slice(at, n).nbytes > most:
            n = (n + 1) // 2
        yield array.slice(at, n)
        at += n


def by_row(row: Callable, kind: str) -> Callable[[Column], Column]:
    """A column function of ``row``, from a value that is not null to a value of type ``kind``; null stays null.

    A batch is never held whole as Python objects, nor its results; its memory is given back when it is done.
    """
    from pyspark.sql.pandas.functions import ArrowUDFType
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    made = to_arrow_type(_parse_datatype_string(kind))

    def whole(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for array in arrays:
            for piece in pieces(array):
                yield pa.array([None if x is None else row(x) for x in piece.to_pylist()], type=made)
            pa.default_memory_pool().release_unused()

    return F.arrow_udf(whole, kind, ArrowUDFType.SCALAR_ITER)
