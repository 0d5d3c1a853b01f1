"""Arrow arrays from Python rows."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql.types import IntegerType, LongType, StructType


def as_structs(rows: list[tuple | None], kind: StructType) -> pa.StructArray:
    """Tuples as an array of structs; none is null."""
    blank = (None,) * len(kind)
    columns = zip(*[blank if r is None else r for r in rows], strict=True) if rows else [[]] * len(kind)
    types = [pa.int64() if isinstance(f.dataType, LongType) else pa.int32() if isinstance(f.dataType, IntegerType) else pa.string() for f in kind]
    arrays = [pa.array(list(c), t) for c, t in zip(columns, types, strict=True)]
    return pa.StructArray.from_arrays(arrays, kind.names, mask=pa.array([r is None for r in rows], pa.bool_()))
