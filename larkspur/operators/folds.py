"""Cutting ordered sizes into groups."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import pairwise

from pyspark.sql import DataFrame

#: Rows that a fold turns into Python objects at once; a row may be a whole document.
AT_ONCE = 64


def greedy(sizes: Sequence[float], most: float, glued: Sequence[bool] | None = None) -> list[range]:
    """Places in groups of at most `most` in all, each as long as can be; an oversized item is alone, a glued one stays with its predecessor."""
    starts, used = [], 0.0
    for i, size in enumerate(sizes):
        if not starts or (used + size > most and not (glued and glued[i])):
            starts.append(i)
            used = 0.0
        used += size
    return [range(a, b) for a, b in pairwise([*starts, len(sizes)])]


def in_slices(rows: DataFrame, run, schema: str, arrow: bool = False) -> DataFrame:
    """rows.mapInPandas(run, schema), but run gets AT_ONCE rows at a time, with `arrow` as Arrow batches: nested columns are some ten times as large in Python as in a batch, which holds thousands of documents."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(schema))

    def sliced(batches):
        import pyarrow as pa

        frames = (batch.slice(at, AT_ONCE) if arrow else batch.slice(at, AT_ONCE).to_pandas() for batch in batches for at in range(0, batch.num_rows, AT_ONCE))
        for frame in run(frames):
            yield from pa.Table.from_pandas(frame, schema=target, preserve_index=False).to_batches()

    return rows.mapInArrow(sliced, schema)
