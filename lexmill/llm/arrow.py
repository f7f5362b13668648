"""Running Python over the rows of a DataFrame in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: What is worked on at once: so many rows at most, and so many bytes of text unless one row alone has more.
PIECE_ROWS, PIECE_BYTES = 1000, 4 << 20


def map_texts(df: DataFrame, make: Callable[[], Callable[[list], Iterable[tuple]]], schema: str) -> DataFrame:
    """`make()` is called once per task and gives a function from a piece of a batch (a list of rows as
    tuples of the columns of `df`) to output rows. Pieces are bounded by rows and by bytes, and many
    output rows are sent on in pieces too, so memory stays bounded however long the texts are."""
    kind = StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = to_arrow_schema(kind)
        work = make()
        for batch in batches:
            for start, end in pieces(batch):
                part = batch.slice(start, end - start)
                rows = list(zip(*(c.to_pylist() for c in part.columns)))
                made: list[tuple] = []
                for row in work(rows):
                    made.append(row)
                    if len(made) >= 20_000:
                        yield _batch(made, out)
                        made = []
                if made:
                    yield _batch(made, out)

    return df.mapInArrow(run, kind)


def pieces(batch: pa.RecordBatch) -> Iterator[tuple[int, int]]:
    """(start, end) of consecutive rows within the bounds."""
    size = np.zeros(batch.num_rows, np.int64)
    for c in batch.columns:
        if pa.types.is_string(c.type) or pa.types.is_large_string(c.type):
            size += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
    total, start = np.concatenate(([0], np.cumsum(size))), 0
    while start < batch.num_rows:
        fits = int(np.searchsorted(total, total[start] + PIECE_BYTES, side="right")) - 1
        end = min(max(fits, start + 1), start + PIECE_ROWS, batch.num_rows)
        yield start, end
        start = end


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
