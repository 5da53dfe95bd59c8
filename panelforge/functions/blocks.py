"""Arrow blocks: batches of a task put together, and columns of doubles in few bytes."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

SCALES = (1.0, 1e2, 1e4, 1e7, 1e9)
ROWS = 250_000  # rows of a task that are dealt to blocks together


def gathered(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """The rows of a task's batches in tables of at most ``rows`` rows."""
    held, n = [], 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, rows - n)
            held.append(part)
            n, batch = n + part.num_rows, batch.slice(part.num_rows)
            if n == rows:
                yield pa.Table.from_batches(held).combine_chunks()
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def column(table: pa.Table, name: str) -> np.ndarray:
    """A column as doubles, NaN for null."""
    return table[name].cast(pa.float64()).to_numpy()


def _short(values: pa.ChunkedArray) -> tuple[pa.Array, float | None]:
    """Doubles as whole numbers of the coarsest scale that gives each of them back (-0 as 0), or as they are."""
    array = values.combine_chunks()
    x = array.fill_null(0.0).to_numpy(zero_copy_only=False)
    with np.errstate(all="ignore"):
        for scale in SCALES:
            # A few rows tell most scales off.
            if (np.rint(x[:64] * scale) / scale == x[:64]).all():
                whole = np.rint(x * scale)
                if (whole / scale == x).all() and (most := np.abs(whole).max(initial=0)) < 2**53:
                    return pa.array(whole.astype(np.int32 if most < 2**31 else np.int64), mask=array.is_null().to_numpy(zero_copy_only=False)), scale
    return array, None


def packed(df: DataFrame, key: str) -> DataFrame:
    """(key, block): the rows of a key in a task as Arrow data by column, compressed; values rounded to some digits take three or four bytes and not eight."""

    def pack(batches):
        for table in gathered(batches, ROWS):
            table = table.take(pc.sort_indices(table, [(key, "ascending")])).combine_chunks()
            keys = table[key]
            arrays, scales = [], {}
            for name in table.column_names:
                array = table[name].combine_chunks()
                if pa.types.is_float64(array.type):
                    array, scale = _short(table[name])
                    scales |= {name: repr(scale)} if scale else {}
                arrays.append(array)
            short = pa.RecordBatch.from_arrays(arrays, schema=pa.schema([(n, a.type) for n, a in zip(table.column_names, arrays)], metadata=scales))
            runs = pc.run_end_encode(keys.combine_chunks())
            ends = runs.run_ends.to_numpy()
            made = []
            for lo, hi in zip([0, *ends[:-1].tolist()], ends.tolist()):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, short.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_batch(short.slice(lo, hi - lo))
                made.append(sink.getvalue().to_pybytes())
            yield pa.RecordBatch.from_arrays([runs.values, pa.array(made, pa.binary())], [key, "block"])

    return df.mapInArrow(pack, StructType([df.schema[key]]).add("block", "binary"))


def unpacked(blocks: pa.ChunkedArray, types: pa.Schema) -> pa.Table:
    """The rows of some blocks, with the columns' own types."""
    tables = [pa.ipc.open_stream(b.as_buffer()).read_all() for b in blocks]
    arrays = []
    for field in types:
        parts = []
        for table in tables:
            array, scale = table[field.name].combine_chunks(), (table.schema.metadata or {}).get(field.name.encode())
            if scale:
                array = pc.divide(array.cast(pa.float64()), float(scale))
            parts.append(array.cast(field.type))
        arrays.append(pa.chunked_array(parts, field.type).combine_chunks())
    return pa.Table.from_arrays(arrays, schema=types)


def over_blocks(df: DataFrame, key: str, schema: StructType, run: Callable[[pa.Table], pa.Table]) -> DataFrame:
    """``run`` over all rows of each key, which move as blocks: one exchange by key, of which only blocks are sorted."""
    from pyspark.sql.pandas.types import to_arrow_schema

    types = pa.schema([(f.name, f.type) for f in to_arrow_schema(df.schema)])
    return packed(df, key).groupBy(key).applyInArrow(lambda table: run(unpacked(table["block"], types)), schema)
