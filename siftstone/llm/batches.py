"""Arrow batches of texts as numpy arrays: code points, words and word numbers."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text that are worked on at once; a longer text is worked on alone.
SLICE_BYTES = 1 << 20
#: Rows in an Arrow batch; with long texts the default would be hundreds of MB.
BATCH_ROWS = 500


def release() -> None:
    """Give freed memory back: a worker process outlives its task and would hold it beside the next stage's."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not glibc
        pass


def spans(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of rows that hold at most ``limit`` bytes, or one row."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
    start, n = 0, len(texts)
    while start < n:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield start, stop
        start = stop


def as_texts(column: pa.Array) -> pa.Array:
    return pc.fill_null(column.cast(pa.string()), "")


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All code points of the texts in a row, and where each text begins and ends."""
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + n + 1]
    data = texts.buffers()[2]
    raw = b"" if data is None else data[int(offsets[0]) : int(offsets[-1])].to_pybytes()
    points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), "<u4")
    if len(points) == len(raw):
        return points, (offsets - offsets[0]).astype(np.int64)
    starts = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80, out=starts[1:])
    return points, starts[offsets - offsets[0]]


def words(texts: pa.Array, lower: bool = True) -> tuple[pa.Array, np.ndarray]:
    """Words between ASCII white space, A-Z lower-cased, of all texts in a row; where each text begins and ends."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    flat = lists.flatten()
    ends = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False), out=ends[1:])
    full = pc.greater(pc.binary_length(flat), 0)
    if pc.all(full, min_count=0).as_py():
        return flat, ends
    kept = np.zeros(len(flat) + 1, np.int64)
    np.cumsum(full.to_numpy(zero_copy_only=False), out=kept[1:])
    return flat.filter(full), kept[ends]


def coded(flat: pa.Array) -> pa.DictionaryArray:
    out = flat.dictionary_encode()
    return out.combine_chunks() if isinstance(out, pa.ChunkedArray) else out


def word_numbers(flat: pa.Array) -> np.ndarray:
    """A number for each word; equal words alone have the same."""
    return coded(flat).indices.to_numpy(zero_copy_only=False)


def numbered(flat: pa.Array) -> tuple[np.ndarray, list[str]]:
    """Each word's number in the list of distinct words, and that list."""
    c = coded(flat)
    return c.indices.to_numpy(zero_copy_only=False), c.dictionary.to_pylist()


def map_texts(
    df: DataFrame,
    text_col: str,
    carry: list[str],
    fields: list[tuple[str, str]],
    make: Callable[[], Callable[[pa.Array], list[pa.Array]]],
) -> DataFrame:
    """The columns ``carry`` of ``df`` and, computed from each text, ``fields`` (name, Spark type).

    ``make()`` runs once in a task and returns the function from a slice of
    texts (nulls are empty) to one array for each field. A carried column that
    bears the name of a field is replaced by it.
    """
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    kept = [c for c in dict.fromkeys(carry) if c not in {n for n, _ in fields}]
    inner = df.select(F.col(text_col).cast("string").alias("t"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)])
    schema = ", ".join([f"c{i} {inner.schema[f'c{i}'].dataType.simpleString()}" for i in range(len(kept))] + [f"f{i} {t}" for i, (_, t) in enumerate(fields)])
    names = [f"c{i}" for i in range(len(kept))] + [f"f{i}" for i in range(len(fields))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            texts = as_texts(batch.column(0))
            for a, b in spans(texts):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *fn(texts.slice(a, b - a))], names)
        del fn
        release()

    out = inner.mapInArrow(run, schema)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(kept)], *[F.col(f"f{i}").alias(n) for i, (n, _) in enumerate(fields)])
