"""Packing of token ids into sequences of a fixed length.

``plan_sequences`` packs a whole corpus by cutting-stock patterns and returns
where each piece lies; ``token_matrices`` packs each task's share by
best-fit-decreasing and returns the id rows themselves.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import cutting_stock
from . import tokens as token_ids
from .batches import as_texts, release, spans
from .common import cut, shuffle_width

#: Bytes of text that are encoded at once: more than elsewhere, as a word is looked up once in each slice.
TOKEN_SLICE = 3 << 20
BATCH_ROWS = 2000
_PIECES = "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long"


def token_pieces(docs: DataFrame, tokenizer: str, length: int, end_id: int | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's ids in pieces of ``length``, the last one shorter: ``doc_id, start, length, ids_crc32, doc_tokens``.

    The pieces put together are the document's ids. A document without ids, as
    an empty one without ``end_id``, has no piece.
    """
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = token_ids.encoder(tokenizer, end_id)
        for batch in batches:
            texts = as_texts(batch.column(1))
            for a, b in spans(texts, TOKEN_SLICE):
                ids, ends = encoder.encode(texts.slice(a, b - a))
                sizes = np.diff(ends)
                n = -(-sizes // length)
                row = np.repeat(np.arange(b - a), n)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * length
                size = np.minimum(sizes[row] - start, length)
                raw, at = ids.astype("<u4").tobytes(), ends[row] + start
                crc = [zlib.crc32(raw[4 * i : 4 * (i + k)]) for i, k in zip(at.tolist(), size.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a).take(pa.array(row)), *[pa.array(v, pa.int64()) for v in (start, size, crc, sizes[row])]],
                    ["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
                )
                release()  # what a slice needed besides its ids would else stay with the worker
        release()

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, _PIECES.format(id=kind.simpleString()))


def plan_sequences(docs: DataFrame, tokenizer: str, length: int = 4096, end_id: int | None = 2, grain: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    A document longer than ``length`` is cut at multiples of it; only its last
    piece shares a sequence. The histogram of lengths, ``length / grain``
    classes at any size of the corpus, gives the patterns; pieces of a class,
    ranked by a hash and their ids, take the patterns' slots in turn. Null and
    empty texts have the end id alone. Repeated rows are packed each. An empty
    table gives no rows.
    """
    spark = docs.sparkSession
    room = length // grain
    pieces = cut(token_pieces(docs, tokenizer, length, end_id, id_col, text_col).withColumn("_class", F.ceil(F.col("length") / F.lit(grain)).cast("int")))
    histogram = {r["_class"]: r["count"] for r in pieces.groupBy("_class").count().collect()}
    classes = np.array(sorted(histogram), int)
    demand = np.array([histogram[c] for c in classes.tolist()], np.int64)
    full = classes >= room
    patterns, times = cutting_stock.solve(demand[~full], classes[~full], room)
    # Full pieces are a pattern of their own.
    own = np.zeros((int(full.any()), len(classes)), int)
    own[:, full] = 1
    both = np.concatenate([own, np.concatenate([patterns.reshape(len(times), int((~full).sum())), np.zeros((len(times), int(full.sum())), int)], axis=1)])
    uses = np.concatenate([demand[full], times]).astype(np.int64)
    base = np.cumsum(uses) - uses
    # For each class, runs of ranks: from which rank on a pattern takes its pieces, how many each, and its first sequence.
    runs: dict[str, list[int]] = {"class": [], "rank": [], "each": [], "base": []}
    for k, c in enumerate(classes.tolist()):
        using = np.flatnonzero(both[:, k])
        runs["class"] += [c] * len(using)
        runs["rank"] += (np.cumsum(both[using, k] * uses[using]) - both[using, k] * uses[using]).tolist()
        runs["each"] += both[using, k].tolist()
        runs["base"] += base[using].tolist()
    shared = spark.sparkContext.broadcast({k: np.array(v, np.int64) for k, v in runs.items()})  # at most (length/grain)^2 runs

    total = int(demand.sum())
    fair = max(64, -(-total // (4 * shuffle_width(spark))))
    ways = spark.createDataFrame([(int(c), int(-(-n // fair))) for c, n in histogram.items()], "_class int, _ways int")
    celled = pieces.join(F.broadcast(ways), "_class").withColumn("_cell", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.col("_ways")).cast("int"))
    cells = celled.groupBy("_class", "_cell").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_class").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.select("_class", "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_class", "_cell").orderBy("doc_id", "start", "ids_crc32")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    ranked = celled.withColumn("_rank", F.row_number().over(inside) - 1).join(offsets, ["_class", "_cell"]).select(*names, "_class", (F.col("_rank") + F.col("_before")).cast("long").alias("_rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = shared.value
        first = np.searchsorted(r["class"], np.arange(room + 2))
        keys = r["class"] * (1 << 44) + r["rank"]
        for batch in batches:
            c, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (5, 6))
            at = np.searchsorted(keys, c.astype(np.int64) * (1 << 44) + rank, side="right") - 1
            assert (at >= first[c]).all()
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(r["base"][at] + (rank - r["rank"][at]) // r["each"][at])], [*names, "_class", "sequence_id"])

    kind = docs.schema[id_col].dataType.simpleString()
    placed = ranked.mapInArrow(place, f"{_PIECES.format(id=kind)}, _class int, sequence_id long")
    row = Window.partitionBy("sequence_id").orderBy(F.desc("_class"), "doc_id", "start", "ids_crc32", "length").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select(F.col("doc_id").alias(id_col), *names[1:], "sequence_id", F.coalesce(F.sum("length").over(row), F.lit(0)).cast("long").alias("offset"))


class CapacityTree:
    """How many bins have each free capacity, as sums over a binary tree; finds the tightest fit in log steps."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _add(self, free: int, by: int) -> None:
        node = self.leaves + free
        while node:
            self.count[node] += by
            node >>= 1

    def push(self, free: int, bin_: int) -> None:
        self.bins[free].append(bin_)
        self._add(free, 1)

    def pop_at_least(self, need: int) -> tuple[int, int] | None:
        """A bin with the least free capacity that is ``need`` or more: (free, bin)."""
        count, node = self.count, self.leaves + need
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if count[2 * node] else 2 * node + 1
        free = node - self.leaves
        bin_ = self.bins[free].pop()
        self._add(free, -1)
        return free, bin_


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each piece; pieces of ``capacity`` or less, longest first into the tightest fit."""
    tree, out, bins = CapacityTree(capacity), np.zeros(len(sizes), np.int64), 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        need = int(sizes[i])
        if (hit := tree.pop_at_least(need)) is None:
            hit, bins = (capacity, bins), bins + 1
        out[i] = hit[1]
        if hit[0] > need:
            tree.push(hit[0] - need, hit[1])
    return out


def token_matrices(
    docs: DataFrame,
    tokenizer: str,
    length: int = 4096,
    end_id: int | None = 2,
    pad_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    buffer_tokens: int = 8 << 20,
) -> DataFrame:
    """Packed rows of exactly ``length`` ids, as little-endian binary, one Spark row each.

    ``sequence_id`` (unique), ``doc_ids`` and ``doc_starts`` (each segment's
    document and its ids before the segment), ``ids`` (the matrix row),
    ``dtype`` (uint16 where the vocabulary allows, else uint32), ``n_tokens``
    (without padding), ``cu_seqlens`` (0 and each segment's end), and
    ``position_resets`` (where positions begin again from 0: each segment's
    start, and the padding's).

    A document of more than ``length`` ids is split; its pieces put together are
    its ids. Each task packs its own documents, ``buffer_tokens`` at a time, so
    nothing is shuffled and memory is bounded; only the last rows of a buffer
    can be slack. Null and empty texts have the end id alone, or no segment
    without one. Repeated rows are packed each; an empty table gives no rows.
    """
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    kind = docs.schema[id_col].dataType
    names = ["sequence_id", "doc_ids", "doc_starts", "ids", "dtype", "n_tokens", "cu_seqlens", "position_resets"]
    schema = f"sequence_id long, doc_ids array<{kind.simpleString()}>, doc_starts array<long>, ids binary, dtype string, n_tokens int, cu_seqlens array<int>, position_resets array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = token_ids.encoder(tokenizer, end_id)
        dtype = "uint16" if encoder.tokenizer.get_vocab_size() <= 1 << 16 and pad_id < 1 << 16 else "uint32"
        ctx = TaskContext.get()
        number = (ctx.partitionId() if ctx else 0) << 32
        held: list[tuple[object, int, np.ndarray]] = []  # (doc id, start, ids)
        tokens = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal number, tokens
            sizes = np.array([len(p[2]) for p in held], np.int64)
            bins = best_fit_decreasing(sizes, length)
            order = np.lexsort((np.arange(len(held)), bins))
            edges = np.flatnonzero(np.diff(bins[order], prepend=-1, append=-2)) if len(held) else np.zeros(1, int)
            rows: dict[str, list] = {n: [] for n in names}
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                parts = [held[i] for i in order[a:b].tolist()]
                ends = np.cumsum([len(p[2]) for p in parts]).tolist()
                line = np.full(length, pad_id, np.dtype(dtype).newbyteorder("<"))
                line[: ends[-1]] = np.concatenate([p[2] for p in parts])
                starts = [0, *ends[:-1]]
                for n, v in zip(names, (number, [p[0] for p in parts], [p[1] for p in parts], line.tobytes(), dtype, ends[-1], [0, *ends], starts + [ends[-1]] * (ends[-1] < length)), strict=True):
                    rows[n].append(v)
                number += 1
                if len(rows["ids"]) == 256:
                    yield batch_of(rows)
                    rows = {n: [] for n in names}
            if rows["ids"]:
                yield batch_of(rows)
            held.clear()
            tokens = 0

        def batch_of(rows: dict[str, list]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(rows[n], t) for n, t in zip(names, types, strict=True)], names)

        types = None
        for batch in batches:
            if types is None:
                types = [pa.int64(), pa.list_(batch.column(0).type), pa.list_(pa.int64()), pa.binary(), pa.string(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32())]
            texts, doc_ids = as_texts(batch.column(1)), batch.column(0).to_pylist()
            for a, b in spans(texts, TOKEN_SLICE):
                ids, ends = encoder.encode(texts.slice(a, b - a))
                for i in range(b - a):
                    for s in range(int(ends[i]), int(ends[i + 1]), length):
                        piece = ids[s : min(s + length, int(ends[i + 1]))].astype(dtype)
                        held.append((doc_ids[a + i], s - int(ends[i]), piece))
                        tokens += len(piece)
                if tokens >= buffer_tokens:
                    yield from flush()
        if held:
            yield from flush()

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


def write_token_matrices(docs: DataFrame, path: str, tokenizer: str, **options) -> None:
    """``token_matrices`` as Parquet files at ``path``."""
    token_matrices(docs, tokenizer, **options).write.mode("overwrite").parquet(path)
