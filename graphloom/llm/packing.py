"""Best-fit packing by large-item matching.

Only the histogram of piece lengths, at most ``capacity`` numbers however many pieces there are,
decides the plan: pieces above one third of the capacity are matched greedily, at most two to a
sequence (the longest first, each with the longest that still fits), and the smaller lengths, longest first, fill
the smallest gap that takes them. The plan says where the i-th piece of each length goes as ranges of i; pieces
get their i from a count by (length, salt), so no length, however common, is ranked in one task, and then look
their place up. The plan has at most some ten thousand ranges: each range empties a length or a class of
gaps, and every visit at least halves a gap.

Defined cases: a null or empty text is the end token alone; an empty table gives an empty result;
repeated rows are packed each; columns other than id and text are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm import bpe
from graphloom.llm.common import alone, documents, spool, text_bytes

CAPACITY = 2048
END = b"\0\0\0\0"  # id 0 ends each document


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Ranges (length, first, sequence, each, offset) and the number of sequences.

    The pieces of ``length`` from the ``first``-th on lie in sequences from ``sequence`` on, ``each`` to a
    sequence, side by side from ``offset`` on, until the next range of that length.
    """
    left = [0] * (capacity + 1)
    for length, n in histogram.items():
        left[length] += n
    used, ranges, bins = [0] * (capacity + 1), [], 0
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # by gap: (first sequence, number)

    def put(length: int, n: int, first_bin: int, each: int, offset: int) -> None:
        ranges.append((length, used[length], first_bin, each, offset))
        used[length] += n
        left[length] -= n

    third = capacity // 3  # lengths are whole, so above this is above one third

    def best_mate(length: int) -> int:
        return next((m for m in range(min(length, capacity - length), third, -1) if left[m] > (m == length)), 0)

    for length in range(capacity, third, -1):
        while left[length]:
            mate = best_mate(length)
            n = left[length] if not mate else left[length] // 2 if mate == length else min(left[length], left[mate])
            if mate == length:
                put(length, 2 * n, bins, 2, 0)
            else:
                put(length, n, bins, 1, 0)
                if mate:
                    put(mate, n, bins, 1, length)
            gaps[capacity - length - mate].append((bins, n))
            bins += n
    for length in range(third, 0, -1):
        gap = length
        while left[length]:
            while gap <= capacity and not gaps[gap]:
                gap += 1
            if gap > capacity:
                each = capacity // length
                n = -(-left[length] // each)
                gaps[capacity].append((bins, n))
                bins += n
                gap = capacity
            first, n = gaps[gap].pop()
            each = gap // length
            full = min(n, left[length] // each)
            if full:
                put(length, full * each, first, each, capacity - gap)
                gaps[gap - each * length].append((first, full))
            if full < n:
                if rest := left[length]:
                    put(length, rest, first + full, rest, capacity - gap)
                    gaps[gap - rest * length].append((first + full, 1))
                    full += 1
                if full < n:
                    gaps[gap].append((first + full, n - full))
    return ranges, bins


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """(rid, id, piece, start, length, ids_crc32, ids or none): every document's ids and end token, cut only if longer than ``capacity``."""
    spec = docs.sparkSession.sparkContext.broadcast(bpe.read_spec(path))
    fields = [("rid", T.LongType()), ("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType())] + [("ids", T.BinaryType())] * with_ids
    shape = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), *[T.StructField(*f) for f in fields]])

    def run(batches):
        encode = bpe.load(spec.value).encode
        step = 4 * capacity
        for b in batches:
            at, rows = [], []
            for i, (rid, t) in enumerate(zip(b.column("rid").to_pylist(), b.column("t").to_pylist())):
                ids = encode(t) + END
                for p in range(0, len(ids), step):
                    part = ids[p : p + step]
                    at.append(i)
                    rows.append((rid, p // step, p // 4, len(part) // 4, zlib.crc32(part), *[part] * with_ids))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            cols = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds[: len(fields)]]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(at, pa.int64())), *cols], names=shape.names)

    return docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"), text_bytes(text_col).alias("t")).mapInArrow(run, shape)


def pack(items: DataFrame, capacity: int = CAPACITY, rows_per_salt: int = 200_000) -> DataFrame:
    """Adds sequence_id and offset to rows with rid, piece and length <= capacity; (rid, piece) is unique."""
    items = spool(items, "packing-pieces")
    total = items.count()
    salts = max(16, -(-total // rows_per_salt))
    items = items.withColumn("salt", F.pmod(F.xxhash64("rid", "piece"), F.lit(salts)))
    counts = items.groupBy("length", "salt").count()
    before = F.sum("count").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    counts = spool(counts.withColumn("before", F.coalesce(before, F.lit(0))), "packing-counts")
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("count")).collect()}  # at most `capacity` rows
    ranges, _ = plan(histogram, capacity)
    ranges.sort()
    table = np.array(ranges, np.int64).reshape(-1, 5)
    b_plan = items.sparkSession.sparkContext.broadcast((table[:, 0] << 42 | table[:, 1], table))
    ranked = items.join(counts.select("length", "salt", "before"), ["length", "salt"]).withColumn(
        "nth", F.col("before") + F.row_number().over(Window.partitionBy("length", "salt").orderBy("rid", "piece")) - 1
    )
    kept = [c for c in items.columns if c != "salt"]
    shape = T.StructType([*[items.schema[c] for c in kept], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    @alone
    def place(batches):
        keys, table = b_plan.value
        for b in batches:
            length, nth = b.column("length").to_numpy(), b.column("nth").to_numpy()
            row = table[np.searchsorted(keys, length << 42 | nth, side="right") - 1] if len(table) else table
            past = nth - row[:, 1]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], pa.array(row[:, 2] + past // row[:, 3]), pa.array(row[:, 4] + past % row[:, 3] * length)], names=[*kept, "sequence_id", "offset"])

    return ranked.select(*kept, "nth").mapInArrow(place, shape)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))


def pack_documents(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    return pack(pieces(docs, capacity=capacity), capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
