"""What the operators of this subpackage share: spooled tables, filters, worker memory, Arrow helpers."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Hashable
from dataclasses import dataclass
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.lineage import cut, new_path

spool = cut


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free(name: str, taken: list[str]) -> str:
    """``name``, with underscores behind it as long as a column in ``taken`` has it (names differ in more than case)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def text_bytes(column: str | Column) -> Column:
    """UTF-8 bytes of a text; null counts as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit("")).cast("binary")


WHITE = re.compile(rb"[\x20\x09-\x0D]")


def stretches(text: bytes, most: int = 1 << 20):
    """The text in pieces cut at ASCII white space, of about ``most`` bytes, so that no very long list of words is held."""
    at = 0
    while len(text) - at > most:
        cut = WHITE.search(text, at + most)
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end
    yield text[at:] if at else text


def fold_of(id_column: str | Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    c = F.col(id_column) if isinstance(id_column, str) else id_column
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % folds


MOST_BLOCKS = 1 << 19  # of a filter: 512 bits each, 50 MB at most are broadcast


@dataclass
class Filter:
    """A bit table: (block, w0 ... w7), and the number of blocks."""

    table: DataFrame
    blocks: int


def _place(column: str, blocks: int) -> list[Column]:
    h = F.xxhash64(column)
    return [F.pmod(h, F.lit(blocks)).alias("__block"), F.pmod(F.shiftrightunsigned(h, 40), F.lit(512)).cast("int").alias("__bit")]


def _blocks(n: int) -> int:
    """For eight bits or more for each of n values, up to a fixed size; beyond 33 million values a filter only lets more pass."""
    return 1 << max(4, min(MOST_BLOCKS.bit_length() - 1, (n // 64 + 1).bit_length()))


def _bits(keys: DataFrame, column: str, blocks: int, by: list[str]) -> DataFrame:
    word = lambda i: F.coalesce(F.bit_or(F.expr(f"CASE WHEN __bit DIV 64 = {i} THEN shiftleft(1L, __bit % 64) END")), F.lit(0)).alias(f"__w{i}")
    return keys.select(*by, *_place(column, blocks)).groupBy(*by, "__block").agg(*[word(i) for i in range(8)])


def filter_of(keys: DataFrame, column: str) -> Filter:
    blocks = _blocks(keys.count())
    return Filter(_bits(keys, column, blocks, []), blocks)


def filters_of(keys: DataFrame, column: str, by: str) -> dict[int, Filter]:
    """A filter of the values of each number in ``by``, of which there are few, all written at once."""
    sizes = dict(keys.groupBy(by).count().collect())
    if not sizes:
        return {}
    blocks = _blocks(max(sizes.values()))
    table, path = _bits(keys, column, blocks, [by]), new_path(keys.sparkSession, "filters")
    table.write.partitionBy(by).parquet(path)
    return {i: Filter(keys.sparkSession.read.schema(table.drop(by).schema).parquet(f"{path}/{by}={i}"), blocks) for i in sorted(sizes)}


def maybe_in(rows: DataFrame, known: Filter, column: str) -> DataFrame:
    """``rows`` with a boolean ``__maybe``: false only where ``column`` is none of the filter's values.

    It keeps rows without a partner out of the shuffle of the exact join that follows.
    """
    met = rows.select("*", *_place(column, known.blocks)).join(F.broadcast(known.table), "__block", "left")  # at most MOST_BLOCKS rows
    word = F.expr("element_at(array(__w0, __w1, __w2, __w3, __w4, __w5, __w6, __w7), CAST(__bit DIV 64 AS INT) + 1)")
    hit = F.coalesce(word.bitwiseAND(F.expr("shiftleft(1L, __bit % 64)")), F.lit(0)) != 0
    return met.withColumn("__maybe", hit).drop("__block", "__bit", *[f"__w{i}" for i in range(8)])


_tables: dict = {}  # what this process keeps between tasks, of one operator at a time
SPARE = 128 << 20  # bytes that a worker without tables may have


def remembered(key: Hashable, make: Callable):
    """What ``make`` gives, kept for later tasks of a worker process until another key, of whatever operator, is asked for.

    Workers outlive operators, so tables that each kept for itself would add up.
    """
    if key not in _tables:
        release()
        _tables[key] = make()
    return _tables[key]


def unwanted() -> bool:
    """Whether a task that keeps no tables should ``release`` first."""
    return bool(_tables) or resident() > SPARE


def release() -> None:
    """Drops what is kept, and returns free memory to the system: glibc keeps what lies below the last block in use, Arrow its pool."""
    _tables.clear()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def resident() -> int:
    """Bytes of memory that this process has of its own; 0 where the system doesn't tell."""
    try:
        with open("/proc/self/statm") as f:
            _, pages, shared, *_ = map(int, f.read().split())
    except OSError:
        return 0
    return (pages - shared) * 4096


def alone(run: Callable) -> Callable:
    """``run``, a function for mapInArrow that keeps no tables: what others have left in its worker process goes before it starts."""

    @wraps(run)
    def started(batches):
        if unwanted():
            release()
        yield from run(batches)

    return started


def batch_of(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    arrays = [c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, type=f.type) for c, f in zip(columns, schema)]
    return pa.RecordBatch.from_arrays([a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a for a in arrays], schema=schema)
