"""BPE encoding and decoding with the rules of a tokenizer file.

A pre-token's symbols form a doubly linked list; a priority queue holds the mergeable pairs by (rank,
position); an entry whose symbols have changed since it was queued is stale and skipped. Decoding
concatenates vocabulary strings, which the file's missing decoder asks to be set apart by one space.

Neither the normaliser nor the pre-tokeniser of such a file looks across ASCII white space, so a text
is encoded stretch by stretch and each worker remembers the ids of stretches it has met, in two tables of
at most ``MEMORY`` entries: when the newer is full it becomes the older, and what is met again moves up. Whole texts are encoded, however long.

Defined cases: a null or empty text has no ids; the strings of special tokens inside a text become
their ids, as the tokenizers library does by default; repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib
import json
import struct
import unicodedata
import zlib
from heapq import heapify, heappop, heappush
from pathlib import Path

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import documents, remembered, text_bytes

VOCABULARY = "word_bpe_49k.json"
MEMORY = 300_000
#: Fixed values of the tokenizer file: what counts as one pre-token, after lower-casing.
PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+")


def _byte_symbols() -> list[str]:
    """Byte-level BPE's printable stand-in for each byte: itself if printable, else the next code point from 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Bpe(dict):
    """Maps a stretch without ASCII white space to its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, spec: str):
        super().__init__()
        data = json.loads(spec)
        vocab, end = data["model"]["vocab"], data["model"]["end_of_word_suffix"]
        self.special = {x["content"]: x["id"] for x in data["added_tokens"]}
        self.strings = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for s, i in [*vocab.items(), *self.special.items()]:
            self.strings[i] = s
        self.ranks, self.made = {}, []  # a pair is one integer: left << 32 | right
        for rank, (a, b) in enumerate(data["model"]["merges"]):
            self.ranks[vocab[a] << 32 | vocab[b]] = rank
            self.made.append(vocab[a + b])
        symbols = _byte_symbols()
        self.inner = [vocab[s] for s in symbols]
        self.last = [vocab[s + end] for s in symbols]
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.older: dict[bytes, bytes] = {}
        self.words: dict[bytes, bytes] = {}  # pre-tokens
        self.older_words: dict[bytes, bytes] = {}

    def merge(self, symbols: list[int]) -> list[int]:
        n, rank_of, made = len(symbols), self.ranks.get, self.made
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        symbols.append(-1)  # the neighbour of either end, in no pair
        queue = [r << 32 | i for i in range(n - 1) if (r := rank_of(symbols[i] << 32 | symbols[i + 1])) is not None]
        heapify(queue)
        while queue:
            entry = heappop(queue)
            i, rank = entry & 0xFFFFFFFF, entry >> 32
            j = nxt[i]
            if rank_of(symbols[i] << 32 | symbols[j]) != rank:
                continue  # stale
            symbols[i] = new = made[rank]
            symbols[j] = -1
            nxt[i] = k = nxt[j]
            nxt[j] = n
            if k < n:
                prv[k] = i
                if (r := rank_of(new << 32 | symbols[k])) is not None:
                    heappush(queue, r << 32 | i)
            h = prv[i]
            if h >= 0 and (r := rank_of(symbols[h] << 32 | new)) is not None:
                heappush(queue, r << 32 | h)
        return [s for s in symbols if s >= 0]

    def word(self, raw: bytes) -> bytes:
        """Ids of one pre-token."""
        got = self.words.get(raw)
        if got is None:
            got = self.older_words.get(raw)
            if got is None:
                symbols = [self.inner[b] for b in raw]
                symbols[-1] = self.last[raw[-1]]
                symbols = self.merge(symbols) if len(symbols) > 1 else symbols
                got = struct.pack(f"<{len(symbols)}I", *symbols)
            if len(raw) <= 64:
                if len(self.words) >= MEMORY:
                    self.words, self.older_words = {}, self.words
                self.words[raw] = got
        return got

    def plain(self, text: str) -> bytes:
        """Ids of a text without special tokens."""
        if not text.isascii():
            # character by character, as the library lower-cases
            text = "".join(map(str.lower, unicodedata.normalize("NFC", text)))
        else:
            text = text.lower()
        return b"".join([self.word(w.encode()) for w in PRE_TOKEN.findall(text)])

    def stretch(self, text: str) -> bytes:
        if self.split is None or "<|" not in text:
            return self.plain(text)
        parts = self.split.split(text)
        return b"".join(struct.pack("<I", self.special[p]) if i % 2 else self.plain(p) for i, p in enumerate(parts))

    def __missing__(self, raw: bytes) -> bytes:
        got = self.older.get(raw)
        if got is None:
            # most stretches are letters, at most with one sign behind them: one pre-token or two
            core, sign = (raw[:-1], raw[-1:]) if raw[-1] in b".,!?;:" else (raw, b"")
            if core.isalpha():
                got = self.word(core.lower())
            elif (text := core.decode()).isalpha() and "\u0130" not in text:  # that letter's lower case is two characters
                text = unicodedata.normalize("NFC", text)
                got = self.word(("".join(map(str.lower, text)) if "\u03a3" in text else text.lower()).encode())
            else:
                got, sign = self.stretch(raw.decode()), b""
            if sign:
                got += self.word(sign)
        if len(raw) <= 64:
            if len(self) >= MEMORY:
                self.older = dict(self)
                self.clear()
            self[raw] = got
        return got

    def encode(self, text: bytes) -> bytes:
        """Ids of a whole text, four bytes each."""
        return b"".join(map(self.__getitem__, text.split()))

    def decode(self, ids: bytes) -> str:
        return " ".join(map(self.strings.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def load(spec: str) -> Bpe:
    """One encoder for each worker process and tokenizer file, until another operator's task runs there."""
    return remembered(("bpe", zlib.crc32(spec.encode())), lambda: Bpe(spec))


def read_spec(path: str | None = None) -> str:
    return Path(path or public_tokenizers.path(VOCABULARY)).read_text(encoding="utf-8")


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, ids binary, decoded string) of every row."""
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(path))
    shape = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())])

    def run(batches):
        bpe = load(spec.value)
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                ids = [bpe.encode(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.array(map(bpe.decode, ids), pa.string())], names=["doc_id", "ids", "decoded"])

    return docs.select(F.col(id_col).alias("doc_id"), text_bytes(text_col).alias("t")).mapInArrow(run, shape)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): as ``encode``, but only digests leave the worker."""
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(path))
    shape = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def run(batches):
        bpe = load(spec.value)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for b in batches:
            rows = []
            for t in b.column(1).to_pylist():
                ids = bpe.encode(t)
                rows.append((len(ids) // 4, sha(ids), sha(bpe.decode(ids).encode())))
            n, x, y = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(x, pa.string()), pa.array(y, pa.string())], names=shape.names)

    return docs.select(F.col(id_col).alias("doc_id"), text_bytes(text_col).alias("t")).mapInArrow(run, shape)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir))
