"""Near-dedup by BagMinHash over weighted word shingles.

A text is a multiset of five-word shingles. Weights are discretised to whole levels, and levels are
grouped to dyadic blocks: level 1, 2, 3-4, 5-8 and so on. Every (shingle, block) has a Poisson process of
its own, of the block's size in rate, whose points each fall on a register and on a level of the block; a text sees the
points up to its weight. A register's value is the time of its first point, so two texts agree in a register
with the probability of their weighted Jaccard similarity. Points are drawn in rounds, and a process ends once it is later
than the latest register.

Registers are banded. Texts with the same words are one node first. In each bucket all nodes meet the
smallest one; components of the verified links follow. In buckets that still hold several components, the nodes outside the
largest one are open. Where they are few, each is held against all nodes of other components by an exact filter: each text
has a map of 1024 bits, in which every shingle flips one, and two maps differ in no more bits than the texts do in shingles.
Wide buckets, of many open nodes or of texts too long for the map, would cost the square of their size that way. Their
nodes meet by their rarest shingles instead, which finds every pair that is alike, but for pairs that other links have joined: see ``rare_links``. Only pairs that pass become
rows; no pair of a bucket whose link could matter is left out. Links are verified by the exact multiset overlap of whole texts.

Defined cases: a text of one to four words is one shingle; texts without words (null too) are alike; null ids
are larger than all others; repeated rows are one node; columns other than id and text are ignored.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_64_intdigest

from graphloom.lineage import cut_measured
from graphloom.llm.common import alone, batch_of, documents, filter_of, maybe_in, spool, text_bytes
from graphloom.llm.components import components

WIDTH = 5
BANDS, ROWS = 28, 6  # at similarity 0.8, 0.9998 of the pairs share a bucket
THRESHOLD = (4, 5)  # overlap of at least 4/5 of the union
BATCH = 300_000  # words of a numpy batch
MAP = 1024  # bits of a text's parity map
FEW_OPEN = 64  # open nodes of a bucket that meet all others of it; with more the bucket is wide
LONG = 2 * MAP  # shingles; between longer texts the map tells little
MANY = 8  # pairs of a group's nodes to a row, beyond which the groups' roots are joined first
MOST_TURNS = 4
MOST_COUNTS = 20  # bits of a hash by which the shingles of wide buckets are counted

_K = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of every shingle of every text, in order."""
    n = np.array([len(w) for w in words], np.int64)
    h = np.fromiter((x for w in words for x in map(xxh3_64_intdigest, w)), np.uint64, int(n.sum()))
    starts = np.concatenate(([0], np.cumsum(n)))[:-1]
    count = np.where(n >= WIDTH, n - WIDTH + 1, np.minimum(n, 1))
    doc = np.repeat(np.arange(len(n)), count)
    first = starts[doc] + np.arange(len(doc)) - np.repeat(np.concatenate(([0], np.cumsum(count)))[:-1], count)
    length = np.minimum(n, WIDTH)[doc]
    out = length.astype(np.uint64)
    for i in range(WIDTH):
        use = length > i
        out[use] = _mix(out[use] * _K + h[first[use] + i])
    return out, doc


def weighted(sh: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text number, weight) of the distinct shingles of each text."""
    key = _mix(sh + (doc.astype(np.uint64) + np.uint64(1)) * _K)
    order = np.argsort(key)
    new = np.flatnonzero(np.concatenate(([True], key[order][1:] != key[order][:-1]))) if len(key) else np.zeros(0, np.int64)
    return sh[order[new]], doc[order[new]], np.diff(np.append(new, len(key)))


def bag_min_hash(sh: np.ndarray, doc: np.ndarray, weight: np.ndarray, texts: int, registers: int) -> np.ndarray:
    """texts x registers times of first points; infinite for a text without shingles."""
    out = np.full(texts * registers, np.inf)
    parts = [(sh, doc, weight, 0, 1)]
    low, size = 1, 1
    while (weight > low).any():
        above = weight > low
        parts.append((sh[above], doc[above], weight[above], low, size))
        low, size = low + size, size * 2
    salts = np.arange(len(parts), dtype=np.uint64) * _K + np.uint64(0xA24BAED4963EE407)
    seed = np.concatenate([_mix(s ^ salt) for salt, (s, *_) in zip(salts, parts)])
    at = np.concatenate([d for _, d, *_ in parts])
    room = np.concatenate([w - lo for _, _, w, lo, _ in parts])  # levels of the block that the text has
    rate = np.concatenate([np.full(len(s), float(z)) for s, *_, z in parts])
    time = np.zeros(len(seed))
    j = 0
    with np.errstate(over="ignore"):
        while len(seed):
            j += 1
            u = _mix(seed + np.uint64(j) * _K)
            time = time - np.log(((u >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53) / rate
            v = _mix(u ^ np.uint64(0xD6E8FEB86659FD93))
            register = (v >> np.uint64(32)) % np.uint64(registers)
            level = ((v & np.uint64(0xFFFFFFFF)).astype(np.float64) / 2.0**32 * rate).astype(np.int64)
            seen = level < room
            np.minimum.at(out, at[seen] * registers + register[seen].astype(np.int64), time[seen])
            last = out.reshape(texts, registers).max(1)
            alive = time < last[at]
            seed, at, room, rate, time = seed[alive], at[alive], room[alive], rate[alive], time[alive]
    return out.reshape(texts, registers)


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    bits = signature.view(np.uint64).reshape(len(signature), bands, rows)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64), (len(signature), bands))
    with np.errstate(over="ignore"):
        for i in range(rows):
            key = _mix(key * _K + bits[:, :, i])
    return key.astype(np.int64)


def parity_maps(sh: np.ndarray, doc: np.ndarray, weight: np.ndarray, texts: int) -> np.ndarray:
    """texts x MAP / 64 words: each shingle, equal ones told apart as by ``ranked_set``, flips one bit of its text's map."""
    rank = np.arange(int(weight.sum())) - np.repeat(np.concatenate(([0], np.cumsum(weight)))[:-1], weight)
    h = _mix(np.repeat(sh, weight) + rank.astype(np.uint64) * _K)
    flips = np.bincount(np.repeat(doc, weight) * MAP + (h >> np.uint64(64 - MAP.bit_length() + 1)).astype(np.int64), minlength=texts * MAP)
    return np.packbits((flips & 1).astype(np.uint8), bitorder="little").view(np.int64).reshape(texts, MAP // 64)


def ranked_set(words: list[bytes]) -> np.ndarray:
    """The multiset of a text's shingles as a sorted set: the i-th of equal shingles is told from the others."""
    sh = np.sort(shingles([words])[0])
    if not len(sh):
        return sh
    start = np.flatnonzero(np.concatenate(([True], sh[1:] != sh[:-1])))
    rank = np.arange(len(sh)) - np.repeat(start, np.diff(np.append(start, len(sh))))
    return np.sort(_mix(sh + rank.astype(np.uint64) * _K))


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return THRESHOLD[1] * both >= THRESHOLD[0] * (len(a) + len(b) - both)


def sign(docs: DataFrame, id_col: str, text_col: str, bands: int, rows: int, row_col: str | None = None) -> DataFrame:
    """(rid, doc_id, same, n, bits, bands): row number, id, digest of the words, shingles, their parity map, band keys."""
    shape = T.StructType([T.StructField("rid", T.LongType()), T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("same", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("bits", T.ArrayType(T.LongType())), T.StructField("bands", T.ArrayType(T.LongType()))])

    @alone
    def run(batches):
        for b in batches:
            texts, at = b.column("t"), 0
            while at < b.num_rows:
                words, size, first = [], 0, at
                while at < b.num_rows and size < BATCH and len(words) < 2000:
                    words.append(texts[at].as_py().split())
                    size += len(words[-1])
                    at += 1
                sh, doc = shingles(words)
                count = np.bincount(doc, minlength=len(words))
                bag = weighted(sh, doc)
                keys = band_keys(bag_min_hash(*bag, len(words), bands * rows), bands, rows)
                maps = pa.FixedSizeListArray.from_arrays(parity_maps(*bag, len(words)).ravel(), MAP // 64).cast(pa.list_(pa.int64()))
                same = [hashlib.blake2b(b" ".join(w), digest_size=16).digest() for w in words]
                used = np.flatnonzero(count)
                lists = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(np.where(count > 0, bands, 0)))).astype(np.int32), keys[used].ravel())
                yield pa.RecordBatch.from_arrays([b.column("rid").slice(first, len(words)), b.column("doc_id").slice(first, len(words)), pa.array(same, pa.binary()), pa.array(count), maps, lists], names=shape.names)

    rid = F.monotonically_increasing_id() if row_col is None else F.col(row_col)
    return docs.select(rid.alias("rid"), F.col(id_col).alias("doc_id"), text_bytes(text_col).alias("t")).mapInArrow(run, shape)


def _verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts are alike; ``texts``: (node, t)."""
    b_text = pairs.join(texts.select(F.col("node").alias("b"), F.col("t").alias("tb")), "b")
    both = b_text.join(texts.select(F.col("node").alias("a"), F.col("t").alias("ta")), "a")

    @alone
    def run(batches):
        last, mine = None, None
        for x in batches:
            ids, ta, tb = x.column("a").to_pylist(), x.column("ta"), x.column("tb")
            keep = []
            for i, a in enumerate(ids):
                if a != last:
                    last, mine = a, ranked_set(ta[i].as_py().split())
                if alike(mine, ranked_set(tb[i].as_py().split())):
                    keep.append(i)
            yield x.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def _texts(docs: DataFrame, signed: DataFrame, nodes: DataFrame, text_col: str) -> DataFrame:
    """(node, t) of the nodes."""
    wanted = spool(signed.join(nodes.withColumnRenamed("node", "rid"), "rid", "left_semi").select(F.col("rid").alias("node"), "same"), "near-wanted")

    @alone
    def digest(batches):
        for b in batches:
            t = b.column(0)
            yield pa.RecordBatch.from_arrays([pa.array([hashlib.blake2b(b" ".join(x.split()), digest_size=16).digest() for x in t.to_pylist()], pa.binary()), t], names=["same", "t"])

    rows = docs.select(text_bytes(text_col).alias("t")).mapInArrow(digest, "same binary, t binary")
    maybe = maybe_in(rows, filter_of(wanted, "same"), "same").where("__maybe").select("same", "t")
    # of equal texts one is enough: partial aggregation drops the others before they move
    return spool(maybe.join(wanted, "same").groupBy("node").agg(F.first("t").alias("t")), "near-texts")


def rare_shingles(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(s, node, root, n, free, i): the rarest shingles of each of ``nodes`` (node, root, n, free), at most a fifth; i others of the text come before s.

    Shingles are ordered alike in all texts: those within one root first, which aren't returned, then the rarer. Any such order
    loses no pair. Rarity is counted by the first bits of the hashes, in a table of at most 2**``MOST_COUNTS`` numbers that is
    broadcast, so each text orders its shingles by itself and only its first fifth become rows. Shingles that share a number
    seem more frequent than they are; those of a number that one root has alone are within one root.
    """

    def grouped(parts):
        """(place of the first, parts) of as many parts at a time as have about ``BATCH`` shingles."""
        at, held, size = 0, [], 0
        for x in parts:
            held.append(x)
            size += max(1, len(x[0]) if isinstance(x, tuple) else len(x))
            if size >= BATCH:
                yield at, held
                at, held, size = at + len(held), [], 0
        if held:
            yield at, held

    @alone
    def sets(batches):
        for b in batches:
            for at, found in grouped(ranked_set(t.as_py().split()).view(np.int64) for t in b.column("t")):
                held = pa.ListArray.from_arrays(np.cumsum([0, *map(len, found)], dtype=np.int32), pa.array(np.concatenate(found)))
                yield pa.RecordBatch.from_arrays([*[b.column(c).slice(at, len(found)) for c in ("node", "root", "n", "free")], held], names=["node", "root", "n", "free", "set"])

    crowd = texts.join(nodes, "node").select("node", "root", "n", "free", "t").mapInArrow(sets, "node long, root long, n long, free boolean, set array<long>")
    crowd, seen = cut_measured(crowd, "near-sets", rows=F.sum("n"))
    shift = 64 - min(MOST_COUNTS, max(10, (4 * (seen["rows"] or 0)).bit_length()))
    counts = pa.schema([("place", pa.int32()), ("df", pa.int64()), ("low", pa.int64()), ("high", pa.int64())])

    @alone
    def count(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                found, held = part.column("set").flatten().to_numpy(zero_copy_only=False).view(np.uint64), pc.list_value_length(part.column("set")).to_numpy()
                if len(found):
                    place, root = (found >> np.uint64(shift)).astype(np.int32), np.repeat(part.column("root").to_numpy(), held)
                    order = np.argsort(place, kind="stable")
                    new = np.flatnonzero(np.concatenate(([True], np.diff(place[order]) > 0)))
                    yield batch_of(counts, [place[order[new]], np.diff(np.append(new, len(found))), np.minimum.reduceat(root[order], new), np.maximum.reduceat(root[order], new)])

    by_place = crowd.select("root", "set").mapInArrow(count, "place int, df long, low long, high long").groupBy("place")
    got = by_place.agg(F.sum("df").alias("df"), F.min("low").alias("low"), F.max("high").alias("high")).where("low < high").select("place", "df").toArrow()  # at most 2**MOST_COUNTS rows
    often = np.zeros(1 << (64 - shift), np.int64)
    often[got.column("place").to_numpy()] = got.column("df").to_numpy()
    b_often = nodes.sparkSession.sparkContext.broadcast(often)  # 8 MB at most
    rare = pa.schema([("s", pa.int64()), ("node", pa.int64()), ("root", pa.int64()), ("n", pa.int64()), ("free", pa.bool_()), ("i", pa.int64())])

    def first(found, often):
        """(shingles, places): those of a text's first fifth that are not within one root."""
        df = often[found >> np.uint64(shift)]
        order = np.lexsort((found, df))[: len(found) // 5 + 1]
        i = np.flatnonzero(df[order])
        return found[order[i]], i

    @alone
    def rarest(batches):
        often = b_often.value
        for b in batches:
            for at, parts in grouped(first(x.values.to_numpy(zero_copy_only=False).view(np.uint64), often) for x in b.column("set")):
                size = [len(s) for s, _ in parts]
                s, i = (np.concatenate(x) for x in zip(*parts))
                yield batch_of(rare, [s.view(np.int64), *[b.column(c).slice(at, len(parts)).take(pa.array(np.repeat(np.arange(len(parts)), size))) for c in ("node", "root", "n", "free")], i])

    return spool(crowd.mapInArrow(rarest, "s long, node long, root long, n long, free boolean, i long"), "near-rare")


def _by_shingle(rare: DataFrame) -> DataFrame:
    """(s, largest, all, open): of shingles met by several roots the one with most nodes, all nodes and those of other roots."""
    sizes = rare.groupBy("s", "root").agg(F.count(F.lit(1)).alias("count"))
    return sizes.groupBy("s").agg(F.max_by("root", F.struct("count", "root")).alias("largest"), F.sum("count").alias("all"), (F.sum("count") - F.max("count")).alias("open")).where("open > 0")


def _met(rare: DataFrame, groups: DataFrame) -> DataFrame:
    """(a, b): all pairs of different roots that could be alike; a pair of nodes of which neither is open in a group is of one root."""
    side = lambda x, rows: rows.select("s", "largest", *[F.col(c).alias(f"{c}_{x}" if c != "node" else x) for c in ("node", "root", "n", "free", "i")])
    rows = rare.join(groups.select("s", "largest"), "s")
    pairs = side("a", rows.where("root != largest")).join(side("b", rows).drop("largest"), "s").where(
        "root_a != root_b AND (root_b = largest OR a < b) AND (free_a OR free_b) AND (9 * i_a <= n_a AND n_a <= n_b OR 9 * i_b <= n_b AND n_b <= n_a) "
        f"AND {THRESHOLD[1]} * least(n_a, n_b) >= {THRESHOLD[0]} * greatest(n_a, n_b) AND {sum(THRESHOLD)} * least(n_a - i_a, n_b - i_b) >= {THRESHOLD[0]} * (n_a + n_b)"
    )
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _drawn(rare: DataFrame, groups: DataFrame, turn: int) -> DataFrame:
    """(a, b, root_a, root_b): of each shingle, one node drawn by hash and each node of another root, so no more pairs than rows."""
    rows = rare.join(groups.select("s"), "s")
    drawn = F.xxhash64("node", F.pmod("s", F.lit(8 << 4 * turn)), F.lit(turn))  # few nodes in all at first, then others for other shingles
    one = rows.groupBy("s").agg(F.min_by(F.struct("node", "root", "n"), drawn).alias("one"))
    both = rows.join(one, "s").where(f"one.root != root AND {THRESHOLD[1]} * least(n, one.n) >= {THRESHOLD[0]} * greatest(n, one.n)")
    return both.select(F.col("one.node").alias("a"), F.col("node").alias("b"), F.col("one.root").alias("root_a"), F.col("root").alias("root_b")).distinct()


def rare_pairs(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b): pairs of different roots, one of them free, that could be alike by their rarest shingles; all that are alike are among them.

    ``nodes``: (node, root, n, free). If a pair has its first common shingle after i of a's n_a and j of b's n_b, its overlap is
    at most min(n_a - i, n_b - j), which has to be 4/9 of n_a + n_b or more. So a text meets longer ones by its first ninth only and
    shorter ones by its first fifth: texts that share a template and differ in a ninth of their shingles never meet.
    """
    rare = rare_shingles(nodes, texts)
    return _met(rare, _by_shingle(rare))


def rare_links(nodes: DataFrame, texts: DataFrame, may_be_alike, links: list[DataFrame]) -> DataFrame:
    """``rare_pairs``, after links that join the roots of large groups have been added to ``links``.

    A group of n near copies has up to n * n / 2 links, of which n - 1 say the same. So while the pairs of different roots would be many
    beside the rows, each node first meets one that is drawn of each of its shingles' groups, and roots whose nodes
    are alike become one. Whatever that leaves apart meets in full.
    """
    rare, before = rare_shingles(nodes, texts), None
    for turn in range(MOST_TURNS):
        groups = spool(_by_shingle(rare), "near-groups")
        size = groups.agg(F.sum("all").alias("rows"), F.sum(F.col("open") * F.col("all")).alias("pairs")).first()
        if not size["rows"] or size["pairs"] <= MANY * size["rows"] or before and size["pairs"] > 0.9 * before:
            break
        before = size["pairs"]
        drawn = spool(may_be_alike(_drawn(rare, groups, turn)), "near-drawn")
        found = spool(_verify(drawn.select("a", "b"), texts), "near-links")
        links.append(found)
        joined = components(found.join(drawn, ["a", "b"]).select(F.col("root_a").alias("a"), F.col("root_b").alias("b")))
        joined = joined.select(F.col("node").alias("root"), F.col("root").alias("new"))
        rare = spool(rare.join(joined, "root", "left").withColumn("root", F.coalesce("new", "root")).drop("new"), "near-rare")
    else:
        groups = _by_shingle(rare)
    return _met(rare, groups)


#: At most so many shingles, and so many bits of the maps, differ between texts of n_a and n_b shingles that are alike.
_FEW_BITS = " + ".join(f"bit_count(bits_a[{i}] ^ bits_b[{i}])" for i in range(MAP // 64))
MAY_BE_ALIKE = f"{THRESHOLD[1]} * least(n_a, n_b) >= {THRESHOLD[0]} * greatest(n_a, n_b) AND {sum(THRESHOLD)} * ({_FEW_BITS}) <= {THRESHOLD[1] - THRESHOLD[0]} * (n_a + n_b)"


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS, rows: int = ROWS, row_col: str | None = None) -> DataFrame:
    """One row per document: rid, doc_id, class_id (its class's smallest id), class_size, kept (one row per class).

    rid is ``row_col`` if given, a column of different numbers, else a row number.
    """
    signed = spool(sign(docs, id_col, text_col, bands, rows, row_col), "near-signed")
    first = F.struct(F.col("doc_id").isNull(), "doc_id", "rid")
    nodes = spool(signed.groupBy("same").agg(F.min("rid").alias("node")), "near-nodes")
    members = signed.join(nodes.select(F.col("node").alias("rid")), "rid", "left_semi").select(F.explode("bands").alias("bucket"), F.col("rid").alias("node"), "n")
    buckets = spool(members.groupBy("bucket").agg(F.min("node").alias("pivot"), F.count(F.lit(1)).alias("size")).where("size > 1").select("bucket", "pivot"), "near-buckets")
    members = spool(members.join(buckets, "bucket"), "near-members")
    texts = _texts(docs, signed, members.select("node").distinct(), text_col)
    of = lambda x: signed.select(F.col("rid").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}"))

    first_pairs = members.where("node != pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    near = first_pairs.join(of("a"), "a").join(of("b"), "b").where(MAY_BE_ALIKE).select("a", "b")
    found = spool(_verify(near, texts), "near-links")
    roots = components(found)
    # what the smallest nodes of the buckets have left open
    placed = spool(members.join(roots, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root"), "n"), "near-placed")
    sizes = placed.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("count"), F.max("n").alias("longest"))
    wide = (F.sum("count") - F.max("count") > FEW_OPEN) | (F.max("longest") > LONG)
    several = sizes.groupBy("bucket").agg(F.max_by("root", F.struct("count", "root")).alias("largest"), F.count(F.lit(1)).alias("parts"), wide.alias("wide")).where("parts > 1")
    several = placed.join(spool(several.select("bucket", "largest", "wide"), "near-several"), "bucket")
    open_ = several.where("NOT wide").drop("wide", "n")
    open_ = spool(open_.join(signed.select(F.col("rid").alias("node"), "n", "bits", "bands"), "node"), "near-open")
    side = lambda x: open_.select("bucket", "largest", *[F.col(c).alias(x if c == "node" else f"{c}_{x}") for c in ("node", "root", "n", "bits", "bands")])
    left = side("a").where("root_a != largest").drop("largest")
    once = "array_intersect(bands_a, bands_b)[0] = bucket"  # in the first bucket that both are in
    pairs = left.join(side("b"), "bucket").where(f"root_a != root_b AND (root_b = largest OR a < b) AND {MAY_BE_ALIKE} AND {once}")
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links: list[DataFrame] = []
    crowd = spool(several.where("wide").groupBy("node").agg(F.first("root").alias("root"), F.first("n").alias("n"), F.max(F.col("root") != F.col("largest")).alias("free")), "near-crowd")
    if not crowd.isEmpty():
        may_be_alike = lambda met: met.join(of("a"), "a").join(of("b"), "b").where(MAY_BE_ALIKE).select(*met.columns)
        pairs = pairs.unionByName(may_be_alike(rare_links(crowd, texts, may_be_alike, links))).distinct()
    pairs = spool(pairs, "near-pairs")
    if not pairs.isEmpty():
        links.append(spool(_verify(pairs, texts), "near-links"))
    more = reduce(DataFrame.unionByName, links) if links else None
    if more is not None and not more.isEmpty():
        roots = components(found.unionByName(more))
    rooted = nodes.join(roots, "node", "left").select("same", F.coalesce("root", "node").alias("root"))
    rows_ = spool(signed.select("rid", "doc_id", "same").join(rooted, "same").select("rid", "doc_id", "root"), "near-rooted")
    heads = spool(rows_.groupBy("root").agg(F.min(first).alias("head"), F.count(F.lit(1)).alias("class_size")), "near-heads")
    return rows_.join(heads, "root").select("rid", "doc_id", F.col("head.doc_id").alias("class_id"), "class_size", (F.col("rid") == F.col("head.rid")).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without all but the smallest id of each class."""
    rows = spool(docs.withColumn("__row", F.monotonically_increasing_id()), "near-rows")
    dropped = spool(classes(rows, id_col, text_col, row_col="__row").where("NOT kept").select(F.col("rid").alias("__row")), "near-dropped")
    rows = maybe_in(rows, filter_of(dropped, "__row"), "__row")
    sure = rows.where("NOT __maybe").select(*docs.columns)
    return sure.unionByName(rows.where("__maybe").join(dropped, "__row", "left_anti").select(*docs.columns))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(documents(spark, sf_dir)).select("doc_id", "class_id", "class_size", "kept")
