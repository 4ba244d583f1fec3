"""Toxicity with noisy-channel deobfuscation.

A character language model (4-grams over a-z and a boundary, interpolated to lower orders) is counted
over the whole corpus. A token that looks disguised (signs or digits among letters, a letter three times
in a row, single letters spaced out) becomes a lattice: a sign stands for letters it resembles or for nothing, a repeated
letter for itself or for nothing, a space between single letters for nothing or for a word's end. Viterbi
search finds the cheapest reading under channel and language model; features come from what is restored.

Features are words (doubled letters written once, but in words that this would leave with one or two letters) and their first four to eight letters. Weights are log
likelihood ratios of documents that hold a feature, learnt from at most ``most_labels`` labelled rows of the
training folds, chosen by hash. Labelled rows that are exact or near copies of each other count once, toxic and
other ones on their own, so that a text copied often is no more evidence than the text.

Defined cases: a null or empty text has no features and gets the score of texts without evidence;
several labels of one document count as toxic if one is; null ids are never labelled; without labels all scores are
those of the prior, under one half; repeated rows give repeated results; an empty table gives an empty result; other columns are ignored, those in
``keep`` pass as ``in_<name>``, so no name can clash. Very long texts are counted in slices and split as a stream.

All features that pass the tests of evidence have a weight. Each needs three toxic documents of the at most ``most_labels`` labelled ones, so the
table that is broadcast grows with that sample, not with the corpus.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import alone, batch_of, documents, fold_of, remembered, spool, stretches, text_bytes
from graphloom.llm.near_dedup import classes

A = 27  # a to z, and 0 for a word's end or any other byte
CODES = np.zeros(256, np.int64)
CODES[97:123] = CODES[65:91] = np.arange(1, 27)
#: What a sign may stand for.
LOOKS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
LETTERS = "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = "._-*~'`^,/\\"
# channel costs, in nats
LOOK, DROP_SIGN, DROP_END, DROP_SEPARATOR, DROP_THIRD, DROP_DOUBLE, STAR, JOIN, BREAK = 1.0, 7.0, 4.0, 0.5, 0.7, 5.0, 4.0, 0.3, 2.0
SPACED = re.compile(rb"(?<!\S)(?:[a-z0-9@$!|+*][ \t._-]+){2,}[a-z0-9@$!|+*](?![^\s.,!?;:])")
# leading signs that may be letters stay, and so do trailing ones and stars: Viterbi decides between letters and noise
EDGES = re.compile(r"^[^a-z0-9@$!|+(€£À-￿]+|[^a-z0-9@$!|+(*€£À-￿]+$")
DISGUISED = re.compile(r"(?=.*[a-z])(?:.*[0-9@$!|+(*€£_~^`].*|.*(.)\1\1.*|.*[a-z][.\-/'][a-z].*)|(?![$€£+(]?[\d.,]+[$€£+!(*]?$)(?=..)(?=.*[@$!|+(€£])[0-9@$!|+(*€£]+$", re.S)
STARRED = re.compile(r"\*{3,}[@$!|+(*€£]*$")
MASKED = re.compile(r"[a-z]{1,3}\*{2,}")
REPEATED = re.compile(r"(.)\1+")
TRIPLE = re.compile(r"(.)\1\1")
LETTERS_ONLY = re.compile(r"[a-zÀ-₫₭-￿]+")  # no sign that may stand for a letter: the euro sign is left out
ASCII_EDGES = "\"#%&'),-./:;<=>?[\\]^_`{}~"  # signs that EDGES takes off both ends
MEMORY = 300_000
STEMS = (4, 5, 6, 7, 8)
SLICE = 1 << 20  # bytes of text that are counted at a time
LEAST_G, LEAST_RATIO = 22.0, 3.0  # chi-square evidence and log likelihood ratio of a feature


class CharModel:
    """log P(next | up to three characters before it), Witten-Bell interpolated."""

    def __init__(self, four: np.ndarray):
        four = four.reshape(A, A, A, A).astype(np.float64)
        three, self.known, self.costs = four.sum(0), {}, {}
        two = three.sum(0)
        one = two.sum(0)
        self.tables = [one, two, three, four]

    def p(self, context: str) -> np.ndarray:
        """Distribution of the next character after ``context``, which starts at a word's start (a space) if shorter than 3."""
        got = self.known.get(context)
        if got is None:
            if not context:
                got = (self.tables[0] + 1) / (self.tables[0].sum() + A)
            else:
                row = self.tables[len(context)][tuple(0 if c == " " else ord(c) - 96 for c in context)]
                kinds = np.count_nonzero(row) + 1
                got = (row + kinds * self.p(context[1:])) / (row.sum() + kinds)
            self.known[context] = got
        return got

    def cost(self, context: str, c: str) -> float:
        costs = self.costs.get(context)
        if costs is None:
            costs = self.costs[context] = [-math.log(x) for x in self.p(context)]
        return costs[0 if c == " " else ord(c) - 96]


@lru_cache(1)
def _ending(s: str) -> int:
    """Where the signs begin that end ``s``."""
    return len(s.rstrip("@$!|+(*€£"))


def options(s: str, i: int) -> list[tuple[str, float]]:
    """What the character at place i may stand for, and the channel's cost."""
    c = s[i]
    if "a" <= c <= "z":
        out = [(c, 0.0)]
        if i and s[i - 1] == c:
            run = 2 + (i > 1 and s[i - 2] == c) + (i + 1 < len(s) and s[i + 1] == c)
            out.append(("", DROP_THIRD if run > 2 else DROP_DOUBLE))
        return out
    if c == " ":
        return [("", JOIN), (" ", BREAK)]
    if c == "*":
        return [("", DROP_SEPARATOR), *[(x, STAR) for x in LETTERS]]
    if c in LOOKS:
        at_end = not c.isdigit() and i >= _ending(s)
        return [*[(x, LOOK) for x in LOOKS[c]], ("", DROP_END if at_end else DROP_SIGN)]
    if c in SEPARATORS:
        return [("", DROP_SEPARATOR)]
    return [(c, 0.0)]


def _single(s: str) -> bool:
    """Whether ``s`` has one reading, itself: letters only, none of which follows itself."""
    return bool(LETTERS_ONLY.fullmatch(s)) and not REPEATED.search(s)


def restore(s: str, model: CharModel) -> str:
    """Cheapest reading of ``s``: Viterbi over the lattice, a state being the last three characters."""
    if _single(s):
        return s
    best: dict[str, tuple[float, tuple | None]] = {" ": (0.0, None)}
    for i in range(len(s)):
        nxt: dict[str, tuple[float, tuple | None]] = {}
        for c, channel in options(s, i):
            foreign = c and c != " " and not "a" <= c <= "z"
            for state, (cost, path) in best.items():
                if not c:
                    key, total, new = state, cost + channel, path
                elif foreign:
                    key, total, new = " ", cost, (path, c)  # letters outside the model pass and start afresh
                else:
                    key = " " if c == " " else (state + c)[-3:]
                    total, new = cost + channel + model.cost(state, c), (path, c)
                if key not in nxt or total < nxt[key][0]:
                    nxt[key] = (total, new)
        best = nxt
    _, path = min(((cost + (0 if state == " " else model.cost(state, " ")), path) for state, (cost, path) in best.items()), key=lambda x: x[0])
    out = []
    while path:
        path, c = path
        out.append(c)
    return "".join(reversed(out))


def readings(token: str, model: CharModel) -> list[str]:
    """The words that a lower-case token stands for."""
    core = EDGES.sub("", token)
    if not core:
        return []
    if " " in core or DISGUISED.match(core):
        # three stars and more at the end make a lattice of 26**3 readings and never beat being dropped
        words = restore(STARRED.sub("", core), model).split()
        # a short word whose end is starred out can't be read letter by letter: its masked form is a word too
        return [*words, core] if MASKED.fullmatch(core) else words
    return [core]


def features(word: str) -> list[str]:
    key = REPEATED.sub(r"\1", word)
    return ["=" + key, *[key[:n] for n in STEMS if len(key) >= n]] if len(key) > 2 else ["=" + re.sub(r"(.)\1\1+", r"\1\1", word)]


class Reader(dict):
    """Token -> features, for tokens met lately."""

    def __init__(self, model: CharModel, weights: dict[str, float] | None = None):
        super().__init__()
        self.model, self.weights = model, weights
        # all features of a word of four letters or more begin with its key's first four
        self.starts = {f.removeprefix("=")[:4] for f in weights or ()}

    def __missing__(self, token: bytes):
        text = token.decode().lower()
        core = text.strip(ASCII_EDGES)
        if LETTERS_ONLY.fullmatch(core) and not TRIPLE.search(core):  # not disguised
            key = REPEATED.sub(r"\1", core) if self.weights is not None else ""
            words = [] if len(key) > 2 and key[:4] not in self.starts else [core]
        else:
            words = readings(text, self.model)
        if not words:
            got = ()
        elif self.weights is None:
            got = tuple(f for w in words for f in features(w))
        else:  # the strongest feature of each word, if one has a weight
            got = tuple((f, x) for w in words if (known := [(self.weights[f], f) for f in features(w) if f in self.weights]) for x, f in [max(known)])
        if len(self) >= (MEMORY if self.weights is not None else MEMORY // 8):  # lists of all features are much longer
            self.clear()
        if len(token) <= 64:
            self[token] = got
        return got

    def tokens(self, text: bytes) -> set[bytes]:
        """The distinct tokens of a text, and what its spaced words are without their spaces doubled."""
        text = text.lower()
        out = set()
        for part in stretches(text):
            out.update(part.split())
        for m in SPACED.finditer(text):
            if b" " in m[0] or b"\t" in m[0]:
                out.add(b" ".join(m[0].split()))
        return out

    def score(self, text: bytes) -> float:
        """Sum over distinct words of the weight of their strongest feature."""
        found = {f: x for hit in filter(None, map(self.__getitem__, self.tokens(text))) for f, x in hit}  # most tokens have no weight
        return sum(found.values())


def _reader(key: str, make) -> Reader:
    """One for each worker process and model; other models' and other operators' tables are dropped."""
    return remembered(("toxicity", key), make)


def slices(texts: list[bytes], most: int):
    """The texts, each with a line's end behind it, as one stream of pieces of at most ``most`` bytes."""
    held, size = [], 0
    for t in texts:
        for i in range(0, max(1, len(t)), most):
            part = t[i : i + most]
            if size + len(part) > most:
                yield b"".join(held)
                held, size = [], 0
            held.append(part)
            size += len(part)
        held.append(b"\n")
    if held:
        yield b"".join(held)


def char_model(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """4-gram counts of the whole corpus, at most A**4 numbers."""
    schema = pa.schema([("code", pa.int32()), ("n", pa.int64())])

    @alone
    def run(batches):
        total, tail = np.zeros(A**4, np.int64), np.zeros(0, np.int64)
        for b in batches:
            for piece in slices(b.column(0).to_pylist(), SLICE):
                c = np.concatenate((tail, CODES[np.frombuffer(piece, np.uint8)]))
                if len(c) > 3:
                    total += np.bincount(((c[:-3] * A + c[1:-2]) * A + c[2:-1]) * A + c[3:], minlength=A**4)
                tail = c[-3:]
        seen = np.flatnonzero(total)
        yield batch_of(schema, [seen.astype(np.int32), total[seen]])

    got = docs.select(text_bytes(text_col).alias("t")).mapInArrow(run, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(A**4, np.int64)
    out[got.column("code").to_numpy()] = got.column("n").to_numpy()
    return out


def _evidence(n1, n0, total1: float, total0: float):
    """(G statistic, log likelihood ratio) of a feature in n1 of total1 toxic and n0 of total0 other documents; n1 and n0 are columns."""
    p1, p0, p = (n1 + 0.5) / (total1 + 1), (n0 + 0.5) / (total0 + 1), (n1 + n0 + 1) / (total1 + total0 + 2)
    absent = lambda q: F.log(F.greatest(1 - q, F.lit(1e-9)) / (1 - p))
    return 2 * (n1 * F.log(p1 / p) + n0 * F.log(p0 / p) + (total1 - n1) * absent(p1) + (total0 - n0) * absent(p0)), F.log(p1 / p0)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_labels: int = 50_000) -> tuple[np.ndarray, dict[str, float], tuple[float, float]]:
    """(character counts, feature weights, (intercept, slope) of the log odds)."""
    sc = docs.sparkSession.sparkContext
    four = char_model(docs, text_col)
    b_four = sc.broadcast(four)
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold_of("doc_id") != 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n_usable = usable.count()
    if n_usable > most_labels:
        usable = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * most_labels / n_usable))
    usable = spool(usable, "toxic-labels")  # about most_labels rows of 12 bytes at most
    sample = spool(docs.select(F.col(id_col).alias("doc_id"), text_bytes(text_col).alias("t")).join(F.broadcast(usable), "doc_id").select("doc_id", "toxic", "t").withColumn("row", F.monotonically_increasing_id()), "toxic-sample")

    def totals(rows):
        n = rows.agg(F.count_if(F.col("toxic") > 0), F.count_if(F.col("toxic") <= 0)).first()
        return n[0], n[1]

    n1, n0 = totals(sample)
    prior = math.log((n1 + 0.5) / (n0 + 1.0))  # below even without labels
    if not n1 or not n0:
        return four, {}, (prior, 1.0)
    rows = sample.select("row", F.col("toxic") > 0)
    copies = classes(sample.select("doc_id", F.col("t").cast("string").alias("text"), "row"), row_col="row").select(F.col("rid").alias("row"), "class_id")
    first = copies.join(rows.toDF("row", "bad"), "row").groupBy("class_id", "bad").agg(F.min("row").alias("row")).select("row")
    # reading a row takes long beside moving it: many even parts
    distinct = spool(sample.join(first, "row", "left_semi").repartition(max(8, (n1 + n0) // 1000), "row").select("toxic", "t"), "toxic-distinct")
    n1, n0 = totals(distinct)
    sample = sample.select("toxic", "t")
    key = str(id(b_four)) + str(b_four._jbroadcast.id() if b_four._jbroadcast else "")
    schema = pa.schema([("f", pa.string()), ("n1", pa.int64()), ("n0", pa.int64())])

    def count(batches):
        reader = _reader(key + "fit", lambda: Reader(CharModel(b_four.value)))
        held: tuple[Counter, Counter] = Counter(), Counter()

        def rows():
            names = list(held[0] | held[1])
            return batch_of(schema, [names, [held[1][f] for f in names], [held[0][f] for f in names]])

        for b in batches:
            for toxic, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                held[toxic > 0].update(set().union(*map(reader.__getitem__, reader.tokens(t))))
                if len(held[0]) + len(held[1]) > MEMORY // 2:
                    yield rows()
                    held = Counter(), Counter()
        yield rows()

    by_feature = distinct.mapInArrow(count, "f string, n1 long, n0 long").groupBy("f").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    # the features that toxic documents hold often enough; the rest never leave the executors
    g, ratio = _evidence(F.col("n1"), F.col("n0"), float(n1), float(n0))
    kept = by_feature.where("n1 >= 3").select("f", ratio.alias("ratio"), g.alias("g")).where((F.col("g") >= LEAST_G) & (F.col("ratio") >= LEAST_RATIO))
    weights = {r.f: min(6.0, r.ratio) for r in kept.orderBy("f").select("f", "ratio").toLocalIterator()}
    b_weights = sc.broadcast(weights)
    steps = pa.schema([("step", pa.int32()), ("toxic", pa.int32())])

    def evidence(batches):
        reader = _reader(key + "sum", lambda: Reader(CharModel(b_four.value), b_weights.value))
        for b in batches:
            yield batch_of(steps, [[round(4 * reader.score(t)) for t in b.column(1).to_pylist()], [int(x > 0) for x in b.column(0).to_pylist()]])

    sums = sample.mapInArrow(evidence, "step int, toxic int").groupBy("step").agg(F.sum("toxic"), F.count(F.lit(1))).collect()  # a row for each step that the sample's sums take
    return four, weights, _calibrate([(r[0] / 4, r[1], r[2]) for r in sums], prior)


def _calibrate(sums: list[tuple[float, int, int]], prior: float) -> tuple[float, float]:
    """(intercept, slope) of the logistic fit of labels to evidence, drawn a little towards (prior, 1)."""
    x, y, n = (np.array(c, float) for c in zip(*sums))
    start = w = np.array([prior, 1.0])
    ridge = np.diag([1.0, 1.0])
    design = np.column_stack((np.ones_like(x), x))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        step = np.linalg.solve(design.T @ (design * (n * p * (1 - p))[:, None]) + ridge, design.T @ (y - n * p) - ridge @ (w - start))
        w = w + np.clip(step, -1, 1)
    return float(w[0]), float(w[1])


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, **options_) -> DataFrame:
    """doc_id, held_out, score, predicted of every row, and the columns in ``keep``, unchanged, as ``in_<name>``."""
    sc = docs.sparkSession.sparkContext
    b_model = sc.broadcast(fit(docs, labels, id_col, text_col, **options_))
    four, weights, _ = b_model.value
    key = "score-" + hashlib.sha256(four.tobytes() + repr(sorted(weights.items())).encode()).hexdigest()
    keep = keep or []
    passed = [T.StructField(f"in_{c}", docs.schema[c].dataType) for c in keep]
    shape = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), *passed])

    def run(batches):
        four, weights, (intercept, slope) = b_model.value
        reader = _reader(key, lambda: Reader(CharModel(four), weights))
        for b in batches:
            scores = [1 / (1 + math.exp(-max(-700.0, min(700.0, intercept + slope * reader.score(t))))) for t in b.column("__t").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("__id"), b.column("__held"), pa.array(scores, pa.float64()), pa.array([int(x >= 0.5) for x in scores], pa.int32()), *[b.column(f"__k{i}") for i in range(len(keep))]], names=shape.names)

    rows = docs.select(F.col(id_col).alias("__id"), (fold_of(id_col) == 0).alias("__held"), text_bytes(text_col).alias("__t"), *[F.col(c).alias(f"__k{i}") for i, c in enumerate(keep)])
    return rows.mapInArrow(run, shape)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))
