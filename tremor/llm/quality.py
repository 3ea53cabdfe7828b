"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on every document.
Expectation-maximisation over the counts of all vote patterns (all documents;
at most 3**labellers rows) estimates how each labeller votes on good documents and
on each kind of bad ones, from prior beliefs worth a fixed number of documents, and
gives every pattern a posterior. The posteriors, as soft labels with both sides kept,
train a linear scorer on hashed words and character shapes (logistic regression) over a
priority sample of at most ``sample`` distinct texts: a text of many copies is
likelier to be in it, one that holds more than its share of the rows always is,
and weights make up for that, so the sample stands for the rows of the corpus
under any skew. The scorer then rates every whole document; ``kept`` means a probability of 0.5 or more.

Null and empty texts have no votes and no features: their score is that of the
intercept alone. Null keys are scored like others, repeated rows get equal
scores, an empty table gives no rows. Whole texts of any length are read; other
columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremor.llm.common import prepare, scratch, spread_ranges, stored, text_bytes, text_hash, text_slices, words_of

SLICE = 1 << 20  # bytes of text whose tables are held at once
KEEP = 0.5  # least score of a document that stays
SAMPLE = 8_000  # distinct texts the scorer is fitted on, at most
HASHES = 1 << 13  # hashed features of words, and as many of character shapes
ROUNDS = 60
# Prior beliefs about a labeller, worth PRIOR documents for each class and labeller at every size of
# the corpus: how often it calls a good document bad, how many it finds of the kind of junk it looks
# for, and of other kinds.
PRIOR, FALSE_ALARM, FINDS, FINDS_OTHERS = 20.0, 0.01, 0.9, 0.05
LABELLERS = ("capitals", "symbols", "repeats", "bars", "marks", "lower_starts", "sentences", "word_length")

N_FEATURES = 2 * HASHES
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
UPPER = np.zeros(256, np.int64)
UPPER[0x41:0x5B] = 1
LOWER = np.zeros(256, np.int64)
LOWER[0x61:0x7B] = 1
LOWER[0x80:] = 1
SYMBOL = np.zeros(256, np.int64)
SYMBOL[[ord(c) for c in "#$%&*+<=>@[]\\^_`{|}~"]] = 1
STOP = np.zeros(256, np.int64)
STOP[[ord(c) for c in ".?"]] = 1
# Shape of a byte: letters, capitals, digits and blanks are alike, punctuation is itself.
SHAPE = np.full(256, 38, np.int64)
SHAPE[0x21:0x7F] = 5 + np.arange(0x21, 0x7F) % 33
SHAPE[0x30:0x3A] = 2
SHAPE[0x41:0x5B] = 1
SHAPE[0x61:0x7B] = 0
SHAPE[0x80:] = 0
SHAPE[0x20] = 3
SHAPE[0x09:0x0E] = 4
ODD = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Texts:
    """Byte and word tables of a slice of documents."""

    raw: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray
    hashes: np.ndarray

    @property
    def n(self) -> int:
        return len(self.offsets) - 1

    def per_row(self, values: np.ndarray) -> np.ndarray:
        """Sums of a value of each byte by row."""
        total = np.concatenate(([0], np.cumsum(values)))
        return (total[self.offsets[1:]] - total[self.offsets[:-1]]).astype(float)

    def words(self, flags: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(self.rows, None if flags is None else flags, minlength=self.n).astype(float)

    def repeats(self) -> np.ndarray:
        again = np.zeros(len(self.rows), dtype=bool)
        again[1:] = (self.hashes[1:] == self.hashes[:-1]) & (self.rows[1:] == self.rows[:-1])
        return again


def tables(column: pa.Array) -> Texts:
    raw, offsets = text_bytes(column)
    starts, ends, rows = words_of(raw, offsets, NOT_SPACE)
    with np.errstate(over="ignore"):
        at = spread_ranges(starts, ends - starts)
        place = at - np.repeat(starts, ends - starts)
        mixed = (raw[at].astype(np.uint64) + np.uint64(1)) * POWERS[place % len(POWERS)]
        total = np.concatenate(([np.uint64(0)], np.cumsum(mixed, dtype=np.uint64)))
        bounds = np.concatenate(([0], np.cumsum(ends - starts)))
        hashes = (total[bounds[1:]] - total[bounds[:-1]]) * ODD
    return Texts(raw, offsets, starts, ends, rows, hashes)


POWERS = np.cumprod(np.full(256, 0x100000001B3, np.uint64))


def shares(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(the labellers' measures by row, words, words that begin with a letter)."""
    words = t.words()
    safe = np.maximum(words, 1)
    upper, lower = np.concatenate(([0], np.cumsum(UPPER[t.raw]))), np.concatenate(([0], np.cumsum(LOWER[t.raw])))
    high, low = upper[t.ends] - upper[t.starts], lower[t.ends] - lower[t.starts]  # letters of each word
    letters = t.words(high + low)
    last = t.raw[t.ends - 1]
    firsts = t.raw[t.starts]
    capitals = t.words((high > 1) & (low == 0)) / np.maximum(t.words(high + low > 0), 1)
    symbols = t.per_row(SYMBOL[t.raw]) / safe
    repeats = t.words(t.repeats()) / safe
    bars = t.words((last == ord("|")) & (t.ends - t.starts == 1)) / safe
    marks = t.words((last == ord("!")).astype(float)) / safe
    opened = t.words(LOWER[firsts] + UPPER[firsts])
    lowers = t.words(LOWER[firsts]) / np.maximum(opened, 1)
    stops = t.words(STOP[last]) / safe
    size = letters / safe
    return np.stack((capitals, symbols, repeats, bars, marks, lowers, stops, size), axis=1), words, opened


def votes(t: Texts) -> np.ndarray:
    """Vote of every labeller (columns) on every row: 1 good, 0 bad, -1 none."""
    values, words, opened = shares(t)
    lowers, stops, size = values[:, 5], values[:, 6], values[:, 7]
    # (good below, bad above) of each share; None: says nothing on that side
    ranges = ((0.15, 0.3), (0.05, 0.2), (0.08, 0.25), (0.02, 0.15), (0.05, 0.2), None, None, None)
    out = np.full((t.n, len(LABELLERS)), -1, np.int8)
    long = words >= 5
    for n, limits in enumerate(ranges):
        value = values[:, n]
        if limits:
            out[long & (value < limits[0]), n] = 1
            out[long & (value > limits[1]), n] = 0
    out[(opened >= 5) & (lowers > 0.6), 5] = 1
    out[(opened >= 5) & (lowers < 0.35), 5] = 0
    out[long & (stops > 0.02) & (stops < 0.4), 6] = 1
    out[(words >= 60) & (stops < 0.004), 6] = 0
    out[long & (size > 2.5) & (size < 12), 7] = 1
    out[long & ((size < 1.8) | (size > 16)), 7] = 0
    return out


def pattern_of(vote: np.ndarray) -> np.ndarray:
    """Votes as one number, base 3."""
    return (vote.astype(np.int64) + 1) @ 3 ** np.arange(vote.shape[1], dtype=np.int64)


def features(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, value) entries, several of one feature add up."""
    words = np.maximum(t.words(), 1)
    word = (t.hashes >> np.uint64(64 - HASHES.bit_length() + 1)).astype(np.int64)
    shape = SHAPE[t.raw]
    triple = (shape[:-2] * 39 + shape[1:-1]) * 39 + shape[2:] if len(shape) > 2 else np.zeros(0, np.int64)
    row = np.searchsorted(t.offsets, np.arange(len(triple)), side="right") - 1
    whole = np.arange(len(triple)) + 2 < t.offsets[row + 1]
    triple, row = triple[whole], row[whole]
    with np.errstate(over="ignore"):
        code = HASHES + ((triple.astype(np.uint64) * ODD) >> np.uint64(64 - HASHES.bit_length() + 1)).astype(np.int64)
    count = np.maximum(np.bincount(row, minlength=t.n), 1)
    return np.concatenate((t.rows, row)), np.concatenate((word, code)), np.concatenate((1 / words[t.rows], 1 / count[row]))


@dataclass
class Model:
    posterior: dict[int, float]  # of good, by vote pattern
    accuracy: dict[str, float]  # of each labeller where it votes, from the table that the posterior comes from
    weights: np.ndarray
    intercept: float


def fit_labels(patterns: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation over vote patterns: (posterior of good by pattern, labeller accuracies).

    Class 0 is good; every labeller has a class of bad documents of its own, which those that it calls
    bad begin in, so that no kind of junk has to look like another. Both results come from the
    same table of votes by class.
    """
    kinds = len(LABELLERS)
    vote = (patterns[:, None] // 3 ** np.arange(kinds)) % 3  # 0 none, 1 bad, 2 good
    counts = counts.astype(float)
    belief = np.empty((1 + kinds, kinds, 2))
    belief[0], belief[1:] = (FALSE_ALARM, 1 - FALSE_ALARM), (FINDS_OTHERS, 1 - FINDS_OTHERS)
    belief[1 + np.arange(kinds), np.arange(kinds)] = FINDS, 1 - FINDS
    said = np.stack((vote == 1, vote == 2), axis=2).astype(float)  # silence is no evidence
    good = np.where((vote == 1).any(1), 0.05, 0.95)
    blame = (vote == 1) + 1e-3
    share = np.column_stack((good, (1 - good)[:, None] * blame / blame.sum(1, keepdims=True)))
    for _ in range(ROUNDS):
        weight = share * counts[:, None]
        table = np.einsum("pc,pns->cns", weight, said) + PRIOR * belief
        size = weight.sum(0) + PRIOR / (1 + kinds)
        chance = np.log(table / table.sum(2, keepdims=True))
        logit = np.log(size / size.sum()) + np.einsum("pns,cns->pc", said, chance)
        share = np.exp(logit - logit.max(1, keepdims=True))
        share /= share.sum(1, keepdims=True)
    right = table[0, :, 1] + table[1:, :, 0].sum(0)
    return share[:, 0], right / table.sum((0, 2))


def priority_sample(texts: DataFrame, sample: int) -> tuple[list[tuple[int, float]], int]:
    """((text hash, weight) of at most ``sample`` distinct texts, distinct texts in all).

    A text with n rows has priority n / u, u in (0, 1] from its salted hash. The highest
    priorities are taken; a weight is n, or the first priority left out if that is more.
    """
    u = (F.shiftrightunsigned(F.xxhash64("text_hash", F.lit(7)), 11) + 1) / float(1 << 53)
    ranked = texts.groupBy("text_hash").agg(F.count("*").alias("n")).select("text_hash", "n", (F.col("n") / u).alias("priority"))
    ranked = stored(ranked, f"{scratch(texts.sparkSession, 'quality')}/priorities")
    # Counts by size of priority bring the rows that come to the driver down to little more than the sample.
    sizes = ranked.groupBy(F.floor(F.log2("priority") * 8).alias("size")).count().orderBy(F.desc("size")).collect()
    above, least = 0, 0
    for r in sizes:
        above, least = above + r["count"], r["size"]
        if above > sample:
            break
    top = ranked.filter(F.floor(F.log2("priority") * 8) >= least).collect()
    top.sort(key=lambda r: (-r.priority, r.text_hash))
    limit = top[sample].priority if len(top) > sample else 0.0
    return [(r.text_hash, float(max(r.n, limit))) for r in top[:sample]], sum(r["count"] for r in sizes)


def fit(spark: SparkSession, docs: DataFrame, *, text: str = "text", sample: int = SAMPLE) -> Model:
    texts = docs.select(F.col(text).alias("text"), text_hash(text).alias("text_hash"))

    def patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text", SLICE):
                found, n = np.unique(pattern_of(votes(tables(part.column(0)))), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n.astype(np.int64))], names=["pattern", "n"])

    # One row per vote pattern: at most 3**8.
    counted = texts.mapInArrow(patterns, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").collect()
    if not counted:
        return Model({}, dict.fromkeys(LABELLERS, 0.0), np.zeros(N_FEATURES), 0.0)
    ids, counts = np.array([r[0] for r in counted], np.int64), np.array([r[1] for r in counted], np.int64)
    good, accuracy = fit_labels(ids, counts)
    posterior = dict(zip(ids.tolist(), good.tolist(), strict=True))
    total = int(counts.sum())
    sampled, distinct = priority_sample(texts, sample)
    weight_of = dict(sampled)
    chosen = texts
    if distinct > len(sampled):  # the table of at most ``sample`` hashes goes to every task
        chosen = texts.join(F.broadcast(spark.createDataFrame([(h,) for h, _ in sampled], "text_hash long")), "text_hash").select("text", "text_hash")

    def soft_labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()  # a task gives each text once
        for batch in batches:
            hashes = batch.column(1).to_pylist()
            first = [n for n, h in enumerate(hashes) if h not in met and not met.add(h)]
            for part in text_slices(batch.take(pa.array(first, pa.int64())), "text", SLICE):
                t = tables(part.column(0))
                row, feature, value = features(t)
                key, at = np.unique(row * N_FEATURES + feature, return_inverse=True)
                sums = np.bincount(at, value)
                bounds = np.searchsorted(key // N_FEATURES, np.arange(t.n + 1))
                label = [posterior[p] for p in pattern_of(votes(t)).tolist()]
                lists = pa.array(bounds.astype(np.int32))
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array([weight_of[h] for h in part.column(1).to_pylist()], pa.float64()), pa.array(label), pa.ListArray.from_arrays(lists, pa.array((key % N_FEATURES).astype(np.int32))),
                                                  pa.ListArray.from_arrays(lists, pa.array(sums))], names=["text_hash", "rows", "good", "at", "value"])

    vector = F.udf(lambda at, value: SparseVector(N_FEATURES, at, value), VectorUDT())  # over the bounded sample only
    rows = chosen.mapInArrow(soft_labels, "text_hash long, rows double, good double, at array<int>, value array<double>").dropDuplicates(["text_hash"])
    rows = rows.select("rows", "good", vector("at", "value").alias("features"))
    soft = rows.select("features", "rows", F.explode(F.array(F.struct(F.lit(1.0).alias("label"), F.col("good").alias("weight")),
                                                     F.struct(F.lit(0.0).alias("label"), (1 - F.col("good")).alias("weight")))).alias("l")).select("features", "rows", "l.*")
    soft = soft.withColumn("weight", F.col("weight") * F.col("rows")).drop("rows").cache()
    try:
        if soft.select("label").distinct().count() < 2:  # all documents alike
            return Model(posterior, dict(zip(LABELLERS, accuracy.tolist(), strict=True)), np.zeros(N_FEATURES), 4.0 if good @ counts > total / 2 else -4.0)
        trained = LogisticRegression(maxIter=60, regParam=1e-3, weightCol="weight", standardization=True).fit(soft)
    finally:
        soft.unpersist()
    return Model(posterior, dict(zip(LABELLERS, accuracy.tolist(), strict=True)), trained.coefficients.toArray(), float(trained.intercept))


def rate(column: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(weak posterior, score) of every text."""
    t = tables(column)
    row, feature, value = features(t)
    linear = np.bincount(row, model.weights[feature] * value, minlength=t.n) + model.intercept
    weak = np.array([model.posterior.get(p, 0.5) for p in pattern_of(votes(t)).tolist()], float)
    return weak, np.round(1 / (1 + np.exp(-np.clip(linear, -30, 30))), 9)


def score(docs: DataFrame, model: Model, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, weak_posterior, score, kept) of every document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text", SLICE):
                weak, chance = rate(part.column(1), model)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(weak), pa.array(chance)], names=["key", "weak_posterior", "score"])

    kind = docs.schema[key].dataType.simpleString()
    scored = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, weak_posterior double, score double")
    return scored.select(F.col("key").alias(key), "weak_posterior", "score", (F.col("score") >= KEEP).alias("kept"))


def classify(spark: SparkSession, docs: DataFrame, *, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> DataFrame:
    return score(docs, fit(spark, docs, text=text, sample=sample), key=key, text=text)


def keep_good(spark: SparkSession, docs: DataFrame, *, text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """The documents that the classifier keeps, with all their columns; no shuffle."""
    prepare(spark)
    model = fit(spark, docs, text=text, sample=sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, text, SLICE):
                yield part.filter(pa.array(rate(part.column(part.schema.get_field_index(text)), model)[1] >= KEEP))

    return docs.mapInArrow(run, docs.schema)
