"""Toxicity by a factorization machine over hashed terms.

Terms are words and the beginnings of longer words, hashed. Every labelled row counts toward the
association of each hashed term with the label; the `terms` strongest are the features. The machine
score = w0 + sum w_i + sum over pairs <v_i, v_j> is fitted on a bounded sample of labelled rows, so
pairs that mean more together than apart (an insult and a group) get a weight of their own. The
model has terms * (1 + factors) numbers, whatever the input, and is broadcast to score every text.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import small
from .words import ALNUM, Words, words

BITS = 20
#: Lengths in bytes of the word beginnings that are terms too.
BEGINNINGS = (4, 5, 6, 7)
TERMS = 4096
FACTORS = 4
#: Labelled rows the machine is fitted on, at most about; those whose id's hash lies below a bound.
SAMPLE = 30_000
#: Terms that a task counts before it hands on what it has.
MERGE = 1 << 19


class Model(NamedTuple):
    terms: np.ndarray  # the features' hashed terms
    bias: float
    linear: np.ndarray
    factors: np.ndarray


def row_terms(w: Words, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hashed term) of all words and beginnings, with repeats."""
    row = np.repeat(np.arange(rows), np.diff(w.first))
    terms, of = [w.hash], [row]
    for n in BEGINNINGS:
        long = np.flatnonzero(w.end - w.start > n)
        terms.append(w.piece(w.start[long], w.start[long] + n) ^ np.uint64(n))
        of.append(row[long])
    return np.concatenate(of), (np.concatenate(terms) & np.uint64((1 << BITS) - 1)).astype(np.int64)


def _distinct(row: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique((row << BITS) | term)
    return both >> BITS, both & ((1 << BITS) - 1)


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, n0, n1): texts of either label that have the term; a partial sum for each MERGE terms or so."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def merged() -> tuple[np.ndarray, np.ndarray]:
        keys, counts = (np.concatenate(c) for c in zip(*held))
        keys, at = np.unique(keys, return_inverse=True)
        return keys, np.bincount(at, counts).astype(np.int64)

    def out(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        label = keys & 1
        return pa.RecordBatch.from_arrays([pa.array(keys >> 1), pa.array(counts * (1 - label)), pa.array(counts * label)], names=["term", "n0", "n1"])

    for batch in batches:
        label = batch.column(1).to_numpy().astype(np.int64)
        for i, j, w in words(batch.column(0), ALNUM):
            row, term = _distinct(*row_terms(w, j - i))
            held.append(np.unique(term << 1 | label[i + row], return_counts=True))
            if sum(len(k) for k, _ in held) > MERGE:
                held = [merged()]
                if len(held[0][0]) > MERGE // 2:
                    yield out(*held.pop())
    if held:
        yield out(*merged())


def slots(terms: np.ndarray) -> np.ndarray:
    """Hashed term -> feature, or -1."""
    slot = np.full(1 << BITS, -1, dtype=np.int32)
    slot[terms] = np.arange(len(terms))
    return slot


def _known(slot: np.ndarray, w: Words, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of the features that occur, each once a row."""
    row, term = row_terms(w, rows)
    feature = slot[term]
    on = feature >= 0
    return _distinct(row[on], feature[on].astype(np.int64))


def _featured(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot = slots(shared.value)
        for batch in batches:
            features: list = []
            for i, j, w in words(batch.column(0), ALNUM):
                row, feature = _known(slot, w, j - i)
                features += np.split(feature.astype(np.int32), np.searchsorted(row, np.arange(1, j - i)))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(features, pa.list_(pa.int32()))], names=["label", "h", "features"])

    return run


def fit_machine(rows: list[np.ndarray], labels: np.ndarray, terms: int, factors: int = FACTORS, epochs: int = 12, rate: float = 0.1, decay: float = 1e-5, seed: int = 7) -> tuple[float, np.ndarray, np.ndarray]:
    """Logistic factorization machine on binary features, by AdaGrad over shuffled mini-batches."""
    rng = np.random.default_rng(seed)
    bias, w, v = 0.0, np.zeros(terms), rng.normal(0, 0.01, (terms, factors))
    gb, gw, gv = 1e-8, np.full(terms, 1e-8), np.full((terms, factors), 1e-8)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for k in range(0, len(order), 256):
            batch = order[k : k + 256]
            at = np.concatenate([rows[b] for b in batch]).astype(np.int64)
            row = np.repeat(np.arange(len(batch)), [len(rows[b]) for b in batch])
            score, sums = machine_scores(row, at, len(batch), bias, w, v)
            miss = 1 / (1 + np.exp(-score)) - labels[batch]
            bias_step = miss.sum()
            gb += bias_step**2
            bias -= rate * bias_step / np.sqrt(gb)
            if not len(at):
                continue
            step = np.bincount(at, miss[row], minlength=terms)
            used = np.unique(at)
            g = step[used] + decay * len(batch) * w[used]
            gw[used] += g**2
            w[used] -= rate * g / np.sqrt(gw[used])
            pull = miss[row][:, None] * (sums[row] - v[at])
            for f in range(factors):
                g = np.bincount(at, pull[:, f], minlength=terms)[used] + decay * len(batch) * v[used, f]
                gv[used, f] += g**2
                v[used, f] -= 0.3 * rate * g / np.sqrt(gv[used, f])
    return bias, w, v


def machine_scores(row: np.ndarray, at: np.ndarray, n: int, bias: float, w: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(scores, factor sums) of n rows with features at[row == r]."""
    score = bias + np.bincount(row, w[at], minlength=n)
    sums = np.stack([np.bincount(row, v[at, f], minlength=n) for f in range(v.shape[1])], axis=1)
    squares = np.bincount(row, (v[at] ** 2).sum(axis=1), minlength=n)
    return np.clip(score + 0.5 * ((sums**2).sum(axis=1) - squares), -30, 30), sums


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", held_out: int = 5, terms: int = TERMS, sample: int = SAMPLE) -> Model:
    """Learns from labelled rows whose crc32(id as text) mod held_out isn't 0.

    Term counts go over all of them; the machine is fitted on about `sample` of them at most, those
    with a hash of the id below a bound set by their number. Rows without id or label teach nothing; of
    an id's labels the largest counts, and repeated rows of an id teach as often. With no labelled rows
    of one of the classes nothing tells toxic texts: the model gives every text the same low score.
    """
    spark = docs.sparkSession
    usable = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (F.crc32(F.col(id_col).cast("string").cast("binary")) % held_out != 0))
    wanted = usable.groupBy(F.col(id_col).alias("id_")).agg(F.max((F.col(label_col) > 0).cast("int")).alias("label"))
    taught = docs.select(F.col(id_col).alias("id_"), F.col(text_col).alias("text")).join(small(wanted), "id_").select("text", "label", F.xxhash64("id_").alias("h"))
    counts = taught.select("text", "label").mapInArrow(_term_counts, "term long, n0 long, n1 long").groupBy("term").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    (n0, n1) = (float(x or 0) for x in wanted.agg(F.sum(1 - F.col("label")), F.sum("label")).first())
    if not n0 or not n1:
        return Model(np.zeros(0, dtype=np.int64), min(-1.0, float(np.log(0.5 / (n0 + 0.5)))), np.zeros(1), np.zeros((1, FACTORS)))
    # signed chi-square, continuity-corrected, of presence against label
    n, seen = n0 + n1, F.col("n0") + F.col("n1")
    cross = F.col("n1") * n0 - F.col("n0") * n1
    chi = F.pow(F.greatest(F.abs(cross) - n / 2, F.lit(0.0)), 2) * n / (F.lit(n0 * n1) * seen * F.greatest(F.lit(n) - seen, F.lit(1.0)))
    told = counts.where(seen >= 5).withColumn("chi", chi).where("chi > 10").select("chi", "term").coalesce(8)  # 2 ** BITS rows at most
    chosen = np.array([r[0] for r in told.orderBy(F.desc("chi"), "term").limit(terms).select("term").collect()], dtype=np.int64)
    share = min(1.0, (sample - 4 * sample**0.5) / n) if n > sample else 1.0
    some = taught if share == 1 else taught.where(F.pmod("h", F.lit(1 << 32)) < int(share * (1 << 32)))
    shared = spark.sparkContext.broadcast(chosen)
    rows = some.mapInArrow(_featured(shared), "label int, h long, features array<int>").toArrow().sort_by([("h", "ascending"), ("label", "ascending")])
    shared.destroy()
    features = [x.values.to_numpy().astype(np.int64) for x in rows.column("features").combine_chunks()] if rows.num_rows else []
    return Model(chosen, *fit_machine(features, rows.column("label").to_numpy().astype(float), max(1, len(chosen))))


def _scorer(shared):
    @F.arrow_udf("double")
    def scores(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model: Model = shared.value
        slot = slots(model.terms)
        for text in texts:
            found = np.zeros(len(text))
            for i, j, w in words(text, ALNUM):
                row, feature = _known(slot, w, j - i)
                found[i:j] = machine_scores(row, feature, j - i, model.bias, model.linear, model.factors)[0]
            yield pa.array(1 / (1 + np.exp(-found)))

    return scores


def score(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5, keep: tuple[str, ...] | None = None) -> DataFrame:
    """The columns `keep` of docs (all, if None) with score (0..1) and predicted (1 if score >= threshold, else 0).

    Only the text is looked at, and only it goes to Python. A null or empty text scores as one without
    terms. Equally named columns of docs are replaced; repeated rows get equal scores.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c not in ("score", "predicted")]
    scores = _scorer(docs.sparkSession.sparkContext.broadcast(model))
    scored = docs.select(*[F.col(f"`{c}`") for c in kept], scores(F.col(text_col).cast("string")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def held_out(id_col: str = "doc_id", n: int = 5):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n == 0
