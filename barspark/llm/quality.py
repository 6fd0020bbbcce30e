"""A quality classifier from positive and unlabelled texts.

Trusted positives are texts that labels mark as good; everything else is unlabelled.  The class prior of the
unlabelled texts is estimated first: a plain positive-against-unlabelled model ranks both, and the share of
unlabelled texts in a top set, over the share of positives there, is least where only good texts are left; that
least ratio is the prior.  Then a small network minimises the non-negative unbiased risk (Kiryo et al., 2017),
``prior * R_p(+1) + max(0, R_u(-1) - prior * R_p(-1))``, with the logistic loss, so that its output is a
probability; where the second term falls under zero, the step goes the other way.

The model is fitted on a bounded sample: ``sample_rows`` positives and as many unlabelled texts, taken by a hash
of the id; scoring covers every row.  Labels, language, source and id are no inputs.

Features are measures of the whole text: lengths, character classes, symbols, lines, repetition, entropy.

Rules: a null text is empty, and an empty text is scored like any other; a text of any length is measured whole;
without a positive, all scores are 0.5; ids with several rows, or repeated rows, are scored row by row; labels of
unknown ids are ignored, of contradicting labels of one id the lowest holds; a score at the threshold is good;
empty tables give empty tables; further columns are ignored (or, in ``keep_good``, kept), whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barspark.llm._spark import small_batches

SAMPLE_ROWS = 12_000
FOLDS = 5
THRESHOLD = 0.3
HIDDEN = 24
STEPS = 1500
SEED = 11
PIECE = 1 << 16

_CLASS = np.full(256, 4, np.int64)  # other symbols
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[97:123] = 1
_CLASS[128:] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
for _c in b".,;:?'\"()-":
    _CLASS[_c] = 5
_TAIL = bytes(b".,;:?!'\"()-")


def _compressed(text: bytes) -> int:
    """The compressed size of a text, in pieces that keep memory bounded."""
    packer = zlib.compressobj(1)
    return sum(len(packer.compress(text[k : k + PIECE])) for k in range(0, len(text), PIECE)) + len(packer.flush())


def features(text: bytes) -> list[float]:
    """Measures of one text; all finite, also of an empty one."""
    n = len(text)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256) if n else np.zeros(256, np.int64)
    kinds = np.bincount(_CLASS, weights=counts, minlength=6)
    p = counts[counts > 0] / max(n, 1)
    entropy = float(-(p * np.log2(p)).sum()) if n else 0.0
    symbols = counts[_CLASS == 4]
    words = text.split()
    m = max(len(words), 1)
    lower = [w.lower().strip(_TAIL) for w in words]
    seen = Counter(lower)
    pairs = Counter(zip(lower, lower[1:], strict=False))
    sizes = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    lines = [x.strip() for x in text.split(b"\n") if x.strip()]
    line_seen = Counter(lines)
    q = max(len(lines), 1)
    return [
        math.log1p(n),
        math.log1p(len(words)),
        math.log1p(len(lines)),
        *(kinds / max(n, 1)).tolist(),
        float(symbols.max()) / max(n, 1),
        math.log1p(float(counts[33])) / math.log1p(n + 1),
        entropy,
        float(sizes.mean()),
        float(sizes.std()),
        float((sizes <= 2).mean()),
        float((sizes >= 15).mean()),
        len(seen) / m,
        max(seen.values(), default=0) / m,
        sum(c for _, c in seen.most_common(10)) / m,
        sum(c - 1 for c in pairs.values()) / m,
        len(line_seen) / q,
        max(line_seen.values(), default=0) / q,
        n / q / 1000,
        sum(1 for w in words if not w[-1:].isalnum() and w[-1] < 128 and w[-1] not in _TAIL) / m,
        sum(1 for w in words if w.isupper()) / m,
        sum(1 for w in lower if not w) / m,
        _compressed(text) / n if n else 0.0,
    ]


N_FEATURES = len(features(b""))


def _matrix(texts: list[str | None]) -> np.ndarray:
    return np.array([features((t or "").encode()) for t in texts], np.float64).reshape(-1, N_FEATURES)


class Model:
    """A network of one hidden layer over standardised features."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: list[np.ndarray]):
        self.mean, self.scale, self.weights = mean, scale, weights

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.tanh(z @ w1 + b1) @ w2 + b2[0]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -40, 40)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def risk_slopes(gp: np.ndarray, gu: np.ndarray, prior: float | None) -> tuple[np.ndarray, np.ndarray]:
    """The direction of a step in the outputs of positive and unlabelled texts.

    It is the gradient of ``prior * R_p(+1) + (R_u(-1) - prior * R_p(-1))`` where the bracket is not negative; else
    that of the bracket alone, turned round.  With no prior, that of the plain loss.
    """
    up, down = _sigmoid(gp), _sigmoid(gu)  # slopes of log(1 + e^g), the loss of the answer -1
    if prior is None:
        return (up - 1) / len(gp), down / len(gu)
    if np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean() >= 0:
        return prior * (up - 1) / len(gp) - prior * up / len(gp), down / len(gu)
    return prior * up / len(gp), -down / len(gu)


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, steps: int = STEPS, seed: int = SEED) -> Model:
    """Minimise the non-negative risk; with no prior, the plain loss of positives against unlabelled."""
    rng = np.random.default_rng(seed)
    both = np.concatenate([positive, unlabelled])
    mean, scale = both.mean(0), both.std(0) + 1e-6
    weights = [rng.normal(0, 0.3, (positive.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.3, HIDDEN), np.zeros(1)]
    model = Model(mean, scale, weights)
    zp, zu = np.clip((positive - mean) / scale, -6, 6), np.clip((unlabelled - mean) / scale, -6, 6)
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for step in range(1, steps + 1):
        p = zp[rng.integers(0, len(zp), min(512, len(zp)))]
        u = zu[rng.integers(0, len(zu), min(1024, len(zu)))]
        x = np.concatenate([p, u])
        hidden = np.tanh(x @ weights[0] + weights[1])
        g = hidden @ weights[2] + weights[3][0]
        slope = np.concatenate(risk_slopes(g[: len(p)], g[len(p) :], prior))
        back = np.outer(slope, weights[2]) * (1 - hidden**2)
        grads = [x.T @ back + 1e-4 * weights[0], back.sum(0), hidden.T @ slope + 1e-4 * weights[2], np.array([slope.sum()])]
        rate = 0.01 * (1 - step / (steps + 1))
        for i, d in enumerate(grads):
            first[i] = 0.9 * first[i] + 0.1 * d
            second[i] = 0.999 * second[i] + 0.001 * d * d
            weights[i] -= rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return model


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of good texts among the unlabelled: the least ratio of the two groups' shares in a top set, over top sets with a third of the positives at least."""
    half_p, half_u = positive[::2], unlabelled[::2]
    model = fit(half_p, half_u, None, steps=600)
    rest_p, rest_u = positive[1::2], unlabelled[1::2]
    sp, su = np.sort(model.logits(rest_p if len(rest_p) else half_p)), np.sort(model.logits(rest_u if len(rest_u) else half_u))
    cuts = np.quantile(sp, np.linspace(0, 0.67, 40))
    above_p = 1 - np.searchsorted(sp, cuts, side="left") / len(sp)
    above_u = 1 - np.searchsorted(su, cuts, side="left") / len(su)
    return float(np.clip((above_u / above_p).min(), 0.02, 0.98))


def held_out(doc_id):
    """The fold that no label is learnt from."""
    return F.crc32(doc_id.cast("string")) % FOLDS == 0


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[Model | None, float]:
    """The model and the estimated prior, from samples of ``sample_rows`` rows at most of each kind."""
    small_batches(docs.sparkSession)
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("q")).filter((F.col("q") == 1) & ~held_out(F.col("doc_id"))).select("doc_id")
    n_good, n_docs = good.count(), docs.count()

    def sampled(rows: DataFrame, n: int, salt: int) -> DataFrame:
        if n <= sample_rows:
            return rows
        return rows.filter(F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(1_000_000)) < int(1_000_000 * sample_rows / n))

    def measured(rows: DataFrame) -> np.ndarray:
        def run(batches):
            for batch in batches:
                x = _matrix(batch.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "x"])

        found = rows.select("doc_id", "text").mapInArrow(run, "doc_id long, x array<double>").orderBy("doc_id", "x").limit(2 * sample_rows).toPandas()
        return np.stack(found["x"].to_numpy()) if len(found) else np.zeros((0, N_FEATURES))

    # the sampled ids are at most twice sample_rows rows of 8 bytes
    positive = measured(docs.join(F.broadcast(sampled(good, n_good, 1).limit(2 * sample_rows)), "doc_id"))
    unlabelled = measured(sampled(docs.filter(~held_out(F.col("doc_id"))), n_docs, 2))
    if not len(positive) or not len(unlabelled):
        return None, float("nan")
    prior = estimate_prior(positive, unlabelled)
    return fit(positive, unlabelled, prior), prior


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, score) of every row."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            x = _matrix(batch.column("text").to_pylist())
            s = model.scores(x) if model else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s, pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that score under the threshold."""
    model, _ = train(docs, labels)
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            x = _matrix(batch.column("text").to_pylist())
            s = model.scores(x) if model else np.full(len(x), 0.5)
            yield batch.filter(pa.array(s >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op1_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model, _ = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
