"""Quality classifier by positive-unlabelled learning.

A linear model on the shape of a text and on its words, hashed, minimises the non-negative unbiased
risk: trusted positives stand for the good class, unlabelled web text for the mixture, and the class
prior tells how much of the mixture's risk as negatives the good part accounts for. The prior is
estimated from the two samples alone: it is the least ratio of their shares above a score, of scores
that parts of the rows got from a model of the others. Where that difference falls
below zero, which overfitting alone can bring about, the step goes back along its gradient.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.llm.sampling import in_share, labelled, share_of

_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGIT = b"0123456789"
_SYMBOL = b"#*$%&|<>~^=+@\\/{}[]_"
_LOUD = b"!?"
_STOP = b".,;:"
_HIGH = bytes(range(128, 256))
_SPACE = b" \t\n\x0b\x0c\r"
_BAR = re.compile(rb"(?<!\S)[^\w\s]+(?!\S)")
#: Two or more of the same mark in a row.
_RUN = re.compile(rb"([^\w\s])\1")
#: Buckets of hashed words.
BUCKETS = 128

SHAPE = ("log words", "upper", "digits", "symbols", "loud", "stops", "high", "lone marks", "distinct words", "distinct pairs", "twins", "duplicate lines", "word length", "long words", "lines", "runs of marks", "upper words")
FEATURES = (*SHAPE, *(f"words {i}" for i in range(BUCKETS)))


def _hashed(words: list[bytes]) -> np.ndarray:
    """The words' shares of the buckets, as square roots."""
    known = Counter(words)
    at = np.fromiter((xxhash.xxh3_64_intdigest(w.lower()) % BUCKETS for w in known), dtype=np.int64, count=len(known))
    share = np.bincount(at, weights=np.fromiter(known.values(), dtype=np.float64, count=len(known)), minlength=BUCKETS) / len(words)
    return np.sqrt(share)


def shape(data: bytes) -> np.ndarray:
    """The features of a whole text, each of about 0 to 1; a text without words has zeros."""
    words = data.split()
    n = len(words)
    if not n:
        return np.zeros(len(FEATURES))
    size = len(data)
    body = data.translate(None, _SPACE)
    solid = len(body)
    part = lambda drop: (size - len(data.translate(None, drop))) / solid
    lines = [x for x in data.split(b"\n") if x.strip()]
    pairs = max(1, n - 1)
    upper = part(_UPPER)
    letters = upper + part(_LOWER)
    own = [
        min(1.0, np.log1p(n) / 10),
        upper / letters if letters else 0.0,
        part(_DIGIT),
        min(1.0, 4 * part(_SYMBOL)),
        min(1.0, 4 * part(_LOUD)),
        min(1.0, 5 * part(_STOP)),
        part(_HIGH),
        min(1.0, 4 * len(_BAR.findall(data)) / n),
        len(set(words)) / n,
        len(set(zip(words, words[1:], strict=False))) / pairs,
        sum(map(bytes.__eq__, words, words[1:])) / pairs,
        1 - len(set(lines)) / len(lines) if lines else 0.0,
        min(1.0, len(body) / n / 20),
        sum(len(w) > 20 for w in words) / n,
        min(1.0, len(lines) / n * 5),
        min(1.0, len(_RUN.findall(data)) / n),
        sum(map(bytes.isupper, words)) / n,
    ]
    return np.concatenate([own, _hashed(words)])


def _rows(texts: pa.Array) -> np.ndarray:
    return np.array([shape(t.as_py() or b"") for t in texts]).reshape(-1, len(FEATURES))


def _shapes(text: Column) -> Column:
    @F.arrow_udf("array<float>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            rows = _rows(texts).astype(np.float32)
            ends = np.arange(0, rows.size + 1, len(FEATURES), dtype=np.int32)
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(rows.ravel()))

    return of(text)


@dataclass
class Model:
    """Weights on standardised features, and the prior that they were fitted with."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(((rows - self.mean) / self.scale) @ self.weights + self.bias, -30, 30)))


def _standard(rows: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Rows in units of their spread, within eight of them, in the rows' own precision and one copy."""
    out = rows - mean.astype(rows.dtype)
    out /= scale.astype(rows.dtype)
    return np.clip(out, -8, 8, out=out)


def fit_nnpu(good: np.ndarray, mixed: np.ndarray, prior: float, steps: int = 600, rate: float = 0.03, decay: float = 1e-3) -> Model:
    """Non-negative PU risk with logistic loss, by Adam over all rows at each step."""
    mean = mixed.mean(axis=0, dtype=np.float64)
    scale = mixed.std(axis=0, dtype=np.float64) + 1e-3
    p, u = _standard(good, mean, scale), _standard(mixed, mean, scale)
    w, b = np.zeros(p.shape[1]), 0.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for t in range(1, steps + 1):
        own = w.astype(p.dtype)
        zp, zu = (p @ own).astype(np.float64) + b, (u @ own).astype(np.float64) + b
        # d/dz log(1 + e^-z) = -sigmoid(-z); d/dz log(1 + e^z) = sigmoid(z)
        as_good = -sigmoid(-zp) * prior / len(p)
        as_bad_p, as_bad_u = sigmoid(zp) * prior / len(p), sigmoid(zu) / len(u)
        rest = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        if rest >= 0:
            gp, gu = as_good - as_bad_p, as_bad_u
        else:
            gp, gu = as_bad_p, -as_bad_u
        grad = np.r_[p.T @ gp.astype(p.dtype) + u.T @ gu.astype(p.dtype) + decay * w, gp.sum() + gu.sum()]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return Model(mean, scale, w, float(b), prior)


def estimated_prior(good: np.ndarray, mixed: np.ndarray, parts: int = 2, error: float = 0.05) -> float:
    """The good share of the mixture, from the two samples without any negative.

    Every part of the rows is scored by a model of the others that parts good rows from the mixture's
    (a prior of one half, whose order is all that counts). Above any score the mixture holds at least
    its good share times the share of the good; the least such ratio, both shares taken at the unlucky
    end of their error, bounds the good share, tightly where the best rows are good ones only.
    """
    place = [np.arange(len(x)) % parts for x in (good, mixed)]
    scores = [np.zeros(len(good)), np.zeros(len(mixed))]
    for k in range(parts):
        model = fit_nnpu(good[place[0] != k], mixed[place[1] != k], 0.5, steps=200)
        for x, at, out in zip((good, mixed), place, scores, strict=True):
            z = _standard(x[at == k], model.mean, model.scale) @ model.weights.astype(x.dtype)
            out[at == k] = 1 / (1 + np.exp(-np.clip(z + model.bias, -30, 30)))
    cuts = np.quantile(scores[0], np.linspace(0, 0.9, 91))
    share = lambda x: 1 - np.searchsorted(np.sort(x), cuts, side="left") / len(x)
    slack = np.sqrt(np.log(4 / error) / 2) * (1 / np.sqrt(len(good)) + 1 / np.sqrt(len(mixed)))
    above, below = share(scores[1]), share(scores[0])
    best = int(np.argmin((above + slack) / below))
    return float(np.clip(above[best] / below[best], 0.01, 0.99))


def held_out(id_col: Column | str) -> Column:
    """Whether crc32 of the id's text is divisible by 5; null ids count as ''."""
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_good: int = 10_000, max_mixed: int = 20_000) -> Model | None:
    """A model from rows that are not held out: labelled good ones, and any as unlabelled text.

    At most about ``max_good`` and ``max_mixed`` rows are used, chosen by a hash of the id; their
    features, not their texts, come to the driver. Labels other than good ones are not read, the prior
    is that of ``estimated_prior``. Without positives or other rows there is no model.
    """
    known = labelled(labels.where(~held_out(id_col)), id_col, ["quality"])
    n_good = known.where("quality = 1").count()
    n_docs = df.count()
    if not n_good or not n_docs:
        return None
    good = known.where("quality = 1").where(in_share("_id", share_of(n_good, max_good), "good")).select("_id", F.lit(True).alias("_good"))
    rest = F.broadcast(good)  # at most about max_good ids
    rows = (
        df.select(F.col(id_col).alias("_key"), F.col(text_col).alias("_text")).where(~held_out("_key"))
        .join(rest, F.col("_key") == F.col("_id"), "left")
        .where(F.col("_good") | in_share("_key", share_of(n_docs, max_mixed), "mixed"))
        .select(F.coalesce("_good", F.lit(False)).alias("good"), in_share("_key", share_of(n_docs, max_mixed), "mixed").alias("mixed"), "_key", _shapes(F.col("_text").cast("binary")).alias("x"))
    )
    # Single precision, as the features come, keeps the driver's copies small.
    table = rows.toArrow().sort_by([("_key", "ascending")])  # the fit doesn't depend on the order of partitions
    is_good, is_mixed = (table[c].to_numpy() for c in ("good", "mixed"))
    if not is_good.any() or not is_mixed.any():
        return None
    x = table["x"].combine_chunks().flatten().to_numpy().reshape(-1, len(FEATURES))
    own, mixed = x[is_good], x[is_mixed]
    del x, table
    return fit_nnpu(own, mixed, estimated_prior(own, mixed))


def score(text: Column | str, model: Model | None) -> Column:
    """The probability, 0 to 1, that a whole text is good; null is an empty text; 0.5 without a model."""

    @F.arrow_udf("double")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            if model is None:
                yield pa.array([0.5] * len(texts), pa.float64())
            else:
                rows = _rows(texts).astype(np.float32).astype(np.float64)
                yield pa.array(model(np.clip(rows, model.mean - 8 * model.scale, model.mean + 8 * model.scale)), pa.float64())

    return of((F.col(text) if isinstance(text, str) else text).cast("binary"))


def classify(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """``df`` with held_out, score and predicted (1 if score >= ``threshold``).

    Labels, languages, sources and ids are never inputs of a score. Null and empty texts get the
    score of an empty text; null ids count as held out; repeated rows score alike; an empty table
    gives no rows. Columns of the three names are replaced.
    """
    model = train(df, labels, id_col, text_col)
    scored = df.withColumn("held_out", held_out(id_col)).withColumn("score", score(text_col, model))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
