"""Toxicity by classifier chains.

The categories are predicted one after the other by linear models on the words of a text; each later
model also sees the probabilities of the earlier categories. For training these are out-of-fold
predictions, so that a later model meets them as uncertain as they will be on new texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from furrow.llm.sampling import in_share, labelled, share_of
from furrow.session import cut

_WORD = re.compile(r"[^\W\d_]+")
#: Lengths of the word beginnings that count as features beside the words; compounds share them.
STEMS = (3, 4, 5, 6)


def marks(text: str) -> set[str]:
    """Lower-cased words of a whole text, and the beginnings of the longer ones."""
    own = set(_WORD.findall(text.lower()))
    return own.union(*([w[:n] + "-" for w in own if len(w) > n] for n in STEMS))


def _marks(text: Column | str) -> Column:
    @F.arrow_udf("array<string>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([sorted(marks(t)) if t else [] for t in texts.to_pylist()], pa.list_(pa.string()))

    return of(text)


@dataclass
class Chain:
    """Vocabulary and, per category in order, weights for its marks and the earlier probabilities."""

    categories: list[str]
    vocabulary: dict[str, int]
    weights: list[np.ndarray]

    def __call__(self, hits: list[int]) -> list[float]:
        """The probability of each category for the marks that a text has."""
        known: list[float] = []
        size = len(self.vocabulary)
        for w in self.weights:
            z = w[-1] + w[hits].sum() + float(np.dot(w[size : size + len(known)], known))
            known.append(float(1 / (1 + np.exp(-np.clip(z, -30, 30)))))
        return known


def fit_logistic(hits: list[np.ndarray], more: np.ndarray, y: np.ndarray, size: int, steps: int = 200, rate: float = 0.05, decay: float = 2e-3) -> np.ndarray:
    """Weights (marks, further columns, bias) of a logistic model with L2 decay, by Adam."""
    length = np.array([len(h) for h in hits])
    flat = np.concatenate([*hits, np.zeros(0, dtype=np.int64)]).astype(np.int64)
    owner = np.repeat(np.arange(len(hits)), length)
    w = np.zeros(size + more.shape[1] + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    rate_up = np.where(y == 1, len(y) / max(1, 2 * y.sum()), len(y) / max(1, 2 * (len(y) - y.sum())))
    rate_up = np.sqrt(rate_up)  # halfway to balanced classes
    for t in range(1, steps + 1):
        z = np.bincount(owner, weights=w[flat], minlength=len(hits)) + more @ w[size:-1] + w[-1]
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * rate_up / len(y)
        grad = np.concatenate([np.bincount(flat, weights=g[owner], minlength=size), more.T @ g, [g.sum()]])
        grad[:-1] += decay / 10 * w[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return w


def _linear(w: np.ndarray, hits: list[np.ndarray], more: np.ndarray, size: int) -> np.ndarray:
    z = np.array([w[h].sum() for h in hits]) + more @ w[size:-1] + w[-1]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_chain(
    categories: list[str], vocabulary: dict[str, int], all_hits: list[np.ndarray], y: np.ndarray,
    own: np.ndarray | None = None, fold: np.ndarray | None = None, own_without: np.ndarray | None = None, folds: int = 5,
) -> Chain:
    """One model per category; the earlier probabilities that a later one learns from are out of fold.

    ``own`` (category, mark) tells which marks a category's model uses; the others get no weight.
    ``fold`` gives each row's fold, ``own_without`` (fold, category, mark) the marks that the other
    folds' rows alone would choose, for the models that predict that fold.
    """
    size, n = len(vocabulary), len(all_hits)
    fold = np.arange(n) % folds if fold is None else fold
    chosen = lambda masks: all_hits if masks is None else [h[masks[h]] for h in all_hits]
    earlier = np.zeros((n, 0))
    weights = []
    for j in range(len(categories)):
        weights.append(fit_logistic(chosen(None if own is None else own[j]), earlier, y[:, j], size))
        if j + 1 < len(categories):
            out = np.zeros(n)
            for k in range(folds):
                hits = chosen(own_without[k][j] if own_without is not None else None if own is None else own[j])
                inside, outside = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
                w = fit_logistic([hits[i] for i in inside], earlier[inside], y[inside, j], size)
                out[outside] = _linear(w, [hits[i] for i in outside], earlier[outside], size)
            earlier = np.column_stack([earlier, out])
    return Chain(categories, vocabulary, weights)


def _narrowed(chain: Chain, used: np.ndarray) -> Chain:
    """The chain without the marks that no final model uses."""
    kept = np.flatnonzero(used)
    names = sorted(chain.vocabulary, key=chain.vocabulary.get)
    size = len(names)
    return Chain(chain.categories, {names[i]: k for k, i in enumerate(kept)}, [np.r_[w[kept], w[size:]] for w in chain.weights])


def train(df: DataFrame, labels: DataFrame, categories: list[str], id_col: str = "doc_id", text_col: str = "text", max_rows: int = 8000, max_marks: int = 4000, folds: int = 5) -> Chain | None:
    """A chain from at most about ``max_rows`` labelled rows, chosen by a hash of the id.

    The marks of a category are those that part it best by chi-square over the sampled rows, counted in
    Spark; the driver gets them and, per row, which of them occur. For out-of-fold predictions they are
    chosen anew without the fold. Folds go by a hash of the text, and rows that repeat an id share
    theirs: neither copies nor repeated ids stand on both sides. Without labelled rows there is no chain.
    """
    known = labelled(labels, id_col, categories)
    share = share_of(known.count(), max_rows)
    rows = df.select(F.col(id_col).alias("_key"), F.col(text_col).alias("_text")).where(in_share("_key", share, "toxic"))
    # The sample's texts, a bounded table, are kept: the steps below read them and not the corpus again.
    rows = cut(rows.join(known, F.col("_key") == F.col("_id")).select("_key", "_text", *categories), max_rows)
    rows = rows.withColumn("_fold", F.pmod(F.min(F.xxhash64("_text")).over(Window.partitionBy("_key")), F.lit(folds)).cast("int"))
    rows = rows.select("_key", "_fold", _marks(F.col("_text")).alias("marks"), *categories)
    # Totals and counts per mark: rows and positives of every category, each over all folds and without each.
    inside = [F.lit(True), *(F.col("_fold") != k for k in range(folds))]
    counts = [c for v, i in enumerate(inside) for c in (F.count_if(i).alias(f"n{v}"), *(F.sum(F.when(i, F.col(x)).otherwise(0)).alias(f"{x}{v}") for x in categories))]
    total = rows.agg(*counts).first()
    if not total["n0"]:
        return None
    seen = rows.select("_fold", F.explode("marks").alias("mark"), *categories).groupBy("mark").agg(*counts).where("n0 >= 5")

    def chi(c: str, v: int) -> Column:
        a, n, one, every = F.col(f"{c}{v}").cast("double"), F.col(f"n{v}").cast("double"), int(total[f"{c}{v}"] or 0), int(total[f"n{v}"])
        gap = a * every - n * one
        return F.try_divide(gap * gap * every, n * one * (every - n) * (every - one))

    seen = cut(seen)
    most = max_marks // len(categories)
    best = lambda c, v: {r["mark"] for r in seen.select("mark", chi(c, v).alias("_chi")).orderBy(F.col("_chi").desc_nulls_last(), "mark").limit(most).collect()}
    taken = [best(c, 0) for c in categories]
    without = [[best(c, v) for c in categories[:-1]] for v in range(1, folds + 1)]
    vocabulary = {m: i for i, m in enumerate(sorted(set().union(*taken, *(m for per in without for m in per))))}
    mask = lambda sets: np.array([[m in x for m in vocabulary] for x in sets], dtype=bool).reshape(len(sets), len(vocabulary))
    own = mask(taken)
    table = rows.select("_key", "_fold", _hits(F.col("marks"), vocabulary).alias("hits"), *categories).orderBy("_key", "_fold", "hits").toArrow()
    hits = [np.array(h, dtype=np.int64) for h in table["hits"].to_pylist()]
    y = np.column_stack([np.array(table[c].to_pylist(), dtype=np.float64) for c in categories])
    chain = fit_chain(categories, vocabulary, hits, y, own, table["_fold"].to_numpy(), [mask(per) for per in without], folds)
    return _narrowed(chain, own.any(axis=0))


def _hits(found: Column, vocabulary: dict[str, int]) -> Column:
    @F.arrow_udf("array<int>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for rows in batches:
            yield pa.array([[vocabulary[m] for m in row or () if m in vocabulary] for row in rows.to_pylist()], pa.list_(pa.int32()))

    return of(found)


def probabilities(text: Column | str, chain: Chain) -> Column:
    """array<double> of the categories' probabilities for a whole text; null is an empty text."""

    @F.arrow_udf("array<double>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = set(chain.vocabulary)
        for texts in batches:
            yield pa.array([chain([chain.vocabulary[m] for m in sorted(known & marks(t or ""))]) for t in texts.to_pylist()], pa.list_(pa.float64()))

    return of(F.col(text) if isinstance(text, str) else text)


def classify(df: DataFrame, labels: DataFrame, categories: list[str], id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``df`` with p_<category> and is_<category> for each category of the chain.

    Null and empty texts are judged as texts without words; repeated rows alike; null ids are never
    training rows; without any labelled row all probabilities are null and all verdicts false; an
    empty table gives no rows. Columns of the new names are replaced.
    """
    chain = train(df, labels, categories, id_col, text_col)
    if chain is None:
        none = {f"p_{c}": F.lit(None).cast("double") for c in categories} | {f"is_{c}": F.lit(False) for c in categories}
        return df.withColumns(none)
    scored = df.withColumn("_chain", probabilities(text_col, chain))
    for i, c in enumerate(categories):
        scored = scored.withColumn(f"p_{c}", F.col("_chain")[i]).withColumn(f"is_{c}", F.col("_chain")[i] >= threshold)
    return scored.drop("_chain")
