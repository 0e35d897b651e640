"""Risk-controlled quality rules, in DataFrame functions only.

Each rule rejects documents whose ratio lies above a cutoff. Cutoffs are taken from fixed grids, per
stratum and rule, on labelled good documents that no rule was fitted to: a cutoff is admitted only
if so few of them are rejected that, by the exact binomial tail, a false-rejection rate above the
rule's share of the risk is ruled out at its share of the error probability. Within a rule the grid
is tested from the loosest cutoff on and stops at the first that fails (fixed-sequence testing),
over rules and strata the error is divided (Bonferroni). The strictest admitted cutoff is used;
where a stratum has too few labelled documents for any, its rule rejects nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.llm.sampling import labelled
from furrow.llm.text import SPACES, words
from furrow.session import cut

#: Fixed value: characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Rules: name -> (ratio, grid from the loosest cutoff to the strictest).
RULES: dict[str, tuple[str, tuple[float, ...]]] = {
    "symbols": ("n_symbols / n_words", (2.0, 1.5, 1.0, 0.75, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1)),
    "repeats": ("n_repeat_words / n_words", (0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15)),
    "dup_lines": ("n_dup_lines / n_words", (0.2, 0.15, 0.1, 0.08, 0.06, 0.05, 0.04)),
}
#: Strata whose cutoffs, a row each, go to every task.
BROADCAST_STRATA = 10_000


def _repeated(grams: Column) -> tuple[Column, Column]:
    """Words inside a 3-gram that occurs twice or more, given the 3-grams' hashes in order.

    Most texts repeat none, which one pass with a hash set tells. Else positions are sorted by hash,
    those with an equal neighbour are kept, and their spans of three are united by their order.
    """
    placed = F.array_sort(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    hit = F.filter(
        F.transform(
            F.sequence(F.lit(1), F.size("_placed")),
            lambda k: F.when(
                (F.coalesce(F.try_element_at("_placed", k + 1)["h"] == F.element_at("_placed", k)["h"], F.lit(False)))
                | ((k > 1) & F.coalesce(F.try_element_at("_placed", F.greatest(k - 1, F.lit(1)))["h"] == F.element_at("_placed", k)["h"], F.lit(False))),
                F.element_at("_placed", k)["i"],
            ),
        ),
        lambda i: i.isNotNull(),
    )
    return placed, F.array_sort(hit)


def features(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each whole text.

    Null texts have none of anything. 3-word windows are compared by a 64-bit hash of their words.
    Columns of the same names are replaced.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.translate(x, SPACES, "") != "")
    w = lambda k: F.element_at("_words", k)
    grams = F.when(
        F.size("_words") >= 3,
        F.transform(F.sequence(F.lit(1), F.size("_words") - 2), lambda k: F.xxhash64(w(k), w(k + 1), w(k + 2))),
    ).otherwise(F.array().cast("array<bigint>"))
    placed, hit = _repeated(F.col("_grams"))
    none = F.array().cast("array<int>")
    # A window at i adds min(3, i - the window before it) words.
    span = F.aggregate(
        "_hit",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")),
        lambda acc, i: F.struct((acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n"), i.alias("last")),
    )["n"]
    return (
        df.withColumns({
            "_words": words(F.col(text_col)),
            "word_chars": F.char_length(F.translate(text, SPACES, "")).cast("long"),
            "n_symbols": (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long"),
            "_lines": lines,
        })
        .withColumns({
            "n_words": F.size("_words").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_grams": grams,
        })
        .withColumn("_repeats", F.size(F.array_distinct("_grams")) < F.size("_grams"))
        .withColumn("_placed", F.when(F.col("_repeats"), placed))
        .withColumn("_hit", F.when(F.col("_repeats"), hit).otherwise(none))
        .withColumn("n_repeat_words", span)
        .drop("_words", "_lines", "_grams", "_repeats", "_placed", "_hit")
    )


def log_binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """log P(X <= k) for X ~ Binomial(n, p), summed term by term in logarithms; for k up to n * p."""
    odds = F.log(F.lit(p / (1 - p)))
    start = (n * F.log(F.lit(1 - p))).cast("double")
    step = lambda acc, j: acc["term"] + F.log((n - j + 1) / j) + odds
    add = lambda a, b: F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b)))
    return F.when(k <= 0, start).otherwise(
        F.aggregate(
            F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1)).cast("long")),
            F.struct(start.alias("term"), start.alias("total")),
            lambda acc, j: F.struct(step(acc, j).alias("term"), add(acc["total"], step(acc, j)).alias("total")),
            lambda acc: acc["total"],
        )
    )


def cutoffs(holdout: DataFrame, risk: float = 0.03, error: float = 0.05) -> DataFrame:
    """(stratum, rule, cutoff, n_good, n_rejected) admitted for a holdout of good documents.

    ``holdout`` has a row per labelled good document: stratum, n_words and the features. Each rule
    gets an equal part of ``risk``, each rule and stratum an equal part of ``error``.
    """
    alpha = risk / len(RULES)
    tests = F.array(*(
        F.struct(F.lit(name).alias("rule"), F.lit(i).alias("step"), F.lit(c).alias("cutoff"), (F.expr(f"try_divide({ratio.replace(' / ', ', ')})") > c).alias("out"))
        for name, (ratio, grid) in RULES.items() for i, c in enumerate(grid)
    ))
    counted = (
        holdout.select("stratum", F.explode(tests).alias("t"))
        .groupBy("stratum", "t.rule", "t.step", "t.cutoff")
        .agg(F.count("*").alias("n_good"), F.count_if("t.out").alias("n_rejected"))
    )
    strata = holdout.agg((F.count_distinct("stratum") + F.max(F.col("stratum").isNull().cast("int"))).alias("_strata"))
    passed = F.when(
        F.col("n_rejected") <= F.floor(F.col("n_good") * alpha),
        log_binomial_cdf(F.col("n_rejected"), F.col("n_good"), alpha) <= F.log(error / (len(RULES) * F.col("_strata"))),
    ).otherwise(F.lit(False))
    tested = counted.join(strata).withColumn("_ok", passed)
    failed = F.min(F.when(~F.col("_ok"), F.col("step")))
    rows = F.collect_list(F.struct("step", "cutoff", "n_good", "n_rejected", "_ok"))
    return (
        tested.groupBy("stratum", "rule").agg(failed.alias("_failed"), rows.alias("_rows"))
        .withColumn("_best", F.array_max(F.filter("_rows", lambda r: r["step"] < F.coalesce(F.col("_failed"), F.lit(1 << 30)))))
        .where(F.col("_best").isNotNull())
        .select("stratum", "rule", "_best.cutoff", "_best.n_good", "_best.n_rejected")
    )


def judge(
    df: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    stratum_col: str = "lang",
    risk: float = 0.03,
    error: float = 0.05,
) -> DataFrame:
    """Per row of ``df``: id, stratum, the features, base_failed, rejected_by (rule names) and kept.

    base_failed: fewer than 50 words, or more than half of them in repeated 3-word windows. Rows that
    pass are kept unless an admitted cutoff of their stratum rejects them. ``labels`` (id, quality)
    may hold nulls, which are no labels, and repeated ids, which count if their rows agree. The
    holdout is every labelled good row that passes the base rules. Null strata are a stratum of their
    own; null ids are judged but never labelled; repeated rows stay; an empty table gives no rows.
    """
    known = cut(features(df.select(F.col(id_col), F.col(stratum_col).alias("stratum"), F.col(text_col).alias("_text")), "_text").drop("_text"))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    known = known.withColumn("base_failed", base)
    good = labelled(labels, id_col, ["quality"]).where("quality = 1").select(F.col("_id").alias("_good"))
    holdout = known.where(~F.col("base_failed")).join(good, F.col(id_col) == F.col("_good"))
    chosen = cut(
        cutoffs(holdout, risk, error).groupBy(F.col("stratum").alias("_stratum"))
        .agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("_cutoffs"))
    )
    # A stratum has cutoffs only with some hundreds of good documents; more than so many strata are joined by a shuffle.
    few = chosen.count() <= BROADCAST_STRATA
    out = F.array_compact(F.array(*(
        F.when(F.expr(f"try_divide({ratio.replace(' / ', ', ')})") > F.col("_cutoffs")[name], F.lit(name)) for name, (ratio, _) in RULES.items()
    )))
    judged = known.join(F.broadcast(chosen) if few else chosen, F.col("stratum").eqNullSafe(F.col("_stratum")), "left")
    return (
        judged.withColumn("rejected_by", F.when(F.col("_cutoffs").isNull(), F.array().cast("array<string>")).otherwise(out))
        .withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0))
        .drop("_stratum", "_cutoffs")
    )
