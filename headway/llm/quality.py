"""Quality rules whose cutoffs come from labelled holdouts with a guaranteed error limit.

A rule rejects a document when a measured ratio exceeds the rule's cutoff. For each
stratum (here the language) and rule a fixed grid of cutoffs is tested from the most
lenient to the strictest. A cutoff passes when the exact binomial test rejects "this
cutoff falsely rejects more than ``share`` of the good documents of the stratum", that is
when P(X <= k | n, share) <= level for k rejected of n labelled good documents. Testing
stops at the first failure, so the grid needs no correction of its own (fixed sequence
testing); over rules and strata the level is divided (Bonferroni), and the allowed false
rejection is split evenly over the rules (union bound). With probability 1 - ``error`` no
stratum then loses more than ``limit`` of its good documents.

Among the cutoffs that pass, the one with most labelled bad documents less labelled good
documents rejected is used; a rule that gains nothing stays off. A stratum with too few
labels to prove anything gets no cutoff, so it keeps its documents.

Defined cases: a null or empty text has no words, fails the base rule and is rejected; a
null stratum is a stratum of its own; null labels and ids without a label are not used;
several labels for one id count as good only if all are good; empty tables give no
cutoffs; other columns are passed through untouched.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame, Window, functions as F

from headway.llm.common import SPACES, split_words
from headway.session import materialize

#: Rule name -> (numerator, denominator, grid of cutoffs, strictest last).
GRID = (0.9, 0.7, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.05)
RULES = {
    "symbols_per_word": ("n_symbols", "n_words", tuple(4 * g for g in GRID)),
    "duplicate_lines": ("n_dup_lines", "n_lines", GRID),
    "repeated_words": ("n_repeat_words", "n_words", GRID),
    "shouted_words": ("n_shouts", "n_words", GRID),
}


@dataclass(frozen=True)
class RiskParams:
    """``limit``: share of good documents that may be lost per stratum; ``error``: chance of exceeding it."""

    limit: float = 0.05
    error: float = 0.05
    min_words: int = 50
    max_repeat_percent: int = 50


def base_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_shouts.

    All are built-in array and string functions on the document's own row: no shuffle.
    Repeated 3-word windows are found by sorting (window, position) pairs, so a very long
    text costs n log n; texts whose windows are all distinct skip the sort.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    d = docs.withColumns({"_w": split_words(F.col(text)),
                          "_l": F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    # Words hold no space, so joining by one names a window exactly.
    d = d.withColumn("_g", F.when(F.size("_w") >= 3, F.slice(
        F.transform("_w", lambda w, i: F.concat(w, F.lit(" "), F.get("_w", i + 1), F.lit(" "), F.get("_w", i + 2))),
        F.lit(1), F.greatest(F.size("_w") - 2, F.lit(0)))).otherwise(F.array().cast("array<string>")))
    d = d.withColumn("_s", F.when(
        F.size(F.array_distinct("_g")) < F.size("_g"),
        F.sort_array(F.transform("_g", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))))
    # Start positions of windows equal to a neighbour in sorted order, ascending.
    again = F.sort_array(F.transform(F.filter(F.transform("_s", lambda s, j: F.struct(
        s["i"].alias("i"),
        ((j > 0) & (F.get("_s", j - 1)["g"].eqNullSafe(s["g"]))
         | F.get("_s", j + 1)["g"].eqNullSafe(s["g"])).alias("hit"))), lambda x: x["hit"]), lambda x: x["i"]))
    d = d.withColumn("_p", again)
    covered = F.size("_p") * 3 - F.aggregate(
        F.transform("_p", lambda p, j: F.greatest(F.lit(0), F.lit(3) - (F.coalesce(F.get("_p", j + 1), p + 3) - p))),
        F.lit(0), lambda a, x: a + x)
    return d.withColumns({
        "n_words": F.size("_w").cast("long"),
        "word_chars": F.length(F.regexp_replace(t, SPACES, "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long"),
        "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
        "n_repeat_words": F.when(F.col("_s").isNull(), F.lit(0)).otherwise(covered).cast("long"),
        "n_lines": F.size("_l").cast("long"),
        "n_shouts": F.length(F.regexp_replace(t, r"[^!]+", "")).cast("long"),
    }).drop("_w", "_l", "_g", "_s", "_p")


def base_failed(p: RiskParams) -> Column:
    return (F.col("n_words") < p.min_words) | (100 * F.col("n_repeat_words") > p.max_repeat_percent * F.col("n_words"))


def ratio(rule: str) -> Column:
    """The measured ratio of a rule; 0 where the denominator is 0."""
    num, den, _ = RULES[rule]
    return F.when(F.col(den) > 0, F.col(num) / F.col(den)).otherwise(F.lit(0.0))


def log_binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """ln P(X <= k) for X ~ Binomial(n, p), summed term by term in log space.

    Terms follow from t(i) = t(i-1) * (n-i+1)/i * p/(1-p). Above the mean the sum is not
    needed by the test (it is at least about one half), so 0 is returned there.
    """
    first = n * F.log1p(F.lit(-p))
    odds = F.log(F.lit(p / (1 - p)))
    step = F.aggregate(
        F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>")),
        F.struct(first.alias("t"), first.alias("s")),
        lambda a, i: F.struct(
            (a["t"] + F.log((n - i + 1) / i) + odds).alias("t"),
            (F.greatest(a["s"], a["t"] + F.log((n - i + 1) / i) + odds)
             + F.log1p(F.exp(-F.abs(a["s"] - (a["t"] + F.log((n - i + 1) / i) + odds))))).alias("s")),
        lambda a: a["s"])
    return F.when(k <= n * p, step).otherwise(F.lit(0.0))


def rejections(labelled: DataFrame, stratum: str) -> DataFrame:
    """Labelled documents beyond each cutoff: (stratum, rule, step, cutoff, n_good, k_good, k_bad).

    One aggregation with map-side sums: a hot stratum sends a row per task.
    """
    good, bad = F.col("_good"), ~F.col("_good")
    sums, rows = [F.count_if(good).alias("n_good"), F.count_if(bad).alias("n_bad")], []
    for r, (_, _, grid) in RULES.items():
        for j, c in enumerate(grid):
            over = F.col(f"_r_{r}") > F.lit(float(c))
            sums += [F.count_if(over & good).alias(f"g_{r}_{j}"), F.count_if(over & bad).alias(f"b_{r}_{j}")]
            rows.append(F.struct(F.lit(r).alias("rule"), F.lit(j).alias("step"), F.lit(float(c)).alias("cutoff"),
                                 F.col(f"g_{r}_{j}").alias("k_good"), F.col(f"b_{r}_{j}").alias("k_bad")))
    wide = labelled.withColumns({f"_r_{r}": ratio(r) for r in RULES}).groupBy(F.col(stratum).alias("stratum")).agg(*sums)
    return wide.select("stratum", "n_good", "n_bad", F.explode(F.array(*rows)).alias("c")).select(
        "stratum", "n_good", "n_bad", "c.*")


def choose_cutoffs(counts: DataFrame, p: RiskParams) -> DataFrame:
    """Tested grid with ``passes`` and ``chosen``; a stratum's grid is one small group."""
    share = p.limit / len(RULES)
    counts = materialize(counts, "grid")
    level = p.error / (len(RULES) * max(1, counts.select("stratum").distinct().count()))
    order = Window.partitionBy("stratum", "rule").orderBy("step")
    t = counts.withColumn("log_p", log_binomial_cdf(F.col("k_good"), F.col("n_good"), share))
    t = t.withColumn("test", (F.col("n_good") > 0) & (F.col("log_p") <= F.lit(log(level))))
    t = t.withColumn("passes", F.min(F.col("test")).over(order))
    gain = F.when(F.col("passes") & (F.col("k_bad") > F.col("k_good")), F.col("k_bad") - F.col("k_good"))
    best = Window.partitionBy("stratum", "rule").orderBy(F.col("gain").desc_nulls_last(), "step")
    return t.withColumn("gain", gain).withColumn(
        "chosen", F.col("gain").isNotNull() & (F.row_number().over(best) == 1)).drop("test")


def label_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents with a quality label as ``_good``; repeated labels of an id are merged first."""
    l = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(
        (F.min("quality") == 1).alias("_good"))
    return docs.join(l, "doc_id")


def quality_verdicts(docs: DataFrame, labels: DataFrame, stratum: str = "lang", text: str = "text",
                     params: RiskParams = RiskParams()) -> DataFrame:
    """Every row of ``docs`` with its features, ``base_failed`` and ``kept``.

    ``docs`` needs doc_id, the text and the stratum column. Features are computed once and
    written to the shared folder with all columns of ``docs`` but the text; the labelled
    holdout is all labelled documents that pass the base rule.
    """
    keep = [c for c in docs.columns if c != text]
    feats = materialize(base_features(docs, text).withColumn("base_failed", base_failed(params))
                        .select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                "n_lines", "n_shouts", "base_failed"), "quality")
    holdout = label_quality(feats.where(~F.col("base_failed")), labels)
    cuts = materialize(choose_cutoffs(rejections(holdout, stratum), params).where("chosen"), "cutoffs")
    by_rule = cuts.groupBy("stratum").agg(*[
        F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"_c_{r}") for r in RULES])
    j = feats.join(by_rule, F.col(stratum).eqNullSafe(by_rule["stratum"]), "left")
    over = F.lit(False)
    for r in RULES:
        over = over | F.coalesce(ratio(r) > F.col(f"_c_{r}"), F.lit(False))
    return j.withColumn("kept", ~F.col("base_failed") & ~over).drop("stratum", *[f"_c_{r}" for r in RULES])
