"""Quality classifier as a sparse rule ensemble (operator 6).

1. Statistics of the whole text (``statistics``) are Spark expressions.
2. A bounded sample of labelled rows (``sample_rows`` ids, chosen by a hash of
   doc_id, never by order, and one row of each) goes to the driver as numbers,
   not texts.
3. Small boosted trees are grown on it in numpy; every path from a root to a
   node is a rule, a conjunction of bounds on statistics.
4. A logistic regression with an L1 penalty weighs the rules; most weights
   become zero.
5. The rules left are compiled into one Spark column expression, so scoring is
   a projection of the scan: no Python, no shuffle.

Labels, lang, source and doc_id are no inputs of a score.  Rows whose
crc32(doc_id as text) mod 3 is 1 are held out of fitting.

Defined cases: null and empty texts have statistics 0 and get the score that
the rules give those; labels that are null or neither 0 nor 1 and labels of
null ids are ignored, of contradicting labels the larger counts; with no usable
labels, or one class only, every row gets the smoothed share of 1 among them
(0.5 without any), so nothing is rejected for want of labels.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, whole_row
from .mixing import WORD

SAMPLE_ROWS, TREES, DEPTH, CUTS, PENALTY, SEED = 20_000, 40, 3, 32, 1e-3, 7


def statistics(text: Column) -> dict[str, Column]:
    """Name to expression; ``words`` and ``lines`` are arrays used by ``with_statistics``."""
    t = F.coalesce(text, F.lit(""))
    chars = F.greatest(F.char_length(t), F.lit(1)).cast("double")
    words, lines = F.col("_words"), F.col("_lines")
    n = F.greatest(F.size(words), F.lit(1)).cast("double")
    single = lambda c: (F.char_length(t) - F.char_length(F.replace(t, F.lit(c), F.lit("")))).cast("double")
    of_class = lambda p: F.regexp_count(t, F.lit(p)).cast("double")
    again = F.aggregate(
        words, F.struct(F.lit("").alias("last"), F.lit(0).alias("n")),
        lambda s, w: F.struct(w.alias("last"), (s["n"] + (s["last"] == w).cast("int")).alias("n")),
    )["n"]
    return {
        "words": F.log1p(F.size(words).cast("double")),
        "word_chars": chars / n,
        "distinct_words": F.size(F.array_distinct(words)) / n,
        "same_as_last": again / n,
        "same_lines": 1 - F.size(F.array_distinct(lines)) / F.greatest(F.size(lines), F.lit(1)).cast("double"),
        "line_words": n / F.greatest(F.size(lines), F.lit(1)).cast("double"),
        "marks": of_class(r"[%&#$*@^~<>{}=_\\\[\]]") / chars,
        "capitals": of_class(r"\p{Lu}") / chars,
        "digits": of_class("[0-9]") / chars,
        "bars": single("|") / n,
        "shouts": single("!") / n,
        "stops": single(".") / n,
        "commas": single(",") / n,
    }


NAMES = ("words", "word_chars", "distinct_words", "same_as_last", "same_lines", "line_words", "marks", "capitals", "digits", "bars", "shouts", "stops", "commas")


def with_statistics(docs: DataFrame) -> DataFrame:
    """``doc`` (the row as a struct) and the statistics of its text as ``stats``."""
    t = F.coalesce(docs["text"], F.lit(""))
    rows = docs.select(whole_row(docs).alias("doc"), F.regexp_extract_all(t, F.lit(WORD), F.lit(0)).alias("_words"), F.split(t, "\n", -1).alias("_lines"))
    return rows.select("doc", F.struct(*(c.alias(k) for k, c in statistics(F.col("doc.text")).items())).alias("stats"))


def labelled(docs: DataFrame, labels: DataFrame, target: str, sample_rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of at most ``sample_rows`` rows that are not held out, one for each doc_id.

    Of rows that repeat a doc_id the one whose text has the smallest hash counts; it is found where rows are read.
    """
    usable = labels.where(F.col(target).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    few = usable.groupBy("doc_id").agg(F.max(target).cast("double").alias("y")).orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id").limit(sample_rows)
    few = F.broadcast(few.withColumnRenamed("doc_id", "label_id"))  # sample_rows bounds it
    rows = with_statistics(docs.select("doc_id", "text").join(few, F.col("doc_id") == F.col("label_id")).select("doc_id", "text", "y"))
    one = F.min(F.struct(F.xxhash64("doc.text").alias("hash"), *(F.col(f"stats.{k}").alias(k) for k in NAMES)))
    rows = rows.groupBy("doc.doc_id").agg(F.max("doc.y").alias("y"), one.alias("one"))
    got = rows.select("doc_id", "y", *(F.col(f"one.{k}").alias(f"x_{k}") for k in NAMES)).toPandas().sort_values(["doc_id"], kind="stable")
    return got[[f"x_{k}" for k in NAMES]].to_numpy(float).reshape(-1, len(NAMES)), got["y"].to_numpy(float)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


# --- fitting, on the driver's bounded sample ---

Rule = tuple[tuple[int, bool, float], ...]  # (statistic, above, bound): x > bound or x <= bound


def _tree(x: np.ndarray, g: np.ndarray, h: np.ndarray, cuts: list[np.ndarray], rows: np.ndarray, depth: int, path: Rule, paths: dict[Rule, None], f: np.ndarray) -> None:
    """Split on the largest gain in a second-order expansion of the log loss; add each path to ``paths``."""
    if path:
        paths.setdefault(path, None)
    value = g[rows].sum() / (h[rows].sum() + 1.0)
    if depth and len(rows) >= 20:
        best = (1e-9, -1, 0.0)
        total_g, total_h = g[rows].sum(), h[rows].sum()
        for j, bounds in enumerate(cuts):
            place = np.searchsorted(bounds, x[rows, j], side="left")  # x <= bounds[i] lies in 0..i
            left_g = np.cumsum(np.bincount(place, g[rows], len(bounds) + 1))[:-1]
            left_h = np.cumsum(np.bincount(place, h[rows], len(bounds) + 1))[:-1]
            gain = left_g**2 / (left_h + 1) + (total_g - left_g) ** 2 / (total_h - left_h + 1) - total_g**2 / (total_h + 1)
            if len(gain) and gain.max() > best[0]:
                best = (float(gain.max()), j, float(bounds[gain.argmax()]))
        if best[1] >= 0:
            _, j, bound = best
            above = x[rows, j] > bound
            for side in (True, False):
                _tree(x, g, h, cuts, rows[above == side], depth - 1, (*path, (j, side, bound)), paths, f)
            return
    f[rows] += 0.3 * value


def grow_rules(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> list[Rule]:
    rng = np.random.default_rng(seed)
    # cuts at quantiles of the rows, and of the values that occur, so that rare values are told apart too
    at = np.linspace(0, 1, CUTS + 1)[:-1]
    cuts = [np.unique([np.quantile(v, at, method="lower") for v in (c, np.unique(c))]) for c in x.T]
    f, paths = np.zeros(len(y)), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        seen = [c if rng.random() < 0.7 else c[:0] for c in cuts]
        part = rng.random(len(y)) < 0.7
        held = f.copy()
        _tree(x, (y - p) * part, np.maximum(p * (1 - p), 1e-6) * part, seen, np.arange(len(y)), depth, (), paths, held)
        f = held
    return list(paths)


def fires(rule: Rule, x: np.ndarray) -> np.ndarray:
    return reduce(np.logical_and, ((x[:, j] > b) == above for j, above, b in rule))


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float = PENALTY, steps: int = 400) -> tuple[float, np.ndarray]:
    """Accelerated proximal gradient; the intercept is not penalised."""
    a = np.hstack([np.ones((len(z), 1)), z])
    shrink = np.full(a.shape[1], penalty)
    shrink[0] = 0
    v = np.ones(a.shape[1])
    for _ in range(30):
        v = a.T @ (a @ v)
        v /= np.linalg.norm(v)
    step = 4 * len(y) / (v @ (a.T @ (a @ v)))
    w, u, t = np.zeros(a.shape[1]), np.zeros(a.shape[1]), 1.0
    for _ in range(steps):
        new = u - step * (a.T @ (1 / (1 + np.exp(-(a @ u))) - y)) / len(y)
        new = np.sign(new) * np.maximum(np.abs(new) - step * shrink, 0)
        t_new = (1 + math.sqrt(1 + 4 * t * t)) / 2
        u, w, t = new + (t - 1) / t_new * (new - w), new, t_new
    return float(w[0]), w[1:]


def fit(x: np.ndarray, y: np.ndarray) -> tuple[float, list[tuple[float, Rule]]]:
    """Intercept and weighted rules."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    if not 0 < y.sum() < len(y):
        return math.log(share / (1 - share)), []
    rules = grow_rules(x, y)
    bias, weights = lasso_logistic(np.array([fires(r, x) for r in rules], float).T, y)
    return bias, [(float(w), r) for w, r in zip(weights, rules, strict=True) if abs(w) > 1e-6]


def compiled(bias: float, rules: list[tuple[float, Rule]], stats: str = "stats") -> Column:
    """The score as a Spark expression over the statistics."""
    bound = lambda j, above, b: (F.col(f"{stats}.{NAMES[j]}") > b) if above else (F.col(f"{stats}.{NAMES[j]}") <= b)
    terms = [F.when(reduce(lambda p, q: p & q, (bound(*c) for c in rule)), F.lit(w)).otherwise(F.lit(0.0)) for w, rule in rules]
    return 1 / (1 + F.exp(-reduce(lambda p, q: p + q, terms, F.lit(bias))))


def scored(docs: DataFrame, labels: DataFrame, target: str = "quality", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``doc`` (the row as a struct) and its score."""
    model = fit(*labelled(docs, labels, target, sample_rows))
    return with_statistics(docs).select("doc", compiled(*model).alias("score"))


def accepted(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` that score 0.5 or more."""
    return scored(docs, labels, **settings).where("score >= 0.5").select("doc.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return rows.select("doc.doc_id", held_out(F.col("doc.doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
