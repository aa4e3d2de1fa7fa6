"""Document quality by a sparse rule ensemble.

Statistics of a text are Spark columns. Small trees, each grown on a resampling of
the labelled rows, give their paths as conjunctive rules over the statistics; a
logistic fit with an L1 penalty keeps few of them; and the kept rules with their
weights are one Spark column again, so scoring is a projection over any number of
documents, in one pass over them. Only the fit sees a bounded sample, on the driver:
``MAX_TRAIN`` labelled rows, of which each tree draws ``TREE_ROWS``.

Defined results: null and empty text have the statistics 0 and are scored by them;
labels that are null or have no document are not used; a document with several
labels counts with each; without labels of both kinds the score is the share of
label 1 (0.5 without any); repeated rows get equal scores; texts are scored whole,
however long; other columns are not looked at, whatever they are called; an empty
table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a fit uses at most.
MAX_TRAIN = 20_000
#: Of these, the rows that each tree is grown on.
TREE_ROWS = 4000
THRESHOLD = 0.3
TREES, DEPTH, CUTS, PENALTY, SEED = 40, 3, 24, 2e-3, 11

Rule = tuple[tuple[int, bool, float], ...]  # (statistic, above, cut), all of which must hold


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a text, by name, from intermediate columns that ``with_statistics`` makes."""
    chars, words = F.greatest(F.length(text), F.lit(1)), F.greatest(F.size("__words"), F.lit(1))
    return {
        "symbols": F.regexp_count(text, F.lit(r"[#$%&*!|<>{}\[\]\\^~=+_@]")) / chars,
        "capitals": F.regexp_count(text, F.lit(r"\p{Lu}")) / chars,
        "digits": F.regexp_count(text, F.lit("[0-9]")) / chars,
        "stops": F.regexp_count(text, F.lit("[.,;:?]")) / words,
        "word_length": (F.length(text) - F.size("__words")) / words,
        "distinct": F.size(F.array_distinct("__words")) / words,
        "log_words": F.log1p(F.size("__words").cast("double")),
        "breaks": F.regexp_count(text, F.lit("\n")) / words,
        "repeats": F.size(F.filter(F.zip_with("__words", F.slice("__words", 2, F.size("__words")), _same), lambda x: x)) / words,
    }


def _same(a: Column, b: Column) -> Column:
    return F.coalesce(a == b, F.lit(False))


NAMES = ("symbols", "capitals", "digits", "stops", "word_length", "distinct", "log_words", "breaks", "repeats")


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    split = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    out = docs.withColumn("__text", text).withColumn("__words", split)
    stats = statistics(F.col("__text"))
    return out.withColumns({f"__{n}": F.coalesce(stats[n], F.lit(0.0)).cast("double") for n in NAMES}).drop("__text", "__words")


def _cuts(x: np.ndarray) -> list[np.ndarray]:
    """Candidate cuts of each statistic: middles between neighbouring quantiles of its rows and of its distinct values."""
    out = []
    at = np.linspace(0, 1, CUTS + 2)
    for column in x.T:
        marks = np.unique(np.concatenate([np.quantile(column, at), np.quantile(np.unique(column), at)]))
        out.append((marks[1:] + marks[:-1]) / 2)
    return out


def _grow(x, y, rows, cuts, rng, path: Rule, rules: set[Rule]) -> None:
    """Grow a tree over ``rows`` and add the path to each of its nodes."""
    if path:
        rules.add(tuple(sorted(path)))
    total, ones = len(rows), float(y[rows].sum())
    if len(path) == DEPTH or total < 20 or ones in (0.0, float(total)):
        return
    best = (0.0, None)
    parent = ones * (total - ones) / total
    for j in rng.choice(x.shape[1], 4, replace=False):
        if not len(cuts[j]):
            continue
        slot = np.searchsorted(cuts[j], x[rows, j], side="left")  # slot k: above the first k cuts
        n = np.bincount(slot, minlength=len(cuts[j]) + 1).cumsum()[:-1]
        p = np.bincount(slot, y[rows], minlength=len(cuts[j]) + 1).cumsum()[:-1]
        ok = (n > 0) & (n < total)
        with np.errstate(divide="ignore", invalid="ignore"):
            after = p * (n - p) / n + (ones - p) * (total - n - ones + p) / (total - n)
        gain = np.where(ok, parent - after, -1.0)
        k = int(np.argmax(gain))
        if gain[k] > best[0] + 1e-12:
            best = (float(gain[k]), (int(j), float(cuts[j][k])))
    if best[1] is None:
        return
    j, cut = best[1]
    above = x[rows, j] > cut
    _grow(x, y, rows[above], cuts, rng, (*path, (j, True, cut)), rules)
    _grow(x, y, rows[~above], cuts, rng, (*path, (j, False, cut)), rules)


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    return np.logical_and.reduce([(x[:, j] > cut) == above for j, above, cut in rule])


def _lasso(r: np.ndarray, y: np.ndarray, penalty: float) -> tuple[np.ndarray, float]:
    """Logistic weights with an L1 penalty, by accelerated proximal gradient."""
    n, m = r.shape
    w, b = np.zeros(m), float(np.log(y.mean() / (1 - y.mean())))
    at_w, at_b, t = w.copy(), b, 1.0
    step = 4 * n / (np.linalg.norm(np.c_[r, np.ones(n)], 2) ** 2)
    for _ in range(600):
        error = 1 / (1 + np.exp(-(r @ at_w + at_b))) - y
        new_w = at_w - step * (r.T @ error) / n
        new_w = np.sign(new_w) * np.maximum(np.abs(new_w) - step * penalty, 0)
        new_b = at_b - step * error.mean()
        grown = (1 + np.sqrt(1 + 4 * t * t)) / 2
        at_w = new_w + (t - 1) / grown * (new_w - w)
        at_b = new_b + (t - 1) / grown * (new_b - b)
        done = np.abs(new_w - w).max(initial=0) < 1e-7
        w, b, t = new_w, float(new_b), grown
        if done:
            break
    return w, b


@dataclass(frozen=True)
class RuleModel:
    """Rules over NAMES with weights; the score is their logistic sum."""

    rules: tuple[Rule, ...]
    weights: tuple[float, ...]
    bias: float

    def column(self) -> Column:
        """The score as a column over ``with_statistics``."""
        total = F.lit(self.bias)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            met = F.lit(True)
            for j, above, cut in rule:
                stat = F.col(f"__{NAMES[j]}")
                met = met & (stat > cut if above else stat <= cut)
            total = total + F.when(met, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def fit_rules(x: np.ndarray, y: np.ndarray) -> RuleModel:
    """A rule ensemble for statistics ``x`` (rows by NAMES) and labels ``y`` (0 or 1)."""
    if not len(y):
        return RuleModel((), (), 0.0)
    share = float(y.mean())
    if share in (0.0, 1.0):
        return RuleModel((), (), 20.0 if share else -20.0)
    rng = np.random.default_rng(SEED)
    cuts, found = _cuts(x), set()
    for _ in range(TREES):
        rows = rng.integers(0, len(y), min(len(y), TREE_ROWS))
        _grow(x, y, rows, cuts, rng, (), found)
    rules = sorted(found)
    if not rules:
        return RuleModel((), (), float(np.log(share / (1 - share))))
    met = np.stack([holds(rule, x) for rule in rules], axis=1).astype(float)
    # of rules that hold for the same rows the shortest stays
    _, first = np.unique(met, axis=1, return_index=True)
    keep = [int(i) for i in sorted(first) if 0 < met[:, i].sum() < len(y)]
    if not keep:
        return RuleModel((), (), float(np.log(share / (1 - share))))
    w, b = _lasso(met[:, keep], y.astype(float), PENALTY)
    used = [(rules[i], float(v)) for i, v in zip(keep, w, strict=True) if v]
    return RuleModel(tuple(r for r, _ in used), tuple(v for _, v in used), b)


def remainder(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN) -> RuleModel:
    """Fit on labelled rows of ``docs`` (doc_id, text) whose remainder isn't 0; statistics are taken of the sample alone."""
    from .store import materialize

    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y"))
    known = known.filter(F.col("y").isin(0, 1) & (remainder(F.col("doc_id")) != 0))
    met = materialize(docs.select("doc_id").join(known, "doc_id"), "labelled")
    n = met.count()
    if n > max_rows:  # a sample by hash, somewhat under the bound so that it holds
        met = met.filter(F.pmod(F.xxhash64("doc_id"), F.lit(n)) < int(0.95 * max_rows))
    met = F.broadcast(met.distinct().limit(max_rows))
    rows = with_statistics(docs.select("doc_id", "text").join(met, "doc_id")).select("doc_id", "y", *(f"__{n}" for n in NAMES))
    data = np.array(sorted(map(tuple, rows.limit(max_rows).collect())), float).reshape(-1, 2 + len(NAMES))
    return fit_rules(data[:, 2:], data[:, 1])


def _rows(docs: DataFrame) -> DataFrame:
    row = F.struct(*(docs[c] for c in docs.columns)).alias("row")
    return docs.select(row, docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    rows = _rows(docs).drop("row")
    score = train(rows, labels).column()
    scored = with_statistics(rows).select("doc_id", (remainder(F.col("doc_id")) == 0).alias("held_out"), score.alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` that the classifier doesn't reject."""
    rows = _rows(docs)
    # a filter would take a copy of every statistic for every rule below the projection that makes them; a column that
    # depends on the row's place keeps it above
    scored = with_statistics(rows).select("row", train(rows, labels).column().alias("score"), F.monotonically_increasing_id().alias("at"))
    kept = scored.filter((F.col("score") >= THRESHOLD) & (F.col("at") >= 0))
    return kept.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def query(spark, sf_dir: str) -> DataFrame:
    from .store import table

    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
