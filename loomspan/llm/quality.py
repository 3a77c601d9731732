"""Document quality by a sparse rule ensemble that ends up as one Spark column expression.

Statistics of a text are Spark expressions. On a bounded labelled sample small trees are grown, each on the errors
that the ones before left; every path from a root is a rule, a conjunction of comparisons. A logistic model with an
absolute-value penalty is fitted on the rules, most of which get no weight, and the rest is compiled into a column:
1 / (1 + exp(-(bias + sum of weight where the rule holds))). Scoring runs inside Spark without Python.

Defined results: null and empty texts have all statistics 0 and the score that the rules give to those; statistics
are finite for every text; without labelled rows of both classes the score is the share of label 1 (0 without any);
rows that repeat are scored each, a null key like any other; long texts are read whole; an empty table gives an empty
table; other columns, of whatever name, are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.llm.labelled import SAMPLE, is_held_out, sample

THRESHOLD = 0.5
#: Trees, their depth, cuts tried for each statistic, rows of a leaf at least, and the penalty.
TREES, DEPTH, CUTS, LEAF, PENALTY = 24, 3, 32, 5, 0.002


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a text; shares are of characters, words or lines."""
    t = F.coalesce(text, F.lit(""))
    size = F.length(t)
    # what is left without small letters and spaces is short, so the other counts read little
    rest = F.regexp_replace(t, r"[\p{Ll} ]+", "")
    words = F.filter(F.split(t, r"[ \n\t\r]+"), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda x: x != "")

    def left(pattern: str) -> Column:
        return F.length(F.regexp_replace(rest, pattern, ""))

    def share(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))

    n_words, n_lines = F.size(words), F.size(lines)
    return {
        "chars": size.cast("double"),
        "words": n_words.cast("double"),
        "word_length": share(size.cast("double"), n_words),
        "upper": share(left(r"[^\p{Lu}]+"), size),
        "digits": share(left(r"[^0-9]+"), size),
        "stops": share(left(r"[^.,]+"), size),
        "marks": share(left(r"[\p{L}\p{N}\s.,]+"), size),
        "bars": share(left(r"[^|]+"), size),
        "spaces": share(F.length(F.regexp_replace(t, r"[^ \n\t]+", "")), size),
        "distinct_words": share(F.size(F.array_distinct(words)), n_words),
        "distinct_lines": share(F.size(F.array_distinct(lines)), n_lines),
        "line_words": share(n_words.cast("double"), n_lines),
    }


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, above, cut): greater than the cut if above, else not greater."""

    parts: tuple[tuple[str, bool, float], ...]

    def holds(self, stats: dict[str, np.ndarray]) -> np.ndarray:
        return reduce(np.logical_and, ((stats[s] > c) == above for s, above, c in self.parts))

    def column(self, stats: dict[str, Column]) -> Column:
        return reduce(lambda a, b: a & b, ((stats[s] > c) if above else (stats[s] <= c) for s, above, c in self.parts))


def grow(x: np.ndarray, names: list[str], error: np.ndarray, cuts: list[np.ndarray], depth: int, path: tuple = ()) -> list[tuple[tuple, np.ndarray]]:
    """(path, rows) of every node but the root of a tree that parts ``error`` by least squares."""

    def node(rows: np.ndarray, path: tuple, depth: int) -> list[tuple[tuple, np.ndarray]]:
        if not depth or len(rows) < 2 * LEAF:
            return []
        best = (1e-9, -1, 0.0)
        e = error[rows]
        for j, own in enumerate(cuts):
            if not len(own):
                continue
            bins = np.searchsorted(own, x[rows, j], "left")  # bin i: cut i-1 < x <= cut i
            n = np.cumsum(np.bincount(bins, minlength=len(own) + 1))[:-1]
            s = np.cumsum(np.bincount(bins, e, minlength=len(own) + 1))[:-1]
            ok = (n >= LEAF) & (len(rows) - n >= LEAF)
            gain = np.where(ok, s**2 / np.maximum(n, 1) + (e.sum() - s) ** 2 / np.maximum(len(rows) - n, 1) - e.sum() ** 2 / len(rows), 0)
            i = int(gain.argmax())
            if gain[i] > best[0]:
                best = (float(gain[i]), j, float(own[i]))
        _, j, cut = best
        if j < 0:
            return []
        out = []
        for above in (False, True):
            kept = rows[(x[rows, j] > cut) == above]
            own = (*path, (names[j], above, cut))
            out += [(own, kept), *node(kept, own, depth - 1)]
        return out

    return node(np.arange(len(x)), path, depth)


def extract_rules(stats: dict[str, np.ndarray], labels: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> list[Rule]:
    """Rules of boosted trees, each once, those that hold for all or no row left out."""
    names = list(stats)
    x = np.stack([stats[n] for n in names], axis=1)
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, CUTS + 1)[1:-1])) for c in x.T]
    z = np.full(len(labels), np.log((labels.mean() + 1e-9) / (1 - labels.mean() + 1e-9)))
    rules: dict[Rule, None] = {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        nodes = grow(x, names, labels - p, cuts, depth)
        if not nodes:
            break
        inner = {path[:-1] for path, _ in nodes}
        for path, rows in nodes:
            rules.setdefault(Rule(tuple(sorted(path))))
            if path not in inner:
                curve = (p[rows] * (1 - p[rows])).sum() + 1.0
                z[rows] += 0.5 * (labels[rows] - p[rows]).sum() / curve
    return [r for r in rules if 0 < (h := r.holds(stats)).sum() < len(h)]


def lasso(x: np.ndarray, labels: np.ndarray, penalty: float = PENALTY, steps: int = 800) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic model with an absolute-value penalty, by accelerated proximal steps."""
    n, k = x.shape
    w, b = np.zeros(k), float(np.log(labels.mean() / (1 - labels.mean())))
    top = np.linalg.norm(np.c_[x, np.ones(n)].T @ np.c_[x, np.ones(n)], 2) / (4 * n)
    v, c, t = w, b, 1.0
    for _ in range(steps):
        error = 1 / (1 + np.exp(-np.clip(x @ v + c, -40, 40))) - labels
        new = v - (x.T @ error / n) / top
        new = np.sign(new) * np.maximum(abs(new) - penalty / top, 0)
        new_b = c - error.mean() / top
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = new + (t - 1) / t_new * (new - w), new_b + (t - 1) / t_new * (new_b - b)
        w, b, t = new, new_b, t_new
    return w, b


@dataclass(frozen=True)
class RuleModel:
    """Weighted rules."""

    rules: tuple[tuple[Rule, float], ...]
    bias: float

    def column(self, stats: dict[str, Column]) -> Column:
        total = reduce(lambda a, b: a + b, (F.when(r.column(stats), F.lit(w)).otherwise(F.lit(0.0)) for r, w in self.rules), F.lit(self.bias))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def score(self, stats: dict[str, np.ndarray]) -> np.ndarray:
        z = self.bias + sum(w * r.holds(stats) for r, w in self.rules)
        return 1 / (1 + np.exp(-z))


def fit(stats: dict[str, np.ndarray], labels: np.ndarray) -> RuleModel:
    share = float(labels.mean()) if len(labels) else 0.0
    if not 0 < share < 1:
        return RuleModel((), float(np.log(max(share, 1e-12) / max(1 - share, 1e-12))))
    rules = extract_rules(stats, labels)
    if not rules:
        return RuleModel((), float(np.log(share / (1 - share))))
    w, b = lasso(np.stack([r.holds(stats) for r in rules], axis=1).astype(np.float64), labels)
    return RuleModel(tuple((r, float(x)) for r, x in zip(rules, w, strict=True) if abs(x) > 1e-9), b)


def with_statistics(df: DataFrame, text: str, *kept: str) -> DataFrame:
    """``kept`` and the statistics of ``text``, each computed once a row."""
    stats = statistics(F.col(text))
    return df.select(*kept, *(c.alias(f"stat_{n}") for n, c in stats.items()))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text", most: int = SAMPLE) -> RuleModel:
    """Fitted on labelled rows that are not held out; only their statistics come to the driver."""
    got = with_statistics(sample(docs, labels, label, key, text, most), text, key, "label").toArrow().to_pandas()
    got = got.sort_values(list(got.columns), kind="stable")
    return fit({c[5:]: got[c].to_numpy(np.float64) for c in got.columns if c.startswith("stat_")}, got["label"].to_numpy(np.float64))


def predict(docs: DataFrame, model: RuleModel, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """key, score, predicted (1 from ``threshold`` on)."""
    stats = with_statistics(docs, text, key)
    score = model.column({c[5:]: F.col(c) for c in stats.columns if c.startswith("stat_")})
    return stats.select(key, score.alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def report(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: key, held_out, score, predicted."""
    scored = predict(docs.select(key, text), train(docs, labels, key=key, text=text), key, text)
    return scored.select(key, is_held_out(key).alias("held_out"), "score", "predicted")
