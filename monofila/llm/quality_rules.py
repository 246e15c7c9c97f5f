"""Quality rules judged by an isolation forest.

Rule statistics of every whole text come first (no shuffle). Random trees, each grown on a
small sample of labelled rows, split one statistic at a random place per node; a document
that few splits isolate is unlike the rest. Samples are small so that junk of one kind, rare
in each, does not hide itself. The score threshold is calibrated on labelled rows that grew
no tree: it drops as much labelled junk as it can while ``KEEP`` of the good rows stay.

Each tree draws its own rows from all labelled ones of one half; the other half sets the threshold,
every row of it. The only rows that reach the driver are those of the trees, ``TREES`` x ``SAMPLE``;
counts, statistics and verdicts cover every document.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from monofila.llm.common import carried, hash_below, nth_lowest, scratch, shipped, slices, texts, unpacked, utf8
from monofila.llm.statistics import rule_counts

TREES, SAMPLE = 200, 64
#: Share of the good calibration rows that must stay.
KEEP = 0.995
SEED = 7

COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_shouts", "n_digits",
    "n_stutters", "n_bars", "n_stops",
)


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the rule counts of every text."""

    def run(batches):
        for b in batches:
            values = utf8(b)
            for i, j in slices(values):
                found = rule_counts(values[i:j])
                yield carried(b.slice(i, j - i), "doc_id", **{k: pa.array(found[k], pa.int64()) for k in COUNTS})

    rows = texts(docs).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    return rows.mapInArrow(run, "doc_id bigint, " + ", ".join(f"{k} bigint" for k in COUNTS))


def features(counts: dict[str, np.ndarray]) -> np.ndarray:
    """One row per document; shares, so that long and short texts compare. What the base rule
    judges already (length, repeats) is left out: good documents vary in it."""
    words, chars = np.maximum(counts["n_words"], 1), np.maximum(counts["word_chars"], 1)
    return np.column_stack([
        counts["word_chars"] / words, counts["n_symbols"] / words, counts["n_upper"] / chars,
        counts["n_shouts"] / words, counts["n_bars"] / words, counts["n_stops"] / words,
    ]).astype(np.float64)


def average_path(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=np.float64)
    many = np.maximum(n, 2)
    return np.where(n < 2, 0.0, np.where(n == 2, 1.0, 2 * (np.log(many - 1) + np.euler_gamma) - 2 * (many - 1) / many))


@dataclass
class Tree:
    """Nodes as arrays; a leaf has feature -1 and its depth plus the rest it stands for."""

    feature: np.ndarray
    at: np.ndarray
    below: np.ndarray
    path: np.ndarray

    def paths(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), dtype=np.int64)
        rows = np.arange(len(x))
        while True:
            split = self.feature[node]
            inner = split >= 0
            if not inner.any():
                return self.path[node]
            right = x[rows, np.maximum(split, 0)] >= self.at[node]
            node = np.where(inner, self.below[node] + right, node)


def grow(x: np.ndarray, rng: np.random.Generator, deepest: int) -> Tree:
    feature, at, below, path = [-1], [0.0], [0], [0.0]
    todo = [(0, x, 0)]
    while todo:
        node, rows, depth = todo.pop()
        low, high = rows.min(axis=0), rows.max(axis=0)
        varied = np.flatnonzero(high > low)
        if depth >= deepest or len(rows) < 2 or not len(varied):
            path[node] = depth + float(average_path(len(rows)))
            continue
        f = int(rng.choice(varied))
        cut = float(rng.uniform(low[f], high[f]))
        feature[node], at[node], below[node] = f, cut, len(feature)
        right = rows[:, f] >= cut
        for side in (rows[~right], rows[right]):
            todo.append((len(feature), side, depth + 1))
            feature.append(-1), at.append(0.0), below.append(0), path.append(depth + 1.0)
    return Tree(np.array(feature), np.array(at), np.array(below), np.array(path))


@dataclass
class Forest:
    trees: list[Tree]
    sample: int
    threshold: float = float("inf")

    @classmethod
    def fit(cls, x: np.ndarray, trees: int = TREES, sample: int = SAMPLE, seed: int = SEED) -> Forest:
        rng = np.random.default_rng(seed)
        sample = min(sample, len(x))
        return cls.grown([x[rng.choice(len(x), sample, replace=False)] for _ in range(trees)], rng)

    @classmethod
    def grown(cls, drawn: list[np.ndarray], rng: np.random.Generator) -> Forest:
        """One tree from each matrix of rows, all of equal length."""
        sample = len(drawn[0])
        deepest = int(np.ceil(np.log2(max(sample, 2))))
        return cls([grow(x, rng, deepest) for x in drawn], sample)

    def score(self, x: np.ndarray) -> np.ndarray:
        """From 0 (usual) to 1 (isolated at once)."""
        mean = np.mean([t.paths(x) for t in self.trees], axis=0) if len(x) else np.zeros(0)
        return 2.0 ** (-mean / max(float(average_path(self.sample)), 1.0))

    def calibrate(self, good: np.ndarray, junk: np.ndarray, keep: float = KEEP) -> None:
        """Lowest threshold that keeps enough good rows, raised as far as it drops no less junk."""
        if not len(good):
            return
        best = np.quantile(good, keep, method="higher")
        dropped = junk[junk > best]
        self.threshold = float((best + dropped.min()) / 2) if len(dropped) else float(best)


def drawn(rows: DataFrame, n: int, trees: int = TREES, sample: int = SAMPLE) -> list[np.ndarray]:
    """Features of the rows of each tree: of all ``n`` rows those with the lowest hashes of (row, tree), so
    every row takes part in every draw. What is sent to be ranked is a few more than what is drawn."""
    h = F.xxhash64("doc_id", "copy", "tree")
    offered = rows.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).withColumn("h", h).filter(F.col("h") <= hash_below(n, sample))
    place = F.row_number().over(Window.partitionBy("tree").orderBy("h", "doc_id", "copy"))
    found = offered.withColumn("place", place).filter(F.col("place") <= sample).toPandas().sort_values(["tree", "place"])
    x, ends = features({k: found[k].to_numpy() for k in COUNTS}), np.flatnonzero(np.diff(found["tree"].to_numpy())) + 1
    return np.split(x, ends)


def fit(counted: DataFrame, labels: DataFrame) -> Forest | None:
    """Forest and threshold from all labelled rows; None when there is no row labelled good."""
    marks = labels.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.min("quality").alias("quality"))
    # Rows that share a doc_id are on one side; what was counted and their number tell them apart.
    alike = F.row_number().over(Window.partitionBy("doc_id", "copy").orderBy("copy"))
    side = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    known = counted.join(marks.filter("quality IS NOT NULL"), "doc_id").withColumns({"copy": F.xxhash64(*COUNTS), "grows": side})
    known = scratch(known.withColumn("copy", F.xxhash64("copy", alike)), "labelled-statistics")
    real = known.filter("n_words >= 50")
    seed = real.filter("grows")
    n = seed.count()
    if n < 2 or known.filter("quality = 1").isEmpty():
        return None
    samples = drawn(seed, n)
    least = min(map(len, samples))
    forest = Forest.grown([x[:least] for x in samples], np.random.default_rng(SEED))
    shared = shipped(counted.sparkSession, forest)

    def judge(batches):
        forest = unpacked(shared)
        for b in batches:
            score = forest.score(features({k: b.column(k).to_numpy() for k in COUNTS}))
            yield carried(b, "good", score=pa.array(score))

    rest = real.filter("NOT grows").select((F.col("quality") == 1).alias("good"), *COUNTS)
    scores = scratch(rest.mapInArrow(judge, "good boolean, score double"), "labelled-scores")
    good = scores.filter("good")
    if m := good.count():
        best = nth_lowest(good, "score", int(np.ceil((m - 1) * KEEP)))
        dropped = scores.filter(~F.col("good") & (F.col("score") > best)).agg(F.min("score")).first()[0]
        forest.threshold = best if dropped is None else (best + dropped) / 2
    return forest


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per input row: doc_id, the counts, base_failed, score, kept.

    Null text has no words and fails the base rule, a null doc_id stays null, repeated rows
    are judged alike, an empty table gives none. Without good labels no forest grows and the
    base rule decides alone. Other columns are ignored.
    """
    counted = scratch(statistics(docs), "rule-statistics")
    shared = shipped(counted.sparkSession, fit(counted, labels))

    def judge(batches):
        forest = unpacked(shared)
        for b in batches:
            counts = {k: b.column(k).to_numpy() for k in COUNTS}
            failed = (counts["n_words"] < 50) | (100 * counts["n_repeat_words"] > 50 * counts["n_words"])
            score = forest.score(features(counts)) if forest else np.zeros(b.num_rows)
            odd = score > forest.threshold if forest else np.zeros(b.num_rows, dtype=bool)
            yield carried(b, "doc_id", *COUNTS, base_failed=pa.array(failed), score=pa.array(score), kept=pa.array(~failed & ~odd))

    shape = ", ".join(f"{k} bigint" for k in COUNTS)
    return counted.mapInArrow(judge, f"doc_id bigint, {shape}, base_failed boolean, score double, kept boolean")
