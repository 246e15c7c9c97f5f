"""Quality classifier: a weak-label model teaches a hashed linear scorer.

Simple labellers vote good, bad or nothing on each document. Documents with equal votes are
alike to the model, so the whole corpus reaches the driver as one count per vote pattern (at
most 3 ** labellers of them), whatever its size. Expectation-maximisation finds how often
each labeller is right, and so the probability that a pattern means a good document. These
posterior labels train a linear model on hashed words and word shapes, which then scores
every document; labelled rows, where there are any, only set its threshold.

Training sees every vote pattern of the corpus: ``TRAINED`` documents are dealt out evenly over
the patterns, rare ones give all they have, and each pattern has at least one. A document weighs
by the square root of how many of its pattern it stands for, so a kind of junk that is one in
many thousand still tells. Documents are picked by a hash of id and text. Calibration uses
every labelled row. Votes, accuracies and scores cover all documents and whole texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from monofila.llm.common import Words, carried, hash_below, nth_lowest, scratch, shipped, slices, texts, unpacked, utf8
from monofila.llm.statistics import rule_counts

TRAINED = 4_096
#: Places for hashed features; the first ``SHAPES`` hold repeats and word shapes, the others words.
PLACES, SHAPES = 1 << 14, 1 << 11
KEEP = 0.995

#: (share, good below, bad above) per labeller; between the two it abstains.
LABELLERS = {
    "symbols": ("n_symbols", "word_chars", 0.01, 0.05),
    "marked words": ("n_marked", "n_words", 0.05, 0.20),
    "capitals": ("n_upper", "word_chars", 0.15, 0.50),
    "shouts": ("n_shouts", "n_words", 0.05, 0.40),
    "stutters": ("n_stutters", "n_words", 0.05, 0.30),
    "bars": ("n_bars", "n_words", 0.05, 0.20),
    "repeats": ("n_repeat_words", "n_words", 0.20, 0.50),
    "double lines": ("n_dup_lines", "n_lines", 0.20, 0.50),
    "digits": ("n_digits", "word_chars", 0.10, 0.40),
}
GOOD, BAD, SILENT = 1, 0, 2


def votes(batch: list[bytes]) -> np.ndarray:
    """Votes of every labeller as one number in base 3. A text without words gets no vote."""
    counts = rule_counts(batch)
    empty, code = counts["n_words"] == 0, np.zeros(len(batch), dtype=np.int64)
    for part, whole, good, bad in LABELLERS.values():
        share = counts[part] / np.maximum(counts[whole], 1)
        vote = np.where(share <= good, GOOD, np.where(share > bad, BAD, SILENT))
        code = code * 3 + np.where(empty, SILENT, vote)
    return code


def ballots(codes: np.ndarray) -> np.ndarray:
    """Patterns as a matrix, one column per labeller."""
    n = len(LABELLERS)
    return (codes[:, None] // 3 ** np.arange(n - 1, -1, -1)) % 3


@dataclass
class WeakLabels:
    """P(vote | class) per class and labeller, and the share of each class.

    Class 0 is good; junk comes in kinds, so it gets one class per labeller, started from
    the documents that this labeller calls bad. With a single class for all junk, a kind that
    only one labeller knows would pass as good by the others' votes.
    """

    table: np.ndarray
    share: np.ndarray

    @classmethod
    def fit(cls, patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> WeakLabels:
        n, labellers = patterns.shape
        bad = (patterns == BAD).astype(np.float64)
        known = bad.sum(axis=1, keepdims=True)
        belief = np.hstack([np.where(known > 0, 0.01, 0.99), np.where(known > 0, 0.99 * bad / np.maximum(known, 1), 0.01 / labellers)])
        one_hot = np.stack([patterns == v for v in (BAD, GOOD, SILENT)], axis=2).astype(np.float64)
        model = cls(np.full((labellers + 1, labellers, 3), 1 / 3), np.full(labellers + 1, 1 / (labellers + 1)))
        for _ in range(rounds):
            weight = belief * counts[:, None]
            # One pseudo-vote of each kind keeps unseen votes possible.
            seen = np.einsum("pc,plv->clv", weight, one_hot) + 1.0
            model.table = seen / seen.sum(axis=2, keepdims=True)
            model.share = (weight.sum(axis=0) + 1.0) / (weight.sum() + labellers + 1)
            new = model.classes(patterns)
            done = np.abs(new - belief).max(initial=0.0) < 1e-9
            belief = new
            if done:
                break
        return model

    def classes(self, patterns: np.ndarray) -> np.ndarray:
        at = np.arange(patterns.shape[1])
        log = np.log(self.share) + np.log(self.table)[:, at, patterns].sum(axis=2).T
        odds = np.exp(log - log.max(axis=1, keepdims=True, initial=-np.inf))
        return odds / odds.sum(axis=1, keepdims=True)

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """P(good) per pattern."""
        return self.classes(patterns)[:, 0]

    def accuracy(self) -> np.ndarray:
        """P(bad vote | junk) and P(no bad vote | good) per labeller."""
        junk = (self.share[1:, None] * self.table[1:, :, BAD]).sum(axis=0) / self.share[1:].sum()
        return np.stack([junk, 1 - self.table[0, :, BAD]])


_CLASS = np.zeros(256, dtype=np.int64)
_CLASS[65:91] = 1
_CLASS[97:123] = 2
_CLASS[128:] = 2
_CLASS[48:58] = 3
_CLASS[np.frombuffer(b"#*$%&|<>", np.uint8)] = 4
_CLASS[np.frombuffer(b"!?", np.uint8)] = 5
_CLASS[np.frombuffer(b".,;:'\"()-", np.uint8)] = 6


def places(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of each word, of its shape, and of whether it repeats the word before. A shape
    says which kinds of bytes a word has none, one or more of."""
    hashes = words.hashes(lower=True)
    kinds, shape = _CLASS[words.data], np.zeros(len(hashes), dtype=np.uint64)
    for kind in range(1, 7):
        total = np.concatenate(([0], np.cumsum(kinds == kind)))
        shape = shape * np.uint64(3) + np.minimum(total[words.ends] - total[words.starts], 2).astype(np.uint64)
    same = np.zeros(len(hashes), dtype=np.int64)
    if len(hashes) > 1:
        same[1:] = (hashes[1:] == hashes[:-1]) & (words.owner[1:] == words.owner[:-1])
    word = np.uint64(SHAPES) + hashes % np.uint64(PLACES - SHAPES)
    return word.astype(np.int64), 2 + (shape % np.uint64(SHAPES - 2)).astype(np.int64), same


def sparse(batch: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, share of the words) of each text."""
    words = Words(batch)
    found = places(words)
    out = []
    for a, b in zip(words.first[:-1], words.first[1:]):
        at, n = np.unique(np.concatenate([p[a:b] for p in found]), return_counts=True)
        out.append((at, n / max(b - a, 1)))
    return out


@dataclass
class Scorer:
    """Logistic model on hashed features; ``threshold`` splits kept from rejected."""

    weights: np.ndarray
    bias: float
    threshold: float = 0.5

    @classmethod
    def fit(
        cls, rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, mass: np.ndarray | None = None,
        rounds: int = 300, rate: float = 2.0,
    ) -> Scorer:
        """Full-batch descent with momentum on the posterior labels, so equal input gives an equal
        model. Steps are not scaled by feature: what tells many documents apart must outweigh
        the words that happen to be in a few."""
        model = cls(np.zeros(PLACES), 0.0)
        if not rows:
            return model
        at = np.concatenate([a for a, _ in rows])
        share = np.concatenate([s for _, s in rows])
        owner = np.repeat(np.arange(len(rows)), [len(a) for a, _ in rows])
        # Both classes weigh alike.
        mass, good = np.ones(len(rows)) if mass is None else mass, target >= 0.5
        weight = 0.5 * mass / np.where(good, max(mass[good].sum(), 1e-9), max(mass[~good].sum(), 1e-9))
        speed, bias_speed = np.zeros(PLACES), 0.0
        for _ in range(rounds):
            margin = np.bincount(owner, share * model.weights[at], minlength=len(rows)) + model.bias
            error = (1 / (1 + np.exp(-np.clip(margin, -50, 50))) - target) * weight
            slope = np.bincount(at, share * error[owner], minlength=PLACES) + 1e-5 * model.weights
            speed, bias_speed = 0.9 * speed - rate * slope, 0.9 * bias_speed - rate * error.sum()
            model.weights += speed
            model.bias += bias_speed
        return model

    def score(self, batch: list[bytes]) -> np.ndarray:
        words = Words(batch)
        total = np.concatenate(([0.0], np.cumsum(sum(self.weights[p] for p in places(words)))))
        n = np.diff(words.first)
        mean = (total[words.first[1:]] - total[words.first[:-1]]) / np.maximum(n, 1)
        return np.where(n == 0, 0.0, 1 / (1 + np.exp(-np.clip(mean + self.bias, -50, 50))))


def voted(docs: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            values = utf8(b)
            for i, j in slices(values):
                yield carried(b.slice(i, j - i), "h", pattern=pa.array(votes(values[i:j]), pa.int64()))

    return marked(docs).mapInArrow(run, "h bigint, pattern bigint")


def marked(docs: DataFrame) -> DataFrame:
    """``h`` is equal for rows of equal id and text alone; no id is an id like others here."""
    return docs.withColumn("h", F.xxhash64("doc_id", "text"))


def dealt(counts: np.ndarray, most: int) -> np.ndarray:
    """How many of each pattern are drawn: all of the rare ones, equally many of the others, one at
    least."""
    quota, left = np.zeros(len(counts), dtype=np.int64), most
    for turn, i in enumerate(np.argsort(counts, kind="stable")):
        quota[i] = min(counts[i], max(1, left // (len(counts) - turn)))
        left = max(0, left - quota[i])
    return quota


def train(docs: DataFrame, patterns: DataFrame, trained: int) -> tuple[Scorer, dict[int, float]]:
    """Scorer and the posterior of every pattern that occurs."""
    seen = patterns.groupBy("pattern").agg(F.count("*"), F.approx_count_distinct("h")).orderBy("pattern").collect()
    codes = np.array([r[0] for r in seen], dtype=np.int64)
    matrix, counts = ballots(codes), np.array([r[1] for r in seen], dtype=np.float64)
    belief = dict(zip(codes.tolist(), WeakLabels.fit(matrix, counts).posterior(matrix).tolist()))
    if not seen:
        return Scorer.fit([], np.zeros(0)), belief
    # Copies are one document, however many: the cut of a pattern goes by its different ones.
    different = np.array([r[2] for r in seen], dtype=np.int64)
    quota = dealt(different, trained)
    limits = [(int(p), int(q), hash_below(int(n), int(1.2 * q) + 1)) for p, q, n in zip(codes, quota, different)]
    spark = docs.sparkSession
    cuts = spark.createDataFrame(limits, "pattern bigint, quota int, cut bigint")
    few = patterns.join(F.broadcast(cuts), "pattern").filter("h <= cut").groupBy("pattern", "quota", "h").agg(F.lit(1).alias("one"))
    place = F.row_number().over(Window.partitionBy("pattern").orderBy("h"))
    chosen = few.withColumn("place", place).filter("place <= quota").select("h").distinct()

    def run(batches):
        for b in batches:
            values = utf8(b)
            for i, j in slices(values):
                rows, codes = sparse(values[i:j]), votes(values[i:j])
                yield pa.RecordBatch.from_pydict({
                    "h": pa.array(b.column("h").slice(i, j - i)), "pattern": pa.array(codes, pa.int64()),
                    "at": pa.array([a.tolist() for a, _ in rows], pa.list_(pa.int32())),
                    "share": pa.array([s.tolist() for _, s in rows], pa.list_(pa.float32())),
                })

    # At most ``trained`` hashes, or one per pattern, so their broadcast is bounded.
    sample = marked(docs).join(F.broadcast(chosen), "h", "left_semi").mapInArrow(
        run, "h bigint, pattern bigint, at array<int>, share array<float>"
    )
    # Copies of one document meet on the map side first.
    rows = sample.groupBy("h").agg(F.first(F.struct("pattern", "at", "share")).alias("r")).select("h", "r.*").toPandas().sort_values("h")
    target = np.array([belief[p] for p in rows["pattern"]])
    drawn = rows["pattern"].value_counts()
    stands = dict(zip(codes.tolist(), counts.tolist()))
    mass = np.array([(stands[p] / drawn[p]) ** 0.5 for p in rows["pattern"]])
    features = [(np.asarray(a, dtype=np.int64), np.asarray(s, dtype=np.float64)) for a, s in zip(rows["at"], rows["share"])]
    return Scorer.fit(features, target, mass), belief


def calibrated(scorer: Scorer, scored: DataFrame, labels: DataFrame, keep: float = KEEP) -> Scorer:
    """Threshold that keeps ``keep`` of the rows labelled good, 0.5 at most, lowered as far as it
    rejects no less labelled junk. Every labelled row counts."""
    marks = labels.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.min("quality").alias("quality"))
    known = scratch(scored.select("doc_id", "score").join(marks.filter("quality IS NOT NULL"), "doc_id").select("score", "quality"), "labelled-scores")
    good = known.filter("quality = 1")
    if n := good.count():
        most = min(0.5, nth_lowest(good, "score", int((n - 1) * (1 - keep))))
        caught = known.filter((F.col("quality") != 1) & (F.col("score") < most)).agg(F.max("score")).first()[0]
        scorer.threshold = most if caught is None else (most + caught) / 2
    return scorer


def quality_classifier(docs: DataFrame, labels: DataFrame, trained: int = TRAINED, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: doc_id, weak_label (posterior of its votes), score, kept.

    A document without words scores 0 and is rejected; null counts as empty. A null doc_id
    stays null, repeated rows score alike, an empty table gives none, and without labels the
    threshold is 0.5. Columns of ``keep`` (bigint) are carried along, others are ignored.
    """
    rows = texts(docs, *keep).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    patterns = scratch(voted(rows), "votes")
    scorer, belief = train(rows, patterns, trained)
    model = shipped(rows.sparkSession, (scorer, belief))

    def run(batches):
        scorer, belief = unpacked(model)
        for b in batches:
            values = utf8(b)
            for i, j in slices(values):
                weak = [belief[p] for p in votes(values[i:j]).tolist()]
                yield carried(b.slice(i, j - i), "doc_id", *keep, weak_label=pa.array(weak), score=pa.array(scorer.score(values[i:j])))

    scored = scratch(rows.mapInArrow(run, ", ".join(f"{c} bigint" for c in ("doc_id", *keep)) + ", weak_label double, score double"), "scores")
    threshold = calibrated(scorer, scored, labels).threshold
    return scored.withColumn("kept", (F.col("score") >= threshold) & (F.col("score") > 0))
