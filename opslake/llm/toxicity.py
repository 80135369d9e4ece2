"""Severity of toxic language by cumulative-link ordinal regression.

Features are sparse: which telling words and word beginnings a text holds, and
a step for how dense they are.  One set of weights serves all thresholds:
P(grade >= k) = logistic(w.x - t_k) with t_1 <= t_2 <= t_3.  The expected
severity is the sum of these probabilities, between 0 and 3.

Labels say only toxic or not, so the grades to learn from are 0 for clean texts
and, for toxic ones, the third of all toxic texts that their density of telling
terms falls into.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslake.llm.batches import map_slices, modest_sample, share, texts
from opslake.llm.quality import sure_labels

#: About so many labelled documents of each class are learned from; inputs with fewer give all.
SAMPLE_TOXIC, SAMPLE_CLEAN = 1500, 3000
#: Telling terms at most; how many toxic documents must hold one, and that number times its log-odds at least.
TERMS, LEAST_DOCUMENTS, LEAST_GAIN = 2000, 4, 12.0
BEGINNINGS = (4, 5, 6, 7)
GRADES = 3
#: Telling terms in a hundred words from which the next density step counts.
STEPS = (0.25, 0.5, 1.0, 2.0, 4.0, 8.0)
REMEMBERED_WORDS = 500_000

WORD = re.compile(r"\w+")


def terms_of(word: str) -> list[str]:
    """The word and its beginnings; a beginning ends with a mark no word holds."""
    return [word, *(word[:n] + "*" for n in BEGINNINGS if len(word) > n)]


class _Telling(dict):
    """For each word the numbers of its telling terms, or None."""

    def __init__(self, terms: Iterable[str]):
        self.number = {t: i for i, t in enumerate(terms)}

    def __missing__(self, word: str) -> tuple[int, ...] | None:
        if len(self) >= REMEMBERED_WORDS:
            self.clear()
        found = tuple(self.number[t] for t in terms_of(word) if t in self.number) or None
        self[word] = found
        return found


def features(text: str, telling: _Telling) -> tuple[list[int], float]:
    """The numbers of the features that a text has, and its telling words in a hundred."""
    words = WORD.findall(text.lower())
    hits = [f for w in words if (f := telling[w]) is not None]
    density = 100 * len(hits) / max(1, len(words))
    base = len(telling.number)
    held = sorted({i for f in hits for i in f})
    return held + [base + k for k, step in enumerate(STEPS) if hits and density >= step], density


@dataclass
class Model:
    terms: list[str] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(len(STEPS)))
    thresholds: np.ndarray = field(default_factory=lambda: np.full(GRADES, 30.0))

    def grades_from(self, held: list[int]) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, 3."""
        return 1 / (1 + np.exp(-np.clip(self.weights[held].sum() - self.thresholds, -30, 30)))


def fit_ordinal(rows: list[list[int]], grades: np.ndarray, size: int, steps: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Weights and rising thresholds by gradient steps on the cumulative log-likelihood, with a pull of weights to 0."""
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    of = np.array([i for r in rows for i in r], dtype=np.int64)
    reached = grades[:, None] >= np.arange(1, GRADES + 1)
    params = np.concatenate((np.zeros(size), [1.0], np.full(GRADES - 1, 0.0)))
    mean, square = np.zeros_like(params), np.zeros_like(params)
    share_of = np.where(grades > 0, 0.5 / max(1, (grades > 0).sum()), 0.5 / max(1, (grades == 0).sum()))
    for step in range(1, steps + 1):
        w, first, gaps = params[:size], params[size], np.exp(params[size + 1 :])
        thresholds = first + np.concatenate(([0.0], np.cumsum(gaps)))
        z = np.bincount(at, w[of], minlength=len(rows))
        p = 1 / (1 + np.exp(-np.clip(z[:, None] - thresholds, -30, 30)))
        error = (p - reached) * share_of[:, None]
        by_threshold = -error.sum(axis=0)
        gradient = np.concatenate(
            (
                np.bincount(of, error.sum(axis=1)[at], minlength=size) + 1e-5 * w,
                [by_threshold.sum()],
                [by_threshold[k:].sum() * gaps[k - 1] for k in range(1, GRADES)],
            )
        )
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.999 * square + 0.001 * gradient**2
        params -= 0.05 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    gaps = np.exp(params[size + 1 :])
    return params[:size], params[size] + np.concatenate(([0.0], np.cumsum(gaps)))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Learn from a bounded sample of the labelled documents outside the held-out fold.

    Labels other than 0 and 1, ids with contradicting labels and null ids are
    passed over.  Without labels of both classes every text is clean.
    """
    sure = sure_labels(labels, id_col, label_col)
    picked = modest_sample(sure.where("label = 1"), "doc_id", SAMPLE_TOXIC).union(
        modest_sample(sure.where("label = 0"), "doc_id", SAMPLE_CLEAN)
    )
    base = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    # The sample is bounded, so it goes to the documents; rows are bounded again for ids that repeat.
    chosen = base.join(F.broadcast(picked), "doc_id").select("label", "text").limit(4 * (SAMPLE_TOXIC + SAMPLE_CLEAN))

    def list_terms(batch: pa.RecordBatch) -> pa.RecordBatch:
        held = [list({t for w in set(WORD.findall(x.lower())) for t in terms_of(w)}) for x in texts(batch, "text")]
        return pa.RecordBatch.from_pydict({"label": batch.column("label"), "terms": pa.array(held, pa.list_(pa.string()))})

    listed = map_slices(chosen, list_terms, "label int, terms array<string>")
    number = {r.label: r["count"] for r in chosen.groupBy("label").count().collect()}
    if len(number) < 2:
        return Model()
    counted = (
        listed.select("label", F.explode("terms").alias("term"))
        .groupBy("term")
        .agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean"))
        .where(F.col("toxic") >= LEAST_DOCUMENTS)
    )
    odds = F.log((F.col("toxic") + 0.5) / number[1]) - F.log((F.col("clean") + 0.5) / number[0])
    best = (
        counted.select("term", (F.col("toxic") * odds).alias("gain"), odds.alias("odds"))
        .where(f"odds > 1.5 and gain >= {LEAST_GAIN}")
        .orderBy(F.desc("gain"), "term")
        .limit(TERMS)
    )
    terms = [r.term for r in best.collect()]
    held = share(docs.sparkSession, [terms])

    def list_features(batch: pa.RecordBatch) -> pa.RecordBatch:
        kit = held.value
        if len(kit) == 1:
            kit.append(_Telling(kit[0]))
        found = [features(x, kit[1]) for x in texts(batch, "text")]
        return pa.RecordBatch.from_pydict(
            {
                "label": batch.column("label"),
                "held": pa.array([f for f, _ in found], pa.list_(pa.int32())),
                "density": pa.array([d for _, d in found], pa.float64()),
            }
        )

    rows = map_slices(chosen, list_features, "label int, held array<int>, density double").collect()
    rows.sort(key=lambda r: (r.label, r.density, r.held))
    toxic = np.array([r.label == 1 for r in rows])
    density = np.array([r.density for r in rows])
    bounds = np.quantile(density[toxic], [k / GRADES for k in range(1, GRADES)])
    grades = np.where(toxic, 1 + np.searchsorted(bounds, density, side="right"), 0)
    weights, thresholds = fit_ordinal([list(r.held) for r in rows], grades, len(terms) + len(STEPS))
    return Model(terms, weights, thresholds)


def grade(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id``, ``toxic`` (P(grade >= 1) is at least 0.5), ``severity`` (expected, 0 to 3) and ``grade``.

    The grade is the highest that is at least as likely as not.  A null text
    counts as empty and has no feature.  Other columns are ignored.
    """
    held = share(docs.sparkSession, [model])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        kit = held.value
        if len(kit) == 1:
            kit.append(_Telling(kit[0].terms))
        chances = np.array([kit[0].grades_from(features(x, kit[1])[0]) for x in texts(batch, "text")]).reshape(-1, GRADES)
        grades = (chances >= 0.5).sum(axis=1)
        return pa.RecordBatch.from_pydict(
            {
                "doc_id": batch.column("doc_id"),
                "toxic": pa.array(grades >= 1),
                "severity": pa.array(chances.sum(axis=1)),
                "grade": pa.array(grades.astype(np.int32)),
            }
        )

    base = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return map_slices(base, run, "doc_id bigint, toxic boolean, severity double, grade int")
