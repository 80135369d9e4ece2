"""Quality by compression: which of two dictionaries packs a text better.

One zstandard dictionary is trained from good labelled text, one from bad.
A text is cut into pieces of a fixed size, every piece is packed with either
dictionary, and the difference of the summed sizes, as a share of the text's
bytes, becomes a probability by a logistic fit on labelled texts that neither
dictionary has seen.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opslake.functions.scratch import materialize, remove
from opslake.llm.batches import map_slices, modest_sample, share, texts

#: About so many labelled documents of each class are learned from; inputs with fewer give all.
SAMPLE_ROWS = 4000
#: Of these, whole texts are taken in the order of a hash until so many bytes of a class are reached; a quarter of the
#: texts calibrates, all pieces of the others teach.
SAMPLE_BYTES = 8 << 20
PIECE_BYTES = 1024
DICTIONARY_BYTES = 112_640
LEVEL = 3
#: Pieces that the dictionaries need at least; with fewer, the pieces themselves are the dictionary.
LEAST_PIECES = 200
FOLDS, HELD_OUT = 3, 1


def held_out(id_col: str, folds: int = FOLDS, fold: int = HELD_OUT) -> Column:
    """Whether a row is kept from learning: crc32 of its id as text; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == fold


@dataclass
class Model:
    """Two dictionaries and the line that turns a size difference into log-odds."""

    good: bytes
    bad: bytes
    raw_good: bool
    raw_bad: bool
    slope: float
    middle: float

    def packers(self) -> list[zstandard.ZstdCompressor]:
        made = []
        for content, raw in ((self.good, self.raw_good), (self.bad, self.raw_bad)):
            kind = zstandard.DICT_TYPE_RAWCONTENT if raw else zstandard.DICT_TYPE_FULLDICT
            held = zstandard.ZstdCompressionDict(content, dict_type=kind)
            held.precompute_compress(level=LEVEL)
            made.append(
                zstandard.ZstdCompressor(
                    level=LEVEL, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False
                )
            )
        return made

    def score(self, difference: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * difference + self.middle, -500, 500)))


def size_difference(text: str, packers: list[zstandard.ZstdCompressor]) -> float:
    """Bytes that the good dictionary saves against the bad one, as a share of the text; 0 for an empty text."""
    data = text.encode("utf-8", "replace")
    good, bad = (p.compress for p in packers)
    saved = 0
    for at in range(0, len(data), PIECE_BYTES):
        piece = data[at : at + PIECE_BYTES]
        saved += len(bad(piece)) - len(good(piece))
    return saved / max(1, len(data))


def _dictionary(pieces: list[bytes], raw: bool) -> bytes:
    if raw:
        return b"".join(pieces)[:DICTIONARY_BYTES] or b" "
    return zstandard.train_dictionary(DICTIONARY_BYTES, pieces).as_bytes()


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Newton steps on log-odds = slope * x + middle, with a slight pull of the slope towards 0."""
    scale = x.std() or 1.0
    a = np.column_stack((x / scale, np.ones(len(x))))
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        pull = np.array([1e-3, 1e-6]) * len(x)
        gradient = a.T @ (weight * (y - p)) - pull * w
        hessian = (a * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ a + np.diag(pull)
        step = np.linalg.solve(hessian, gradient)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def sure_labels(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """``doc_id`` and ``label`` (0 or 1) of the documents to learn from: not held out, labelled alike wherever labelled."""
    plain = labels.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    return (
        plain.where("doc_id is not null and label in (0, 1)")
        .where(~held_out("doc_id"))
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"), F.max("label").alias("other"))
        .where("label = other")
        .select("doc_id", "label")
    )


def _within(rows: DataFrame, most: int) -> DataFrame:
    """``label`` and ``upto``, the hash up to which the texts of a class add up to ``most`` bytes (its first one at least)."""
    running = F.sum("bytes").over(Window.partitionBy("label").orderBy("order").rowsBetween(Window.unboundedPreceding, -1))
    known = rows.select("label", "order", F.coalesce("bytes", F.lit(0)).cast("bigint").alias("bytes"))
    return known.withColumn("before", F.coalesce(running, F.lit(0))).where(F.col("before") < most).groupBy("label").agg(F.max("order").alias("upto"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Learn from a bounded sample of the labelled documents outside the held-out fold: whole texts, SAMPLE_ROWS and
    SAMPLE_BYTES at most of each class.

    Labels other than 0 and 1, ids with contradicting labels and null ids are
    passed over.  With labels of one class only the score is that class for all
    texts, without any it is 0.5.
    """
    spark = docs.sparkSession
    sure = sure_labels(labels, id_col, label_col)
    count = {r.label: r["count"] for r in sure.groupBy("label").count().collect()}
    if len(count) < 2:
        return Model(b" ", b" ", True, True, 0.0, {1: 500.0, 0: -500.0}[next(iter(count))] if count else 0.0)
    picked = modest_sample(sure.where("label = 1"), "doc_id", SAMPLE_ROWS).union(
        modest_sample(sure.where("label = 0"), "doc_id", SAMPLE_ROWS)
    )
    base = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    # The sample is bounded, so it goes to the documents.
    order = F.xxhash64("doc_id", "text", F.lit(3))
    found = base.join(F.broadcast(picked), "doc_id").select("label", "text", order.alias("order"), F.octet_length("text").alias("bytes"))
    sampled = materialize(found, "labelled")
    least = _within(sampled.select("label", "order", "bytes").distinct(), SAMPLE_BYTES)
    # Equal texts of an id are one; what is over the bound is one text at most.
    chosen = sampled.dropDuplicates(["label", "order"]).join(F.broadcast(least), "label").where("order <= upto")
    chosen = chosen.select("label", "text", (F.pmod("order", F.lit(4)) == 0).alias("calibrates"))

    def teach(group: pa.Table) -> pa.Table:
        pieces = []
        for text in texts(group, "text"):
            data = text.encode("utf-8", "replace")
            pieces += [data[at : at + PIECE_BYTES] for at in range(0, len(data), PIECE_BYTES)]
        pieces.sort()
        raw = len(pieces) < LEAST_PIECES
        made = {"label": [group.column("label")[0].as_py()], "raw": [raw], "dictionary": [_dictionary(pieces, raw)]}
        return pa.table(made, pa.schema([("label", pa.int32()), ("raw", pa.bool_()), ("dictionary", pa.binary())]))

    # Texts teach in a task; only the dictionaries come to the driver.
    taught = chosen.where("not calibrates").select("label", "text").groupBy("label")
    got = {r.label: r for r in taught.applyInArrow(teach, "label int, raw boolean, dictionary binary").collect()}
    plain = {label: (bytes(got[label].dictionary), got[label].raw) if label in got else (b" ", True) for label in (0, 1)}
    model = Model(plain[1][0], plain[0][0], plain[1][1], plain[0][1], 1.0, 0.0)

    held = share(spark, [model])
    rows = _differences(chosen.where("calibrates").select("label", "text"), held, "label", "int").collect()
    if {r.label for r in rows} != {0, 1}:
        # Too few texts to set some aside: those that taught calibrate.
        rows = _differences(chosen.select("label", "text"), held, "label", "int").collect()
    held.destroy()
    remove(sampled)
    x = np.array([r.difference for r in rows])
    y = np.array([r.label for r in rows], float)
    if len(set(y)) < 2:
        model.slope, model.middle = 50.0, 0.0
        return model
    # Each class weighs as it does among all labels.
    weight = np.where(y == 1, count[1] / max(1, (y == 1).sum()), count[0] / max(1, (y == 0).sum()))
    model.slope, model.middle = _logistic(x, y, weight * len(y) / weight.sum())
    return model


def _differences(rows: DataFrame, held, key: str, kind: str) -> DataFrame:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        kit = held.value
        if len(kit) == 1:
            kit.append(kit[0].packers())
        found = [size_difference(text, kit[1]) for text in texts(batch, "text")]
        return pa.RecordBatch.from_pydict({key: batch.column(key), "difference": pa.array(found, pa.float64())})

    return map_slices(rows, run, f"{key} {kind}, difference double")


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id``, ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on).

    A null text counts as empty; an empty text scores as one that both
    dictionaries pack alike.  Other columns are ignored.
    """
    base = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    found = _differences(base, share(docs.sparkSession, [model]), "doc_id", "bigint")
    line = F.greatest(F.lit(-500.0), F.least(F.lit(500.0), F.col("difference") * model.slope + model.middle))
    return found.select("doc_id", (1 / (1 + F.exp(-line))).alias("score")).withColumn(
        "predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0)
    )


def keep_good(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows whose text scores 0.5 or more, with all their columns."""
    held = share(docs.sparkSession, [model])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        kit = held.value
        if len(kit) == 1:
            kit.append(kit[0].packers())
        found = np.array([size_difference(text, kit[1]) for text in texts(batch, place)])
        return batch.filter(pa.array(kit[0].score(found) >= 0.5))

    # Names of any kind, dots included, stay outside of the tasks.
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    place = f"c{docs.columns.index(text_col)}"
    return map_slices(plain, run, plain.schema).toDF(*docs.columns)
