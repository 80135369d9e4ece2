"""Language by hyperdimensional profiles.

Every letter has a fixed random vector of +1 and -1.  A run of three letters
binds theirs, the first shifted twice and the second once, by multiplication.
A text bundles the vectors of its runs by addition, a language bundles the
texts known to be in it, and a text belongs to the language whose bundle has
the highest cosine with its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslake.llm.batches import map_slices, share, slices, texts
from opslake.llm.quality import held_out

DIMENSIONS = 512
#: Kinds of runs that are bound at once.
KINDS = 16_384
FOLDS, HELD_OUT = 5, 0
UNKNOWN = "und"
#: Sign 0 stands between words, a to z have signs of their own, other letters share the rest by a hash.
SIGNS = 128


class Letters:
    """The sign of every code point, and the vector of every sign."""

    def __init__(self, dimensions: int = DIMENSIONS):
        self.sign = np.zeros(0x110000, np.int32)
        for point in range(0x110000):
            letter = chr(point)
            if "a" <= letter <= "z":
                self.sign[point] = point - 96
            elif letter.isalpha():
                self.sign[point] = 27 + (point * 2654435761 % 2**32) % (SIGNS - 27)
        plain = np.random.default_rng(20).choice(np.array([-1, 1], np.int8), (SIGNS, dimensions))
        self.shifted = [np.roll(plain, 2 - k, axis=1) for k in range(3)]
        self.dimensions = dimensions

    def bundles(self, batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The bundle of every text, one row each, and whether the text has a letter."""
        points = [np.frombuffer(t.lower().encode("utf-32-le", "replace"), np.uint32) for t in batch]
        gap = np.zeros(1, np.uint32)
        signs = self.sign[np.concatenate([x for p in points for x in (gap, p, gap)])]
        sizes = np.array([len(p) + 2 for p in points])
        text = np.repeat(np.arange(len(batch)), sizes)
        run = (signs[:-2] * SIGNS + signs[1:-1]) * SIGNS + signs[2:]
        real = (signs[1:-1] > 0) & (text[:-2] == text[2:])
        run, text = run[real], text[1:-1][real]
        bundle = np.zeros((len(batch), self.dimensions), np.float32)
        present = np.zeros(SIGNS**3, bool)
        present[run] = True
        kinds = np.flatnonzero(present)
        place = np.zeros(SIGNS**3, np.int32)
        place[kinds] = np.arange(len(kinds))
        kind = place[run]
        # Block by block, as a text in many letters has many kinds of runs.
        order = np.argsort(kind, kind="stable") if len(kinds) > KINDS else None
        for low in range(0, len(kinds), KINDS):
            some = kinds[low : low + KINDS]
            if order is None:
                of, texts_of = kind, text
            else:
                mine = order[np.searchsorted(kind, low, sorter=order) : np.searchsorted(kind, low + KINDS, sorter=order)]
                of, texts_of = kind[mine] - low, text[mine]
            counts = np.bincount(texts_of * len(some) + of, minlength=len(batch) * len(some))
            first, second, third = some // SIGNS**2, some // SIGNS % SIGNS, some % SIGNS
            bound = self.shifted[0][first] * self.shifted[1][second] * self.shifted[2][third]
            bundle += counts.reshape(len(batch), len(some)).astype(np.float32) @ bound.astype(np.float32)
        return bundle, np.bincount(text, minlength=len(batch)) > 0


def _unit(rows: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(size == 0, 1, size)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """The bundle of every language, from all rows outside the held-out fold.

    Bundles add up, so a task sends one for each language it has met, however
    rare.  Each text weighs the same.  Rows without language or letters are passed over.
    """
    base = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")
    )
    known = base.where("lang is not null and doc_id is not null").where(~held_out("doc_id", FOLDS, HELD_OUT))
    held = share(docs.sparkSession, [])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not held.value:
            held.value.append(Letters())
        sums: dict[str, np.ndarray] = {}
        for part in slices(batches):
            bundle, _ = held.value[0].bundles(texts(part, "text"))
            langs = np.array(part.column("lang").to_pylist(), dtype=object)
            for lang in set(langs):
                sums[lang] = sums.get(lang, 0) + _unit(bundle[langs == lang]).sum(axis=0, dtype=np.float64)
        for lang, total in sums.items():
            yield pa.RecordBatch.from_pydict(
                {
                    "lang": pa.array([lang] * DIMENSIONS, pa.string()),
                    "place": pa.array(np.arange(DIMENSIONS), pa.int32()),
                    "part": pa.array(np.rint(total * 1e6).astype(np.int64)),  # whole numbers add up the same in any order
                }
            )

    parts = known.select("text", "lang")
    summed = parts.mapInArrow(gather, "lang string, place int, part bigint").groupBy("lang", "place").agg(F.sum("part").alias("part"))
    found: dict[str, np.ndarray] = {}
    for row in summed.collect():
        found.setdefault(row.lang, np.zeros(DIMENSIONS))[row.place] = row.part / 1e6
    return {lang: vector for lang, vector in sorted(found.items()) if vector.any()}


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id``, ``lang_pred`` and ``score``, the cosine, at least 0.

    Texts that are null or have no letter, and all texts where no language was
    learned, are ``und`` with score 0.  Of equal cosines the language first by
    name counts.  Other columns are ignored.
    """
    held = share(docs.sparkSession, [list(profiles), np.array([*profiles.values()], np.float64).reshape(-1, DIMENSIONS)])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        kit = held.value
        if len(kit) == 2:
            kit.extend((Letters(), _unit(kit[1])))
        names, _, letters, prototypes = kit
        bundle, lettered = letters.bundles(texts(batch, "text"))
        if names:
            cosine = _unit(bundle.astype(np.float64)) @ prototypes.T
            best = cosine.argmax(axis=1)
            score = np.clip(cosine[np.arange(len(best)), best], 0, 1)
        else:
            lettered = np.zeros(batch.num_rows, bool)
        return pa.RecordBatch.from_pydict(
            {
                "doc_id": batch.column("doc_id"),
                "lang_pred": pa.array([names[best[i]] if lettered[i] else UNKNOWN for i in range(batch.num_rows)], pa.string()),
                "score": pa.array([float(score[i]) if lettered[i] else 0.0 for i in range(batch.num_rows)], pa.float64()),
            }
        )

    base = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return map_slices(base, run, "doc_id bigint, lang_pred string, score double")
