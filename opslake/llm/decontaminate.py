"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items that share a run of five words, a seed, are
compared: the longest run of words that both hold and that no tile covers yet
becomes a tile, again and again, as long as there is one of at least five
words.  Runs of equal length are found by their Karp-Rabin hashes and then
confirmed.  The share of an item's words under tiles is its coverage; as tiles
may lie anywhere, a reordered passage is covered as well.
"""

from __future__ import annotations

import re
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslake.functions.scratch import materialize
from opslake.llm.batches import bitmap, map_slices, share, texts, unused
from opslake.llm.shingles import WordHashes, shingles, windows, word_hashes

SEED_WORDS = 5
#: Share of an item's words that tiles must cover for a document to hold the item.
COVERAGE = 0.5
#: Seeds of the benchmark are marked in a bitmap of this many bits, whatever their number;
#: it only spares documents without any seed, the join decides.
BITMAP_BITS = 23

WORD = re.compile(r"\w+")

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _words(batch: list[str], memory: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    hashes, ends = word_hashes([WORD.findall(t.lower()) for t in batch], memory)
    hashes[hashes == 0] = 1  # 0 separates
    return hashes, ends


class _Prefixes:
    """Karp-Rabin hashes of any window of a row of words, from running sums."""

    def __init__(self, words: np.ndarray):
        self.words = words
        powers = np.full(len(words), _BASE, np.uint64)
        powers[:1] = 1
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * np.cumprod(powers), dtype=np.uint64)))
        back = np.full(len(words) + 1, _BACK, np.uint64)
        back[0] = 1
        self.back = np.cumprod(back)
        self.taken = words == 0

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash and place of every window of ``size`` words that no tile touches."""
        covered = np.concatenate(([0], np.cumsum(self.taken)))
        free = np.flatnonzero(covered[size:] == covered[: len(covered) - size])
        return (self.sums[free + size] - self.sums[free]) * self.back[free], free


def _match(item: _Prefixes, text: _Prefixes, size: int) -> tuple[int, int] | None:
    """The first window of the item that the text holds too, and the first place there."""
    mine, at = item.windows(size)
    theirs, where = text.windows(size)
    for k in np.flatnonzero(np.isin(mine, theirs)):
        for place in where[theirs == mine[k]]:
            if np.array_equal(item.words[at[k] : at[k] + size], text.words[place : place + size]):
                return int(at[k]), int(place)
    return None


def tiles(item: np.ndarray, text: np.ndarray, least: int = SEED_WORDS) -> list[tuple[int, int, int]]:
    """(place in the item, place in the text, words) of each tile, longest first; words of 0 match nothing."""
    a, b = _Prefixes(item), _Prefixes(text)
    found = []
    longest = min(len(item), len(text))
    while True:
        low, high, best = least, longest, None
        while low <= high:  # a shared run holds a shared run one word shorter
            size = (low + high) // 2
            if hit := _match(a, b, size):
                best, low = (*hit, size), size + 1
            else:
                high = size - 1
        if best is None:
            return found
        at, place, longest = best
        a.taken[at : at + longest] = True
        b.taken[place : place + longest] = True
        found.append(best)


def _seeds(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different seeds of a row of words, and how many of its words the places of each cover."""
    runs = windows(words, SEED_WORDS)
    order = np.argsort(runs, kind="stable")
    seeds, first = np.unique(runs[order], return_index=True)
    if not len(seeds):
        return seeds, np.zeros(0, np.int64)
    adds = np.minimum(np.diff(order, prepend=0), SEED_WORDS)  # what a place adds to the one before it
    adds[first] = SEED_WORDS
    return seeds, np.add.reduceat(adds, first)


def _items(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    held = share(benchmark.sparkSession, [])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not held.value:
            held.value.append(WordHashes())
        hashes, ends = _words(texts(batch, "text"), held.value[0])
        rows = [h.view(np.int64) for h in np.split(hashes, ends)[:-1]]
        found = [_seeds(r.view(np.uint64)) for r in rows]
        kind = pa.list_(pa.int64())
        return pa.RecordBatch.from_pydict(
            {
                "item_id": batch.column("item_id"),
                "words": pa.array(rows, kind),
                "seeds": pa.array([seeds.view(np.int64) for seeds, _ in found], kind),
                "covers": pa.array([covers for _, covers in found], kind),
            }
        )

    base = benchmark.select(F.col(id_col).cast("bigint").alias("item_id"), F.col(text_col).alias("text")).distinct()
    schema = "item_id bigint, words array<bigint>, seeds array<bigint>, covers array<bigint>"
    return map_slices(base, run, schema).where(f"size(words) >= {SEED_WORDS}")


def _seeded(docs: DataFrame, marks: np.ndarray) -> DataFrame:
    """Documents with a marked run: its seeds, and the stretches of words that these cover, apart by a 0.

    ``stretches`` names their content, so equal content is compared once.
    """
    held = share(docs.sparkSession, [marks])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        kit = held.value
        if len(kit) == 1:
            kit.extend((np.unpackbits(kit[0]).astype(bool), WordHashes()))
        hashes, ends = _words(texts(batch, "text"), kit[2])
        runs, of, place = shingles(hashes, ends, SEED_WORDS)
        hit = kit[1][runs >> np.uint64(64 - BITMAP_BITS)]
        runs, of, place = runs[hit], of[hit], place[hit]
        rows = np.unique(of)
        names, seeds, words = [], [], []
        for row in rows:
            mine = of == row
            starts, stop = place[mine], ends[row]
            covered = np.unique(np.minimum((starts[:, None] + np.arange(SEED_WORDS)).ravel(), stop - 1))
            cuts = np.flatnonzero(np.diff(covered) > 1) + 1
            stretch = np.insert(hashes[covered], cuts, 0)
            words.append(stretch.view(np.int64))
            seeds.append(np.unique(runs[mine]).view(np.int64))
            names.append(xxhash.xxh3_128_hexdigest(stretch.tobytes()))
        kind = pa.list_(pa.int64())
        return pa.RecordBatch.from_pydict(
            {
                "doc_id": batch.column("doc_id").take(pa.array(rows, pa.int64())),
                "stretches": pa.array(names, pa.string()),
                "seeds": pa.array(seeds, kind),
                "words": pa.array(words, kind),
            }
        )

    return map_slices(docs, run, "doc_id bigint, stretches string, seeds array<bigint>, words array<bigint>")


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    coverage: float = COVERAGE,
) -> DataFrame:
    """One row per document and benchmark item that it holds: ``doc_id``, ``item_id``, ``coverage``, ``tiles``, ``longest``.

    Words are runs of letters and digits, case aside.  Items of fewer than five
    words are passed over, as are null and empty texts.  Rows that share an id
    are looked at one by one and give one row with the highest coverage; rows
    without id come out under a null id.  Items that share an id likewise.
    Other columns are ignored.
    """
    items = materialize(_items(benchmark, item_id_col, item_text_col), "items")
    base = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    seeded = materialize(_seeded(base, bitmap(items.select(F.explode("seeds")), BITMAP_BITS)), "seeded")
    contents = materialize(
        seeded.groupBy("stretches").agg(F.any_value("seeds").alias("seeds"), F.any_value("words").alias("words")), "contents"
    )
    # Items are told apart by their words, which an id need not be enough for.
    named = items.select("item_id", "words", "seeds", "covers", F.xxhash64("words").alias("item"))
    # Stored before its join, or a seed that many texts hold would be one task of it.
    sought = materialize(
        named.select("item", F.size("words").alias("size"), F.explode(F.arrays_zip("seeds", "covers")).alias("of"))
        .select("item", "size", F.col("of.seeds").alias("seed"), F.col("of.covers").alias("cover"))
        .distinct(),
        "sought",
    )
    shared = (
        contents.select("stretches", F.explode("seeds").alias("seed"))
        .join(sought, "seed")
        .groupBy("stretches", "item")
        .agg(F.sum("cover").alias("most"), F.first("size").alias("size"))
        .where(F.col("most") >= coverage * F.col("size"))  # what these seeds can cover at most, wherever the item repeats them
    )
    sides = shared.join(contents.select("stretches", "words"), "stretches").join(
        named.select("item", F.col("words").alias("item_words")).groupBy("item").agg(F.any_value("item_words").alias("item_words")), "item"
    )

    def tile(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [
            (len(item), tiles(np.array(item, np.int64).view(np.uint64), np.array(text, np.int64).view(np.uint64)))
            for item, text in zip(batch.column("item_words").to_pylist(), batch.column("words").to_pylist(), strict=True)
        ]
        return pa.RecordBatch.from_pydict(
            {
                "stretches": batch.column("stretches"),
                "item": batch.column("item"),
                "coverage": pa.array([sum(t[2] for t in got) / size for size, got in found], pa.float64()),
                "tiles": pa.array([len(got) for _, got in found], pa.int32()),
                "longest": pa.array([max((t[2] for t in got), default=0) for _, got in found], pa.int32()),
            }
        )

    plain = sides.select("stretches", "item", "words", "item_words")
    tiled = map_slices(plain, tile, "stretches string, item bigint, coverage double, tiles int, longest int")
    kept = tiled.where(F.col("coverage") >= coverage)
    return (
        kept.join(seeded.select("doc_id", "stretches"), "stretches")
        .join(named.select("item_id", "item"), "item")
        .groupBy("doc_id", "item_id")
        .agg(F.max(F.struct("coverage", "tiles", "longest")).alias("best"))
        .select("doc_id", "item_id", "best.*")
    )


def remove(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that hold no benchmark item, with all their columns.

    Rows are decided by id and text, so of rows that share an id those without
    an item stay.  Rows without id stay.
    """
    plain = F.col(f"`{id_col}`").cast("bigint")
    name = F.xxhash64(plain, F.col(f"`{text_col}`"))
    found = contaminated(docs.where(plain.isNotNull()).select(name.alias("doc_id"), F.col(f"`{text_col}`").alias("text")), benchmark)
    held = unused(docs, "_held")
    gone = found.select(F.col("doc_id").alias(held)).distinct()
    return docs.join(gone, plain.isNotNull() & (name == F.col(held)), "left_anti")
