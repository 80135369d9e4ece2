"""Phrase collocations by Rabin-Karp fingerprints of every run of one to five words.

1. numpy prefix polynomials over bytes give a fingerprint of every word, prefix
   polynomials over words one of every run of words.  A shuffle adds up the
   fingerprints of one length, with a pointer to a text that holds the run and
   bits of a second fingerprint.
2. A run can only be frequent when both runs of one word less in it are.  A
   bitmap of fixed size passes these, so rarer runs are left out before the
   shuffle.  The bitmap only spares rows: counts decide.
3. Where the second fingerprints differ, several runs share the first; they are
   counted again by their words in the texts.
4. Pointers of frequent fingerprints are followed to their texts, and only
   there words are cut out.  From here on everything is joined by phrase.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opslake.functions.scratch import materialize
from opslake.llm.batches import bitmap, keep_marked, share, slices
from opslake.llm.polynomials import BYTES, prefixes, stretch, utf8
from opslake.llm.shingles import mix

WORDS = 5
OCCURRENCES = 100
SCALE = 1000
#: A phrase goes when a longer one around it has this share of its occurrences, in hundredths.
COVERED = 100
TOP = 2000
NO_LANG = "und"
#: Bits of the bitmap that spares rows.
BITMAP_BITS = 25
#: Bytes of a long text that are split together.
PIECE = 1 << 20
#: Runs that a task adds up at once.
TOGETHER = 1 << 20
#: Bits of the second fingerprint and of the hash of a text that travel with a fingerprint.
_SECOND_BITS, _POINTER_BITS = 14, 28
#: Bits kept of a fingerprint; fewer only in tests, which need collisions.
FINGERPRINT_BITS = 64

_WORD, _BLANK, _BREAK = 0, 1, 2
_KINDS = np.zeros(256, np.uint8)
_KINDS[[0x20, 0x09]] = _BLANK
_KINDS[[ord(c) for c in ".,;:!?"]] = _BREAK
_KINDS[0x0A:0x0E] = _BREAK
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


class Words:
    """Words of a stretch of texts: fingerprint, number of the piece, number of the text, place of the bytes."""

    def __init__(self, hashes, piece, text, start, stop, own=None):
        self.hashes, self.piece, self.text, self.start, self.stop = hashes, piece, text, start, stop
        #: Runs that start at the first so many words belong to this stretch.
        self.own = len(hashes) if own is None else own

    def cut(self, low: int, high: int) -> tuple:
        return tuple(c[low:high] for c in (self.hashes, self.piece, self.text, self.start, self.stop))


def _words_of(data: np.ndarray, ends: np.ndarray, base: int, piece: int, text: int) -> tuple:
    kinds = _KINDS[data]
    inside = kinds == _WORD
    before = np.append(False, inside[:-1])
    borders = ends[:-1]
    at_border = np.zeros(len(data) + 1, bool)
    at_border[borders] = True
    at_border = at_border[:-1]
    start = np.flatnonzero(inside & (~before | at_border))
    after = np.append(inside[1:], False)
    closes = np.append(at_border[1:], True)
    stop = np.flatnonzero(inside & (~after | closes)) + 1
    breaks = np.cumsum((kinds == _BREAK).astype(np.int32) + at_border, dtype=np.int64)
    sums = prefixes(BYTES[data])
    size = (stop - start).astype(np.uint64)
    hashes = mix(stretch(sums, start, stop) + size * np.uint64(0x8EBC6AF09C88C6E3))
    of = np.searchsorted(ends, start, side="right") + text
    return hashes, breaks[start] + piece, of, start + base, stop + base


def words_of(data: np.ndarray, ends: np.ndarray) -> Iterator[Words]:
    """The words of lower-case texts; a long text comes in stretches that overlap by the words a run may reach."""
    if len(ends) > 1 or len(data) <= 2 * PIECE:
        yield Words(*_words_of(data, ends, 0, 0, 0))
        return
    held, low = None, 0
    while low < len(data):
        high = low + PIECE
        while high < len(data):  # a stretch ends where a word does
            gap = np.flatnonzero(_KINDS[data[high : high + PIECE]] != _WORD)
            if len(gap):
                high += int(gap[0])
                break
            high += PIECE
        high = min(high, len(data))
        piece = int(held[1][-1]) if held is not None and len(held[1]) else 0
        part = data[low:high]
        new = _words_of(part, np.array([len(part)]), low, piece, 0)
        if held is not None:
            # Breaks between the last word before and the first one here lie in this stretch or after that word.
            gap = data[int(held[4][-1]) : low] if len(held[4]) else data[:0]
            more = int((_KINDS[gap] == _BREAK).sum())
            new = (new[0], new[1] + more, *new[2:])
            new = tuple(np.concatenate(pair) for pair in zip(held, new, strict=True))
        last = high >= len(data)
        found = Words(*new)
        found.own = len(found.hashes) if last else max(0, len(found.hashes) - (WORDS - 1))
        yield found
        held = found.cut(found.own, len(found.hashes))
        if not len(held[0]) and not last:
            held = None
        low = high


def runs(words: Words, lang: np.ndarray, number: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, fingerprint and second fingerprint of every run of ``number`` words that starts in the stretch.

    ``lang``: a hash for each text; runs of different languages differ.
    """
    total = len(words.hashes) - number + 1
    at = np.arange(max(0, min(total, words.own)))
    if number > 1:
        at = at[words.piece[at + number - 1] == words.piece[at]]
    if not len(at):
        return at, np.empty(0, np.uint64), np.empty(0, np.uint64)
    of = lang[words.text[at]] + np.uint64(number)
    first = mix(stretch(prefixes(words.hashes), at, at + number) + mix(of))
    second = mix(stretch(prefixes(mix(words.hashes + np.uint64(0x5851F42D4C957F2D))), at, at + number) ^ mix(of + np.uint64(99)))
    if FINGERPRINT_BITS < 64:
        first = mix(first >> np.uint64(64 - FINGERPRINT_BITS))
    return at, first, second


def _marked(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = hashes >> np.uint64(64 - (len(bits).bit_length() + 2))
    return (bits[place >> np.uint64(3)] >> (np.uint8(7) - (place & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)


def _packed(n: np.ndarray, second: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Occurrences, bits of the second fingerprint and of the pointer in 64 bits, as these rows are the bulk of a shuffle."""
    return (n.astype(np.uint64) << np.uint64(_SECOND_BITS + _POINTER_BITS)) | (second << np.uint64(_POINTER_BITS)) | at


class _Adder:
    """Adds up equal fingerprints in blocks of bounded size."""

    def __init__(self) -> None:
        self.held: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, fp: np.ndarray, second: np.ndarray, at: np.ndarray) -> None:
        self.held.append((fp, second >> np.uint64(64 - _SECOND_BITS), at))
        self.size += len(fp)

    def flush(self) -> pa.RecordBatch:
        fp, second, at = (np.concatenate(c) for c in zip(*self.held, strict=True))
        self.held, self.size = [], 0
        order = np.argsort(fp, kind="stable")
        fp, second, at = fp[order], second[order], at[order]
        first = np.flatnonzero(np.append(True, fp[1:] != fp[:-1]))
        n, fp = np.diff(first, append=len(fp)), fp[first]
        low, high, at = np.minimum.reduceat(second, first), np.maximum.reduceat(second, first), np.minimum.reduceat(at, first)
        # Where several runs share a fingerprint, one occurrence brings the other second fingerprint.
        apart = low != high
        packed = np.concatenate((_packed(n - apart, low, at), _packed(np.ones(apart.sum(), np.int64), high[apart], at[apart])))
        fp = np.concatenate((fp, fp[apart]))
        return pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64)), pa.array(packed.view(np.int64))], names=["fp", "packed"])


def _prepared(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data, ends = utf8(part.column("text"))
    lang = part.column("lang_hash").to_numpy(zero_copy_only=False).view(np.uint64)
    return _LOWER[data], ends, lang, part.column("at").to_numpy(zero_copy_only=False)


def _counted(texts: DataFrame, number: int, shorter: np.ndarray | None) -> DataFrame:
    """Frequent fingerprints of runs of ``number`` words: occurrences ``n``, the least and greatest second fingerprint
    ``low`` and ``high``, and a pointer ``at`` to a text; ``shorter`` marks the frequent ones of one word less.

    Runs of one word bring a row for each language, its number of words under the language's own hash.
    """
    held = share(texts.sparkSession, shorter)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, sums = held.value, _Adder()
        for part in slices(batches):
            data, ends, lang, at = _prepared(part)
            pointer = at.view(np.uint64) & np.uint64((1 << _POINTER_BITS) - 1)
            for words in words_of(data, ends):
                place, first, second = runs(words, lang, number)
                if bits is not None and len(place):
                    parts = _marked_runs(words, lang, number, bits)
                    keep = parts[place] & parts[place + 1]
                    place, first, second = place[keep], first[keep], second[keep]
                of = words.text[place]
                sums.add(first, second, pointer[of])
                if bits is None:
                    sums.add(lang[of], np.zeros(len(of), np.uint64), np.zeros(len(of), np.uint64))
                if sums.size >= TOGETHER:
                    yield sums.flush()
        if sums.size:
            yield sums.flush()

    # Tasks have added up already: dealt out as they are, rows are half as wide as those of an aggregate.
    dealt = texts.mapInArrow(run, "fp bigint, packed bigint").repartition("fp")
    parts = dealt.selectExpr(
        "fp",
        f"shiftrightunsigned(packed, {_SECOND_BITS + _POINTER_BITS}) as n",
        f"shiftrightunsigned(packed, {_POINTER_BITS}) & {(1 << _SECOND_BITS) - 1}L as second",
        f"packed & {(1 << _POINTER_BITS) - 1}L as at",
    )
    total = parts.groupBy("fp").agg(
        F.sum("n").alias("n"), F.min("second").alias("low"), F.max("second").alias("high"), F.min("at").alias("at")
    )
    return total.where(F.col("n") >= OCCURRENCES)


def _marked_runs(words: Words, lang: np.ndarray, number: int, bits: np.ndarray) -> np.ndarray:
    """At which words of the stretch a marked run of one word less starts."""
    whole = Words(words.hashes, words.piece, words.text, words.start, words.stop)
    place, first, _ = runs(whole, lang, number - 1)
    marked = np.zeros(len(words.hashes) + 1, bool)
    marked[place] = _marked(bits, first)
    return marked


def _spelled(data: np.ndarray, words: Words, at: int, number: int) -> str:
    pieces = [data[words.start[k] : words.stop[k]].tobytes() for k in range(at, at + number)]
    return b" ".join(pieces).decode("utf-8", "replace")


def _followed(texts: DataFrame, frequent: DataFrame) -> DataFrame:
    """``lang``, ``phrase``, ``words`` and ``n`` of fingerprints of one run, from the texts that their pointers name."""
    pointers = materialize(frequent.where("low = high").select("at", "fp", "number", "n"), "pointers")
    listed = pointers.groupBy("at").agg(F.collect_list(F.struct("fp", "number", "n")).alias("wanted"))
    named = texts.withColumn("text_hash", F.col("at")).withColumn("at", F.expr(f"at & {(1 << _POINTER_BITS) - 1}L"))
    near = keep_marked(
        named.withColumn("hash", F.xxhash64("at")), bitmap(pointers.select(F.xxhash64("at").alias("hash")), BITMAP_BITS), "hash"
    )
    # One of the equal texts of a language is enough; a text that only shares the pointer's bits has no such run.
    rows = near.dropDuplicates(["text_hash"]).select("at", "lang", "lang_hash", "text").join(listed, "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            for k in range(part.num_rows):
                one = part.slice(k, 1)
                data, ends, lang, _ = _prepared(one)
                wanted = one.column("wanted")[0].values
                fps, numbers, counts = (wanted.field(c).to_numpy() for c in ("fp", "number", "n"))
                found = []
                for words in words_of(data, ends):
                    for number in np.unique(numbers).tolist():
                        mine = numbers == number
                        ask, times = fps[mine].view(np.uint64), counts[mine]
                        place, first, _ = runs(words, lang, number)
                        known, index = np.unique(first, return_index=True)
                        spot = np.minimum(np.searchsorted(known, ask), max(len(known) - 1, 0))
                        hit = np.flatnonzero(known[spot] == ask) if len(known) else []
                        found += [(_spelled(data, words, int(place[index[spot[h]]]), number), number, int(times[h]), int(ask[h].view(np.int64))) for h in hit]
                kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64())
                columns = [pa.array([f[c] for f in found], kind) for c, kind in enumerate(kinds)]
                name = one.column("lang")[0].as_py()
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), *columns], names=["lang", "phrase", "words", "n", "fp"])

    spelled = rows.select("at", "lang", "lang_hash", "text", "wanted").mapInArrow(run, "lang string, phrase string, words int, n bigint, fp bigint")
    return spelled.dropDuplicates(["fp", "words"]).drop("fp")  # a long text may show a run in several stretches


def _counted_again(texts: DataFrame, collided: DataFrame) -> DataFrame:
    """The frequent runs behind fingerprints that several runs share, counted by their words."""
    marks = share(texts.sparkSession, bitmap(collided.select("fp"), BITMAP_BITS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            data, ends, lang, _ = _prepared(part)
            names = part.column("lang").to_pylist()
            for words in words_of(data, ends):
                counts: dict[tuple, int] = {}
                for number in range(1, WORDS + 1):
                    place, first, _ = runs(words, lang, number)
                    for k in np.flatnonzero(_marked(marks.value, first)).tolist():
                        at = int(place[k])
                        key = (names[words.text[at]], _spelled(data, words, at, number), number, int(first[k].view(np.int64)))
                        counts[key] = counts.get(key, 0) + 1
                kinds = (pa.string(), pa.string(), pa.int32(), pa.int64())
                columns = [pa.array([key[c] for key in counts], kind) for c, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(counts.values(), pa.int64())], names=["lang", "phrase", "words", "fp", "n"])

    schema = "lang string, phrase string, words int, fp bigint, n bigint"
    added = texts.mapInArrow(run, schema).groupBy("lang", "phrase", "words", "fp").agg(F.sum("n").alias("n"))
    return added.where(F.col("n") >= OCCURRENCES).join(collided, ["fp", "words"], "left_semi").drop("fp")


def frequent_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """Runs of one to five words with at least OCCURRENCES occurrences in a language (``lang``, ``phrase``, ``words``,
    ``n``), and the number of words of every language that has so many (``lang``, ``total``)."""
    lang = F.coalesce(F.col(f"`{lang_col}`"), F.lit(NO_LANG))
    named = docs.select(lang.alias("lang"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    texts = named.select("lang", "text", F.xxhash64("lang").alias("lang_hash"), F.xxhash64("lang", "text").alias("at"))
    levels, marks = [], None
    for number in range(1, WORDS + 1):
        found = materialize(_counted(texts.select("text", "lang_hash", "at"), number, marks), f"runs-{number}")
        levels.append(found.withColumn("number", F.lit(number)))
        if number < WORDS:
            marks = bitmap(found.select("fp"), BITMAP_BITS)
    langs = materialize(named.select("lang").distinct(), "langs")
    sizes = levels[0].select(F.col("fp").alias("hash"), F.col("n").alias("total"))
    total = langs.join(sizes, F.xxhash64("lang") == F.col("hash")).drop("hash")
    every = levels[0]
    for level in levels[1:]:
        every = every.union(level)
    runs_only = every.join(langs.select(F.xxhash64("lang").alias("fp")), "fp", "left_anti")
    collided = materialize(runs_only.where("low <> high").select("fp", F.col("number").alias("words")), "collided")
    spelled = _followed(texts, runs_only)
    if not collided.isEmpty():
        spelled = spelled.union(_counted_again(texts, collided).select("lang", "phrase", "words", "n"))
    return materialize(spelled, "phrases"), materialize(total, "totals")


def _part(words, start, size):
    return F.array_join(F.slice(words, start, size), " ")


def score(a: str, left: str, right: str, total: str) -> Column:
    """``floor(SCALE * a * total / (left * right))``, exact beyond 64 bits."""
    wide = {c: f"cast({c} as decimal(19,0))" for c in (a, left, right, total)}
    return F.expr(f"(cast({SCALE} * {wide[a]} as decimal(38,0)) * {wide[total]}) div ({wide[left]} * {wide[right]})")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", top: int = TOP) -> DataFrame:
    """``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n`` and ``score`` of the best phrases of every language.

    Texts are lower-cased in A to Z, split at ``. , ; : ! ?`` and line breaks
    into pieces and those at blanks and tabs into words.  A phrase has two to
    five words and at least OCCURRENCES occurrences ``a``, overlapping ones
    included.  Cut in two parts with ``l`` and ``r`` occurrences it scores
    ``floor(SCALE * a * n / (l * r))``, where ``n`` is the number of words of the
    language; the lowest cut counts, of equal ones the first.  Phrases within a
    longer one as frequent as they are fall out.  Of equal scores the more
    frequent phrase is better, then the one smaller in byte order.

    Null and empty texts hold no words.  A null language is ``und``.  Repeated
    rows count as often as they occur.  Words of any length are whole.  Other
    columns are ignored.
    """
    every, total = frequent_phrases(docs, text_col, lang_col)
    words = F.split("phrase", " ")
    longer = every.where("words > 2").select("lang", "n", "words", words.alias("w"))
    inner = longer.select(
        "lang",
        "n",
        F.explode(
            F.flatten(
                F.transform(
                    F.sequence(F.lit(2), F.col("words") - 1),
                    lambda size: F.transform(F.sequence(F.lit(1), F.col("words") - size + 1), lambda at: _part(F.col("w"), at, size)),
                )
            )
        ).alias("phrase"),
    )
    around = materialize(inner.groupBy("lang", "phrase").agg(F.max("n").alias("around")), "around")
    candidates = (
        every.where("words > 1")
        .join(around, ["lang", "phrase"], "left")
        .where(F.expr(f"around is null or 100 * around < {COVERED} * n"))
        .select("lang", "phrase", F.col("n").alias("a"), "words", words.alias("w"))
    )
    cuts = candidates.select(
        "lang", "phrase", "a", "w", "words", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")
    ).select("lang", "phrase", "a", "k", _part(F.col("w"), 1, F.col("k")).alias("left"), _part(F.col("w"), F.col("k") + 1, F.col("words") - F.col("k")).alias("right"))
    left = every.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l"))
    right = every.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r"))
    # A word such as an article is the left part of a large share of all phrases: each join is split by itself.
    with_left = materialize(cuts.join(left, ["lang", "left"]), "left-parts")
    with_both = materialize(with_left.join(right, ["lang", "right"]), "both-parts")

    scored = with_both.join(total, "lang").withColumn("score", score("a", "l", "r", "total"))
    lowest = scored.groupBy("lang", "phrase", "a", "total").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = lowest.select("lang", "phrase", "a", F.col("total").alias("n"), "cut.score", "cut.l", "cut.r").withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= top).select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
