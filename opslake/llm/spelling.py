"""Grouping of spelling variants by a relational trie whose frontier advances level by level.

Words are counted in the texts.  Then every word and its reverse walk down a
trie that is nothing but a table of edges.  A state is (word, near, node,
edits): the node stands for the letters of ``near`` walked so far, and ``near``
is the word itself, or what one edit made of it.

* At each level the edges out of the nodes that words still share are derived
  from the states, and states are joined with them on the node.
* A state without an edit goes on with its own letter.  Beyond the middle of
  the word it also branches: into each larger letter (a replacement), and into
  the letter after the next one (a deletion).  The other direction of both is
  the same pair, and an edit before the middle is found in the reversed word.
  So nobody branches in the crowded upper levels.
* An edge tells what lies below it: the only rest where one word is left, else
  the lengths of the rests and a map of their length and first two letters.  A
  state whose rest is not among them is dropped within the join.
* A state that has one edit and whose rest is the only one below an edge is a
  terminal: ``near`` is a neighbour of the word.

There are no more levels than LONGEST letters.  Longer words, of which a corpus
has few, are joined by fingerprints of the word without one letter instead.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslake.functions.scratch import materialize, remove
from opslake.llm.batches import map_slices, slices, texts
from opslake.llm.polynomials import BASE, prefixes, stretch
from opslake.llm.shingles import mix

LETTERS = 7
#: A maximal run of letters, if it is long enough; A to Z are lower-cased.
RUN = re.compile(f"[A-Za-zÀ-ÿ]{{{LETTERS},}}")
OCCURRENCES = 2
#: One run in so many, by a hash, loses a letter.
DAMAGED = 31
#: A form occurs so many times as often as its variant.
RATIO = 10
#: Code points of a word that walks the trie.
LONGEST = 40
#: Different words that a task counts before it hands them on.
TOGETHER = 200_000

#: Ends every word in the trie; no letter.
END = "$"
_START = LETTERS // 2


def _runs(text: str, doc_id) -> Iterator[tuple[str, int]]:
    """The counted runs of one document."""
    prefix = zlib.crc32(b"%s:" % (b"" if doc_id is None else str(doc_id).encode()))
    for run, n in Counter(found.group() for found in RUN.finditer(text)).items():
        data = run.encode().lower()  # bytes: A to Z only
        word = data.decode()
        h = zlib.crc32(data, prefix)
        if h % DAMAGED == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1 :]
        if len(word) >= LETTERS:
            yield word, n


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word`` and ``n`` of every word with at least OCCURRENCES occurrences in all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def handed() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])
            counts.clear()
            return got

        for part in slices(batches):
            for doc_id, text in zip(part.column("doc_id").to_pylist(), texts(part, "text"), strict=True):
                for word, n in _runs(text, doc_id):
                    counts[word] += n
            if len(counts) >= TOGETHER:
                yield handed()
        yield handed()

    plain = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    counted = plain.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= OCCURRENCES)


def _after(name: str, start: Column | int) -> Column:
    """The letters of a column from the given one (from 1) on."""
    return F.substr(F.col(name), F.lit(start) if isinstance(start, int) else start)


def _tag(rest: Column) -> Column:
    """One of 256 bits for the length and the first two letters of a rest."""
    return F.pmod(F.xxhash64(F.char_length(rest), F.substr(rest, F.lit(1), F.lit(2))), F.lit(256)).cast("int")


def _node(side: Column, path: Column) -> Column:
    return F.xxhash64(side, path)


def _edges(states: DataFrame, level: int) -> DataFrame:
    """Edges out of the nodes of a level, from the words that still walk there."""
    walking = states.where("edits = 0").select(
        "node",
        F.substr("near", F.lit(level + 1), F.lit(1)).alias("letter"),
        _node(F.col("side"), F.substr("near", F.lit(1), F.lit(level + 1))).alias("child"),
        _after("near", level + 2).alias("rest"),
    )
    return (
        walking.withColumn("tag", _tag(F.col("rest")))
        .groupBy("node", "letter", "child")
        .agg(
            F.count(F.lit(1)).alias("below"),
            F.bit_or(F.expr("shiftleft(1L, char_length(rest))")).alias("lengths"),
            F.min(F.xxhash64("rest")).alias("only"),
            *_maps(),
        )
    )


def _maps() -> list[Column]:
    return [F.bit_or(F.expr(f"if(tag >> 6 = {k}, shiftleft(1L, tag & 63), 0L)")).alias(f"map{k}") for k in range(4)]


def _advanced(states: DataFrame, edges: DataFrame, level: int) -> DataFrame:
    """States of the next level, and terminals (``found``)."""
    here, after = F.substr("near", F.lit(level + 1), F.lit(1)), F.substr("near", F.lit(level + 2), F.lit(1))
    own = F.col("letter") == here
    branches = (F.col("edits") == 0) & (F.lit(level) >= F.col("middle")) & (here != END)
    replaces = branches & (F.col("letter") > here) & (F.col("letter") != END)
    deletes = branches & (F.col("letter") == after) & ~own
    head = F.substr("near", F.lit(1), F.lit(level))
    shorter = F.concat(head, _after("near", level + 2))
    replaced = F.concat(head, F.col("letter"), _after("near", level + 2))
    nothing = F.lit(None).cast("string")

    def moved(near: Column, edits: int | Column) -> Column:
        return F.struct(near.alias("near"), F.lit(edits).cast("int").alias("edits") if isinstance(edits, int) else edits.alias("edits"))

    empty = F.struct(nothing.alias("near"), F.lit(0).alias("edits"))
    steps = F.array(
        F.when(own, moved(F.col("near"), F.col("edits"))).otherwise(empty),
        F.when(replaces, moved(replaced, 1)).otherwise(empty),
        F.when(deletes, moved(shorter, 1)).otherwise(empty),
    )
    met = states.join(edges, "node").where(own | replaces | deletes)
    stepped = met.select("side", "word", "middle", "child", "below", "lengths", "only", "map0", "map1", "map2", "map3", F.explode(steps).alias("step"))
    rest = _after("near", level + 2)
    went = (
        stepped.where("step.near is not null")
        .select("side", "word", "middle", "child", "below", "lengths", "only", "map0", "map1", "map2", "map3", "step.near", "step.edits")
        .withColumn("rest", rest)
        .withColumn("tag", _tag(F.col("rest")))
    )
    bits = F.expr("case tag >> 6 when 0 then map0 when 1 then map1 when 2 then map2 else map3 end")
    among = (F.expr("(lengths & shiftleft(1L, char_length(rest))) <> 0")) & (bits.bitwiseAND(F.expr("shiftleft(1L, tag & 63)")) != 0)
    terminal = (F.col("edits") == 1) & (F.col("below") == 1) & (F.xxhash64("rest") == F.col("only"))
    onward = (F.col("below") > 1) & ((F.col("edits") == 0) | among)
    return went.where(terminal | onward).select(
        "side", "word", "middle", F.col("child").alias("node"), "near", "edits", (F.col("below") == 1).alias("found")
    )


def _walked(known: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Pairs (word, near) one replacement or deletion apart, among words of up to LONGEST letters, and the tables of states
    that they are read from."""
    length = F.char_length("word")
    forward = known.select(F.lit(0).alias("side"), "word", F.floor(length / 2).cast("int").alias("middle"), F.col("word").alias("walk"))
    backward = known.select(F.lit(1).alias("side"), "word", (length - F.floor(length / 2)).cast("int").alias("middle"), F.reverse("word").alias("walk"))
    both = forward.union(backward)
    walk = F.concat("walk", F.lit(END))
    states = both.select(
        "side", "word", "middle", _node(F.col("side"), F.substr(walk, F.lit(1), F.lit(_START))).alias("node"), walk.alias("near"), F.lit(0).alias("edits")
    )
    states = materialize(states, "states")
    stored, found, level = [states], [], _START
    while not states.isEmpty():
        edges = materialize(_edges(states, level), "edges")
        after = materialize(_advanced(states, edges, level), "states")
        remove(edges)
        stored.append(after)
        found.append(after.where("found"))
        states = after.where("not found").drop("found")
        level += 1
    spark = known.sparkSession
    pairs = spark.createDataFrame([], "word string, near string")
    plain = F.expr("substr(near, 1, char_length(near) - 1)")
    for terminals in found:
        pairs = pairs.union(terminals.select("word", F.when(F.col("side") == 0, plain).otherwise(F.reverse(plain)).alias("near")))
    return pairs.distinct(), stored


def _long_pairs(known: DataFrame) -> DataFrame:
    """The same pairs where the first word has more than LONGEST letters."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = []
        for word in batch.column("word").to_pylist():
            letters = mix(np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1))
            sums, n = prefixes(letters), len(letters)
            at = np.arange(n)
            end = np.full(n, n)
            without = stretch(sums, np.zeros(n, np.int64), at) + _shifted(stretch(sums, at + 1, end), at)
            got.append((word, mix(without).view(np.int64), mix(stretch(sums, np.array([0]), np.array([n]))).view(np.int64)[0]))
        sizes = [len(g[1]) for g in got]
        return pa.RecordBatch.from_pydict(
            {
                "word": pa.array([g[0] for g in got], pa.string()),
                "whole": pa.array([g[2] for g in got], pa.int64()),
                "without": pa.ListArray.from_arrays(
                    pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)),
                    pa.array(np.concatenate([g[1] for g in got]) if got else np.empty(0, np.int64)),
                ),
            }
        )

    longer = known.select("word").where(F.char_length("word") >= LONGEST)  # what loses a letter and what it may become
    hashed = materialize(map_slices(longer, run, "word string, whole bigint, without array<bigint>"), "long-words")
    parts = materialize(
        hashed.where(F.char_length("word") > LONGEST).select("word", F.posexplode("without").alias("place", "hash")), "long-parts"
    )
    a, b = parts.alias("a"), parts.alias("b")
    replaced = a.join(b, ["place", "hash"]).where("a.word < b.word").select(F.col("a.word").alias("word"), F.col("b.word").alias("near"), "place")
    same = F.expr("left(word, place) = left(near, place) and substr(word, place + 2) = substr(near, place + 2)")
    shorter = hashed.select(F.col("word").alias("near"), F.col("whole").alias("hash"))
    deleted = parts.join(shorter, "hash").where("near = concat(left(word, place), substr(word, place + 2))").select("word", "near")
    return replaced.where(same).where("char_length(word) = char_length(near)").select("word", "near").union(deleted).distinct()


def _shifted(values: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Polynomials moved up by so many places."""
    powers = np.full(int(by.max(initial=0)) + 1, BASE, np.uint64)
    powers[0] = 1
    return values * np.multiply.accumulate(powers)[by]


def near_pairs(known: DataFrame) -> DataFrame:
    """``word`` and ``near`` for all words (column ``word``, distinct) that differ by one letter inserted, deleted or
    replaced, both ways round."""
    pairs, stored = _walked(known.where(F.char_length("word") <= LONGEST).select("word"))
    once = materialize(pairs.union(_long_pairs(known)), "near")
    remove(*stored)
    return once.union(once.select(F.col("near").alias("word"), F.col("word").alias("near")))


def _roots(forms: DataFrame) -> DataFrame:
    """``word`` and ``root`` for every word with a form, by pointer jumping."""
    pointers = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = pointers.select(F.col("word").alias("root"), F.col("root").alias("next"))
        jumped = materialize(
            pointers.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots"
        )
        if jumped.where("moved").isEmpty():
            return jumped.select("word", "root")
        remove(pointers)
        pointers = jumped.select("word", "root")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each word: ``word``, ``form``, ``root``, ``n``, ``n_near`` and ``form_n``.

    Words are runs of the letters A to Z, a to z and U+00C0 to U+00FF, A to Z in
    lower case, of at least LETTERS code points and OCCURRENCES occurrences.
    Where DAMAGED divides the crc32 of ``id:run``, the run loses the letter that
    the crc32 names.  Near words differ by one letter.  A word's form is its
    most frequent near word (ties: the smallest), if it occurs RATIO times as
    often; its root is the last form in the chain, or the word itself.

    A null or empty text holds no run.  Rows without id count under an empty id,
    repeated rows each by themselves.  Other columns are ignored.
    """
    known = materialize(words(docs, id_col, text_col), "words")
    # Pairs whose near word is none (a hash in the trie met another) fall out here.
    named = near_pairs(known).join(known.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    summed = named.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    joined = known.join(summed, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.expr(f"-best.less >= {RATIO} * n").alias("has"), "best"
    )
    told = materialize(
        joined.select(
            "word", "n", "n_near", F.when(F.col("has"), F.col("best.near")).alias("form"), F.when(F.col("has"), -F.col("best.less")).alias("form_n")
        ),
        "forms",
    )
    roots = _roots(told.where("form is not null"))
    return told.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
