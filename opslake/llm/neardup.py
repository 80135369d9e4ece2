"""Near-duplicate documents by DartMinHash over runs of five words.

A text is a weighted set: its runs of five lower-case words, weighted by how
often they occur.  Darts are thrown into the plane of weight and rank of each
run: every cell of one unit of weight and one unit of rank receives a Poisson
number of darts, all derived from hashes, so equal cells of two texts hold
equal darts.  Each dart belongs to one of the signature's coordinates, and a
coordinate keeps its earliest dart, the one of lowest rank.  Two texts agree in
a coordinate with the probability of their weighted Jaccard similarity, and a
text costs about ``k ln k`` darts instead of ``k`` hashes for each run.

Texts that agree in all coordinates of a band share a bucket.  A bucket
compares its members with one leader, exactly, so a large group of copies
gives pairs in proportion to its members.  Members that are not similar to
their leader are then compared with each other and with those members that the
triangle inequality of the distance allows, block by block.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslake.functions.scratch import materialize, remove
from opslake.llm.batches import bitmap, keep_marked, map_slices, share, texts, unused
from opslake.llm.graph import components
from opslake.llm.shingles import WordHashes, mix, shingles, weighted_cells, word_hashes

WORDS = 5
SIMILARITY = 0.8
BANDS = 24
BAND_COORDINATES = 6
COORDINATES = BANDS * BAND_COORDINATES
#: Members of a bucket that a task compares with as many others at once.
BLOCK = 256
#: Bits that mark the documents in buckets, whatever their number.
BITMAP_BITS = 25
#: Leaders of one bucket differ from band to band by these orders of ids.
ORDERS = (0, 0x5555555555555555, 0x3333333333333333)

_POISSON = np.cumsum([math.exp(-1) / math.factorial(n) for n in range(18)])
_RANK_BITS = 50


def _split(text: str) -> list[str]:
    return text.lower().split()


def dart_signature(cells: np.ndarray, text: np.ndarray, number: int, k: int = COORDINATES) -> np.ndarray:
    """The earliest dart of each coordinate for ``number`` texts, from their unit cells; zeros for a text without any."""
    weight = np.bincount(text, minlength=number)
    expected = k * math.log(k) + 2 * k
    limit = np.where(weight > 0, np.ceil(expected / np.maximum(weight, 1)), 0).astype(np.int64)
    ceiling = expected / np.maximum(weight, 1)  # ranks beyond it are left unthrown
    signature = np.zeros((number, k), np.uint64)
    pending = np.flatnonzero(weight > 0)
    while len(pending):
        slot = np.full(number, -1)
        slot[pending] = np.arange(len(pending))
        mine = slot[text] >= 0
        own, of = cells[mine], slot[text[mine]]
        ranks = limit[pending][of]
        cell = np.repeat(np.arange(len(own)), ranks)
        rank = np.arange(len(cell)) - np.repeat(np.cumsum(ranks) - ranks, ranks)
        seed = mix(own[cell] + mix(rank.astype(np.uint64) + np.uint64(1)))
        thrown = np.searchsorted(_POISSON, (seed >> np.uint64(11)) / float(1 << 53), side="right")
        hit = np.repeat(np.arange(len(cell)), thrown)
        nth = np.arange(len(hit)) - np.repeat(np.cumsum(thrown) - thrown, thrown)
        dart = mix(seed[hit] + (nth + 1).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        place = (rank[hit].astype(np.uint64) << np.uint64(_RANK_BITS)) | (dart >> np.uint64(64 - _RANK_BITS))
        of = of[cell[hit]]
        early = place < (ceiling[pending] * float(1 << _RANK_BITS)).astype(np.uint64)[of]
        dart, place, of = dart[early], place[early], of[early]
        name = mix(dart + np.uint64(0x8EBC6AF09C88C6E3))
        key = of * k + (name % np.uint64(k)).astype(np.int64)
        best = np.full(len(pending) * k, np.iinfo(np.uint64).max, np.uint64)
        np.minimum.at(best, key, place)
        first = place == best[key]
        flat = np.zeros(len(pending) * k, np.uint64)
        flat[key[first]] = name[first]
        signature[pending] = flat.reshape(-1, k)
        empty = (best.reshape(-1, k) == np.iinfo(np.uint64).max).any(axis=1)
        pending = pending[empty]  # a coordinate got no dart: throw further
        limit[pending] *= 2
        ceiling[pending] *= 2
    return signature


def _bands(signature: np.ndarray) -> np.ndarray:
    parts = signature.reshape(len(signature), BANDS, BAND_COORDINATES)
    got = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for c in range(BAND_COORDINATES):
        got = mix(got * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, c])
    return got


def signatures(docs: DataFrame) -> DataFrame:
    """``doc_id``, a 128-bit identity of the words (``h1``, ``h2``), the number of runs (``size``) and ``bands`` of every
    text that has a word."""
    held = share(docs.sparkSession, [])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not held.value:
            held.value.append(WordHashes())
        words = [_split(t) for t in texts(batch, "text")]
        some = np.flatnonzero([len(w) > 0 for w in words])
        words = [words[i] for i in some]
        hashes, ends = word_hashes(words, held.value[0])
        cells, of = weighted_cells(*shingles(hashes, ends, WORDS)[:2])
        bands = _bands(dart_signature(cells, of, len(words)))
        identity = [xxhash.xxh3_128_digest("\n".join(w).encode("utf-8", "replace")) for w in words]
        both = np.frombuffer(b"".join(identity), dtype="<i8").reshape(-1, 2)
        flat = pa.array(bands.reshape(-1).view(np.int64))
        return pa.RecordBatch.from_pydict(
            {
                "doc_id": batch.column("doc_id").take(pa.array(some, pa.int64())),
                "h1": pa.array(np.ascontiguousarray(both[:, 0])),
                "h2": pa.array(np.ascontiguousarray(both[:, 1])),
                "size": pa.array(np.bincount(of, minlength=len(words)).astype(np.int32)),
                "bands": pa.ListArray.from_arrays(pa.array(np.arange(len(words) + 1, dtype=np.int32) * BANDS), flat),
            }
        )

    return map_slices(docs, run, "doc_id bigint, h1 bigint, h2 bigint, size int, bands array<bigint>")


def cells_of(text: str, memory: WordHashes) -> np.ndarray:
    """The sorted unit cells of one text."""
    hashes, ends = word_hashes([_split(text)], memory)
    return np.sort(weighted_cells(*shingles(hashes, ends, WORDS)[:2])[0])


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two sorted cell arrays."""
    if not len(a) or not len(b):
        return 0.0
    if min(len(a), len(b)) < SIMILARITY * 0.5 * max(len(a), len(b)):
        return min(len(a), len(b)) / max(len(a), len(b))  # an upper bound, far below what links
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return shared / (len(both) - shared)


def measured(pairs: DataFrame, of: DataFrame) -> DataFrame:
    """``similarity`` of each pair (doc_id, leader), from the whole texts."""
    held = share(pairs.sparkSession, [])
    sides = pairs.join(of, "doc_id").join(
        of.select(F.col("doc_id").alias("leader"), F.col("text").alias("leader_text")), "leader"
    )

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not held.value:
            held.value.extend((WordHashes(), [None, None]))
        memory, last = held.value  # rows of one leader come together
        found = []
        for leader, text, leader_text in zip(
            batch.column("leader").to_pylist(), texts(batch, "text"), texts(batch, "leader_text"), strict=True
        ):
            if last[0] != leader_text:
                last[:] = [leader_text, cells_of(leader_text, memory)]
            found.append(similarity(cells_of(text, memory), last[1]))
        return pa.RecordBatch.from_pydict(
            {"doc_id": batch.column("doc_id"), "leader": batch.column("leader"), "similarity": pa.array(found, pa.float64())}
        )

    plain = sides.select("doc_id", "leader", "text", "leader_text")
    return map_slices(plain, run, "doc_id bigint, leader bigint, similarity double")


def _repeats(docs: DataFrame, id_col: str) -> bool:
    """Whether any id stands in several rows."""
    counted = docs.groupBy(F.col(f"`{id_col}`").cast("bigint").alias("id")).count()
    return not counted.where("count > 1 and id is not null").isEmpty()


def _named(id_col: str, text_col: str, repeats: bool) -> Column:
    """What names a document: its id, or a hash of id and text where ids repeat; null without an id."""
    plain = F.col(f"`{id_col}`").cast("bigint")
    return F.when(plain.isNotNull(), F.xxhash64(plain, F.col(f"`{text_col}`"))) if repeats else plain


def _leftover_links(members: DataFrame, docs: DataFrame) -> DataFrame:
    """Links among members of buckets that their leader does not join.

    ``members``: key, doc_id, size, far (not linked with the leader), part
    (component so far).  Members of one part need no comparison, so those outside
    the commonest part of a bucket are compared with each other and with that
    part; and of these only members whose sizes allow the similarity, which lie
    in one class of sizes or in neighbouring ones.
    """
    common = materialize(
        members.groupBy("key", "part")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("key")
        .agg(F.max(F.struct("n", "part"))["part"].alias("common")),
        "common-parts",
    )
    # Classes are a little wider than the similarity asks for, so rounding cannot part a pair by two classes.
    group = F.floor(F.log(F.col("size").cast("double")) / math.log(1.01 / SIMILARITY)).cast("bigint")
    spread = members.join(common, "key").withColumn("other", F.col("part") != F.col("common")).withColumn("class", group)
    spread = materialize(spread, "classes")
    counts = spread.groupBy("key", "other", "class").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("bigint").alias("blocks"))
    counts = materialize(counts, "class-sizes")

    def side(other, of_class, block):
        """A block of one class as a number; blocks of others come before those of the common part."""
        return F.shiftleft(F.when(other, F.lit(0)).otherwise(F.lit(1 << 20)).cast("bigint") + of_class, 32) + block

    with_own = spread.join(counts, ["key", "other", "class"])
    mine = side(F.col("other"), F.col("class"), F.pmod(F.xxhash64("doc_id"), F.col("blocks")))
    seats = with_own.select("key", "doc_id", "far", "part", "other", "class", mine.alias("mine"))
    met = counts.select("key", F.col("other").alias("o"), F.col("class").alias("c"), F.col("blocks").alias("n"))
    tasks = (
        seats.join(met, "key")
        .where("abs(class - c) <= 1 and (other or o)")
        .select("key", "doc_id", "far", "part", "mine", "o", "c", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("block"))
        .withColumn("theirs", side(F.col("o"), F.col("c"), F.col("block")))
        .select("key", F.least("mine", "theirs").alias("a"), F.greatest("mine", "theirs").alias("b"), "mine", "doc_id", "far", "part")
    )
    seated = tasks.join(docs, "doc_id").select("key", "a", "b", "mine", "doc_id", "far", "part", "text")

    held = share(docs.sparkSession, [])

    def compare(group: pa.Table) -> pa.Table:
        if not held.value:
            held.value.append(WordHashes())
        memory = held.value[0]
        rows = {r["doc_id"]: r for r in group.to_pylist()}  # a row for each document
        ids = sorted(rows)
        a, b = group.column("a")[0].as_py(), group.column("b")[0].as_py()
        part = np.array([rows[i]["part"] for i in ids])
        left, right = ([k for k, i in enumerate(ids) if rows[i]["mine"] == side] for side in (a, b))
        cells: dict[int, np.ndarray] = {}
        links: list[tuple[int, int]] = []

        def of(k: int) -> np.ndarray:
            if k not in cells:
                cells[k] = cells_of(rows[ids[k]]["text"] or "", memory)
            return cells[k]

        for i in left:
            for j in right:
                if part[i] == part[j] or not (rows[ids[i]]["far"] or rows[ids[j]]["far"]):
                    continue
                if similarity(of(i), of(j)) >= SIMILARITY:
                    links.append((ids[i], ids[j]))
                    part[part == part[j]] = part[i]
        ends = [pa.array([x[n] for x in links], pa.int64()) for n in (0, 1)]
        return pa.table(ends, names=["src", "dst"])

    return seated.groupBy("key", "a", "b").applyInArrow(compare, "src bigint, dst bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repeats: bool | None = None) -> DataFrame:
    """``name``, ``doc_id``, ``class_id`` and ``kept`` of every document with an id and a word.

    Documents are linked when the weighted Jaccard similarity of their runs of
    five words is at least 0.8; a class holds what links reach, its id is its
    smallest document id, and that document is kept.  Texts are compared as
    lower-case words between white space; a text of one to four words is a
    single run.  Null, empty and blank texts are linked with nothing, nor are
    rows without an id.  ``name`` is the id.  Where ids repeat, it is a hash of
    id and text: rows equal in both are one document, others are documents of
    their own, of which the one of smallest id and name is kept.  Other columns
    are ignored.
    """
    repeats = _repeats(docs, id_col) if repeats is None else repeats
    plain = docs.select(
        _named(id_col, text_col, repeats).alias("name"), F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("text")
    ).where("name is not null")
    if repeats:
        plain = plain.dropDuplicates(["name"])
    found = _classes(plain.select(F.col("name").alias("doc_id"), "text"))
    if not repeats:
        return found.select(F.col("doc_id").alias("name"), "doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("kept"))
    members = plain.select("name", "doc_id").join(found.select(F.col("doc_id").alias("name"), F.col("class_id").alias("of")), "name")
    members = materialize(members, "members")
    heads = materialize(members.groupBy("of").agg(F.min(F.struct("doc_id", "name")).alias("head")), "heads")
    return members.join(heads, "of").select(
        "name", "doc_id", F.col("head.doc_id").alias("class_id"), (F.col("name") == F.col("head.name")).alias("kept")
    )


def _classes(base: DataFrame) -> DataFrame:
    """``doc_id`` and ``class_id`` of every text with words; ids are unique."""
    signed = materialize(signatures(base), "signatures")

    # Equal word sequences: one representative goes on.  Only groups of several are stored, so that the
    # join can split a group that holds a large share of all rows.
    same = materialize(
        signed.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "copies"
    )
    represented = signed.join(same, ["h1", "h2"], "left").withColumn("rep", F.coalesce("rep", "doc_id"))
    members = represented.select("doc_id", "rep")

    bands = represented.where("doc_id = rep").select("doc_id", "size", F.posexplode("bands").alias("band", "key"))
    order = F.pmod("band", F.lit(len(ORDERS)))
    turned = F.array(*(F.lit(o) for o in ORDERS))[order]
    ranked = bands.select("doc_id", "size", "key", turned.alias("turn"), F.col("doc_id").bitwiseXOR(turned).alias("rank"))
    # Aggregates are stored before a join with what they sum up, or a bucket of any size would be one task of it.
    buckets = materialize(
        ranked.groupBy("key").agg(F.min("rank").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "leaders"
    )
    shared = materialize(
        ranked.join(buckets, "key").select("key", "doc_id", "size", F.col("least").bitwiseXOR(F.col("turn")).alias("leader")), "buckets"
    )
    # Only texts in some bucket are read again; a bitmap of fixed size spares the others the shuffle.
    hashed = base.withColumn("hash", F.xxhash64("doc_id"))
    marks = bitmap(shared.select(F.xxhash64("doc_id").alias("hash")), BITMAP_BITS)
    needed = materialize(keep_marked(hashed, marks, "hash").select("doc_id", "text"), "needed")
    pairs = shared.where("doc_id <> leader").select("doc_id", "leader").distinct()
    checked = materialize(measured(pairs, needed), "checked")
    linked = checked.where(F.col("similarity") >= SIMILARITY).select(F.col("doc_id").alias("src"), F.col("leader").alias("dst"))
    parts = materialize(components(linked), "parts")

    # Distances obey the triangle inequality: a member at distance d from its leader can only be
    # linked with members at distances from d - 0.2 on.
    placed = (
        shared.join(checked, ["doc_id", "leader"], "left")
        .join(parts.withColumnRenamed("vertex", "doc_id"), "doc_id", "left")
        .select(
            "key",
            "doc_id",
            "size",
            F.coalesce("similarity", F.lit(1.0)).alias("near"),
            F.coalesce("component", "doc_id").alias("part"),
        )
    )
    reach = 1 - SIMILARITY
    placed = materialize(placed, "placed")
    open_keys = materialize(
        placed.groupBy("key")
        .agg(
            F.max(F.when(F.col("near") < SIMILARITY, F.col("near"))).alias("nearest"),
            F.count_if(F.col("near") < SIMILARITY).alias("far"),
            F.min("part").alias("low"),
            F.max("part").alias("high"),
        )
        .where(f"low < high and (far > 1 or nearest >= {SIMILARITY - reach - 1e-9})")
        .select("key", "nearest"),
        "open-buckets",
    )
    left = materialize(
        placed.join(open_keys, "key")
        .where(f"near < {SIMILARITY} or near <= nearest + {reach + 1e-9}")
        .select("key", "doc_id", "size", (F.col("near") < SIMILARITY).alias("far"), "part"),
        "leftover",
    )
    if left.isEmpty():
        joined = parts
    else:
        more = materialize(_leftover_links(left, needed), "more")
        joined = materialize(components(linked.union(more)), "parts")
    remove(left, needed, shared, checked, placed, open_keys, buckets)
    return (
        members.join(joined.withColumnRenamed("vertex", "rep"), "rep", "left")
        .select("doc_id", F.coalesce("component", "rep").alias("class_id"), "rep")
        .select("doc_id", "class_id")
    )


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id``, ``class_id`` and ``kept``, true for the document its class is named after.

    Documents linked with nothing are classes of their own.  A row without id has no class and is kept.
    """
    repeats = _repeats(docs, id_col)
    found = near_duplicates(docs, id_col, text_col, repeats).select("name", "class_id", "kept")
    name = _named(id_col, text_col, repeats)
    rows = docs.select(name.alias("name"), F.col(f"`{id_col}`").cast("bigint").alias("doc_id"))
    own = F.coalesce("class_id", "doc_id").alias("class_id")
    return rows.join(found, "name", "left").select("doc_id", own, F.coalesce("kept", F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without those that are near copies of a kept one; columns stay as they are.

    One document of each class stays, and of rows equal in id and text one.
    Rows without id stay.
    """
    repeats = _repeats(docs, id_col)
    found = near_duplicates(docs, id_col, text_col, repeats)
    name = _named(id_col, text_col, repeats)
    other = unused(docs, "_gone")
    gone = found.where("not kept").select(F.col("name").alias(other))
    stay = docs.join(gone, name == F.col(other), "left_anti")
    if not repeats:
        return stay
    # Rows equal in id and text, seldom more than a few: the greatest by a hash of all columns stays.
    every = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    keyed = stay.select(name.alias("name"), every.alias("row"))
    one = keyed.where("name is not null").groupBy("name").agg(F.max_by("row", F.xxhash64("row")).alias("row"))
    fields = [F.col("row").getField(c).alias(c) for c in docs.columns]
    return one.select(*fields).union(keyed.where("name is null").select(*fields))
