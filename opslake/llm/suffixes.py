"""Removal of repeated byte strings by a sparse suffix array that lies over many tasks.

Every string of LENGTH bytes is to be found that also starts earlier.  Suffixes
are sorted only where they start at an *anchor*: the place whose run of GRAM
bytes has the least hash among all such runs of a string of LENGTH bytes.  The
string alone decides where its anchor is, so equal strings hold equal anchors at
the same distance, and about one place in 27 is an anchor.

1. Splitters are sampled from the leading tokens of suffixes (four bytes and a
   hash of the run), and suffixes are range-partitioned by them.
2. Buckets sort by multikey quicksort.  Where all that surrounds two anchors is
   equal, every string through the later one is a repeat.  Anchors without a
   partner fall out; those whose surroundings differ are *open*.
3. A leading token that is itself a splitter may lie on several buckets; what
   its buckets leave is compared across them.
4. Open suffixes are fetched as bytes, partitioned by the same splitters and
   sorted again, once for each distance of a string from its anchor.  Those on
   several buckets are compared across them by 128-bit fingerprints of the
   strings that are the first of their bucket.

Nothing is collected: a leading token of any frequency is spread over buckets
in proportion, and rows grow with the bytes of the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslake.functions.scratch import materialize
from opslake.llm.batches import share, slices
from opslake.llm.polynomials import BYTES, prefixes, stretch, utf8
from opslake.llm.shingles import mix

LENGTH = 100
#: Bytes of the run that names an anchor.
GRAM = 48
#: Places whose runs compete within one string.
RUNS = LENGTH - GRAM + 1
#: Bytes of a long text that are looked at together.
PIECE = 1 << 20
#: Anchors that a bucket holds on average, at most.
BUCKET_ANCHORS = 400_000
#: Documents that splitters are sampled from, for every bucket and in all.
SAMPLE_PER_BUCKET = 16
SAMPLE_DOCS = 2000
#: Sampled leading tokens for each bucket.
SAMPLE_LEADS = 64
#: One byte in so many is an anchor in ordinary text.
SPARSITY = (RUNS + 1) // 2

_BLOCK = 1 << 15
_TAIL = LENGTH + RUNS
_LAST_ID = (1 << 63) - 1


def multikey_order(columns: list[np.ndarray], order: np.ndarray, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort: ``order`` refined token by token, and the number of the run of equal keys at each place.

    ``runs`` numbers stretches of ``order`` that are equal so far.  A token is
    read only where rows are still equal in all tokens before it.
    """
    order, runs = order.copy(), runs.copy()
    for tokens in columns:
        step = np.empty(len(runs), bool)
        step[:1] = True
        step[1:] = runs[1:] != runs[:-1]
        alone = step & np.append(step[1:], True)
        tied = np.flatnonzero(~alone)
        if not len(tied):
            break
        mine, of = order[tied], runs[tied]
        by = np.lexsort((tokens[mine], of))
        order[tied] = mine[by]
        read = tokens[order[tied]]
        fresh = np.zeros(len(runs), bool)
        fresh[tied[1:]] = (read[1:] != read[:-1]) & (of[1:] == of[:-1])
        runs = np.cumsum(step | fresh) - 1
    return order, runs


def _argmin(hashes: np.ndarray, least: np.ndarray, events: np.ndarray) -> np.ndarray:
    """The first place of the least hash in the windows that start at ``events``."""
    found = np.empty(len(events), np.int64)
    for at in range(0, len(events), _BLOCK):
        some = events[at : at + _BLOCK]
        found[at : at + _BLOCK] = some + np.argmax(hashes[some[:, None] + np.arange(RUNS)] == least[some][:, None], axis=1)
    return found


def anchors(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Anchors of the strings that start from ``begins`` to before ``ends``, and the hash of the run at each.

    ``data`` reaches LENGTH - 1 bytes beyond every end.
    """
    none = np.empty(0, np.int64), np.empty(0, np.uint64)
    if len(data) < LENGTH:
        return none
    at = np.arange(len(data) - GRAM + 1)
    hashes = mix(stretch(sums, at, at + GRAM))
    least, width = hashes, 1
    while width * 2 <= RUNS:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    total = len(data) - LENGTH + 1
    least = np.minimum(least[:total], least[RUNS - width : RUNS - width + total])
    valid = np.zeros(total + 1, np.int8)
    some = ends > begins
    valid[begins[some]] = 1
    valid[ends[some]] -= 1
    valid = np.cumsum(valid[:total], dtype=np.int8).astype(bool)
    # The anchor of a string differs from that of the string before it only where a smaller run enters or the least one leaves.
    fresh = valid.copy()
    entered = least[1:] < least[:-1]
    fresh[1:] &= ~valid[:-1] | (least[1:] != least[:-1]) | (hashes[: total - 1] == least[:-1])
    places = np.flatnonzero(fresh)
    if not len(places):
        return none
    right = np.zeros(len(places), bool)
    later = places > 0
    right[later] = entered[places[later] - 1] & valid[places[later] - 1]
    found = places + RUNS - 1
    found[~right] = _argmin(hashes, least, places[~right])
    found = np.unique(found)
    return found, hashes[found]


def _pieces(data: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]]:
    """Stretches of a slice that are looked at together: the number of its first text, bytes, text bounds in them, starts from and to, bytes left out."""
    begins = np.concatenate(([0], ends[:-1])).astype(np.int64)
    if len(data) <= 2 * PIECE or len(ends) > 1:
        yield 0, data, begins, ends, np.stack((begins, np.maximum(ends - LENGTH + 1, begins))), 0
        return
    for low in range(0, max(len(data) - LENGTH + 1, 1), PIECE):
        left = max(0, low - RUNS)
        part = data[left : low + PIECE + _TAIL + LENGTH]
        stop = min(low + PIECE, len(data) - LENGTH + 1)
        yield 0, part, np.array([0]), np.array([len(part)]), np.array([[low - left], [max(stop, low) - left]]), left


def _suffixes(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
    """Number of the text, place, leading token and fingerprint of the surroundings of every anchor of a slice."""
    data, ends = utf8(batch.column("text"))
    for _, part, begins, stops, starts, left in _pieces(data, ends):
        sums = prefixes(BYTES[part])
        at, run = anchors(part, starts[0], starts[1], sums)
        text = np.searchsorted(stops, at, side="right")
        low = np.maximum(begins[text], at - RUNS + 1)
        high = np.minimum(stops[text], at + LENGTH)
        sides = (at - low).astype(np.uint64) * np.uint64(1024) + (high - at).astype(np.uint64)
        around = mix(stretch(sums, low, high) + sides * np.uint64(0x8EBC6AF09C88C6E3))
        lead = sum(part[at + k].astype(np.uint64) << np.uint64(56 - 8 * k) for k in range(4))
        yield text, at - begins[text] + left, lead | (run >> np.uint64(32)) if len(at) else run, around


def _dealt(lead: np.ndarray, salt: np.ndarray, splitters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each leading token, and whether it is a splitter, so that several buckets hold its suffixes."""
    low, high = np.searchsorted(splitters, lead, side="left"), np.searchsorted(splitters, lead, side="right")
    return low + (mix(salt) % (high - low + 1).astype(np.uint64)).astype(np.int64), high > low


def _text_order(id_col: str, text_col: str, docs: DataFrame) -> DataFrame:
    """``doc_id``, ``doc`` and ``tag``, by which texts are ordered, and ``text``."""
    plain = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    unlike = plain.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty()
    tag = F.lit(0).cast("bigint") if unlike else F.xxhash64("text")
    return plain.select("doc_id", F.coalesce("doc_id", F.lit(_LAST_ID)).alias("doc"), tag.alias("tag"), "text")


def _splitters(texts: DataFrame) -> np.ndarray:
    """Leading tokens that cut the suffixes into buckets of about equal size, from a sample of documents."""
    spark = texts.sparkSession
    size = texts.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    expected = (size.bytes or 0) / SPARSITY
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(expected / BUCKET_ANCHORS) + 1)
    wanted = max(SAMPLE_DOCS, SAMPLE_PER_BUCKET * buckets)
    share_of = min(1.0, wanted / max(size.n, 1))
    parts = 1 << 30
    sampled = texts.where(F.pmod(F.xxhash64("doc", "tag"), F.lit(parts)) < int(parts * share_of))
    one_in = max(1, int(expected * share_of / (SAMPLE_LEADS * buckets)))

    def leads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            doc = part.column("doc").to_numpy().view(np.uint64)
            for text, at, lead, around in _suffixes(part):
                picked = mix(around + mix(at.astype(np.uint64) + doc[text])) % np.uint64(one_in) == 0
                yield pa.RecordBatch.from_pydict({"lead": pa.array(lead[picked].view(np.int64))})

    sample = sampled.select("doc", "text").mapInArrow(leads, "lead bigint").toArrow().column("lead").to_numpy().view(np.uint64)
    if not len(sample):
        return np.zeros(buckets - 1, np.uint64)
    return np.sort(sample)[len(sample) * np.arange(1, buckets) // buckets]


_PLACED = "lead bigint, around bigint, doc bigint, tag bigint, at int"


def _sparse_suffixes(texts: DataFrame, splitters: np.ndarray) -> DataFrame:
    """All anchors with their bucket."""
    held = share(texts.sparkSession, splitters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            doc, tag = (part.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "tag"))
            for text, at, lead, around in _suffixes(part):
                bucket, _ = _dealt(lead, around + at.astype(np.uint64) + doc[text].astype(np.uint64), held.value)
                yield pa.RecordBatch.from_pydict(
                    {
                        "lead": pa.array(lead.view(np.int64)),
                        "around": pa.array(around.view(np.int64)),
                        "doc": pa.array(doc[text]),
                        "tag": pa.array(tag[text]),
                        "at": pa.array(at.astype(np.int32)),
                        "bucket": pa.array(bucket.astype(np.int32)),
                    }
                )

    return texts.select("doc", "tag", "text").mapInArrow(run, f"{_PLACED}, bucket int")


def _settled(suffixes: DataFrame, splitters: np.ndarray) -> DataFrame:
    """What sorted buckets tell: ``kind`` whole (all around is a repeat), open, or shared (other buckets hold the token too)."""
    held = share(suffixes.sparkSession, splitters)
    names = ["lead", "around", "doc", "tag", "at"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if table is None or not table.num_rows:
            return
        columns = [table.column(c).to_numpy() for c in names]
        everyone = np.arange(table.num_rows)
        order, runs = multikey_order(columns, everyone, np.zeros(len(everyone), np.int64))
        once = np.append(True, runs[1:] != runs[:-1])  # an anchor on the border of two pieces is met twice
        lead, around, doc, tag, at = (c[order][once] for c in columns)
        group = np.append(True, lead[1:] != lead[:-1])
        first = group | np.append(True, around[1:] != around[:-1])
        number = np.cumsum(group) - 1
        several = np.bincount(number, weights=first)[number] > 1
        shared = _dealt(lead.view(np.uint64), np.zeros(len(lead), np.uint64), held.value)[1]
        kind = np.where(~first, 0, np.where(shared, 2, np.where(several, 1, 3))).astype(np.int8)
        kept = kind < 3
        got = [kind, lead, around, doc, tag, at]
        yield pa.RecordBatch.from_arrays([pa.array(c[kept]) for c in got], names=["kind", *names])

    return suffixes.select(*names).mapInArrow(run, f"kind tinyint, {_PLACED}")


def _across_buckets(shared: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Whole and open suffixes among those whose leading token lies on several buckets."""
    place = F.struct("doc", "tag", "at")
    firsts = materialize(shared.groupBy("lead", "around").agg(F.min(place).alias("first")), "firsts")
    whole = shared.join(firsts, ["lead", "around"]).where(place != F.col("first")).select("doc", "tag", "at")
    several = materialize(firsts.groupBy("lead").count().where("count > 1").select("lead"), "several")
    return whole, firsts.join(several, "lead").select("first.*", "lead")


def _open_bytes(open_: DataFrame, texts: DataFrame, splitters: np.ndarray) -> DataFrame:
    """The bytes around open anchors, with their bucket and whether other buckets hold the leading token too."""
    held = share(texts.sparkSession, splitters)
    listed = open_.groupBy("doc", "tag").agg(F.collect_list("at").alias("ats"), F.collect_list("lead").alias("leads"))
    rows = listed.join(texts.select("doc", "tag", "text"), ["doc", "tag"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            data, ends = utf8(part.column("text"))
            begins = np.concatenate(([0], ends[:-1]))
            for k, (doc, tag) in enumerate(zip(part.column("doc").to_pylist(), part.column("tag").to_pylist(), strict=True)):
                text = data[begins[k] : ends[k]]
                every = part.column("ats")[k].values.to_numpy().astype(np.int64)
                leads = part.column("leads")[k].values.to_numpy().view(np.uint64)
                for some in range(0, len(every), _BLOCK):
                    at, lead = every[some : some + _BLOCK], leads[some : some + _BLOCK]
                    bucket, shared = _dealt(lead, mix(at.astype(np.uint64)) + np.uint64(doc & (1 << 64) - 1), held.value)
                    low, high = np.maximum(at - RUNS + 1, 0), np.minimum(at + LENGTH, len(text))
                    around = [text[a:b].tobytes() for a, b in zip(low, high, strict=True)]
                    columns = [
                        pa.array(bucket.astype(np.int32)),
                        pa.array(shared),
                        pa.array(np.full(len(at), doc)),
                        pa.array(np.full(len(at), tag)),
                        pa.array(at.astype(np.int32)),
                        pa.array((at - low).astype(np.int32)),
                        pa.array(around, pa.binary()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=["bucket", "shared", "doc", "tag", "at", "before", "bytes"])

    plain = rows.select("doc", "tag", "ats", "leads", "text")
    return plain.mapInArrow(run, "bucket int, shared boolean, doc bigint, tag bigint, at int, before int, bytes binary")


def _string_hashes(strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit fingerprints of every row of LENGTH bytes."""
    got = []
    for k in (1, 2):
        weights = mix(np.arange(LENGTH, dtype=np.uint64) + np.uint64(k << 32)) | np.uint64(1)
        table = mix(BYTES + np.uint64(k))
        got.append(mix((table[strings] * weights).sum(axis=1, dtype=np.uint64)).view(np.int64))
    return got[0], got[1]


def _compared(rows: DataFrame) -> DataFrame:
    """What the bytes of open suffixes tell, bucket by bucket.

    Repeated stretches (doc, tag, start, stop); and of suffixes that other
    buckets hold too, the fingerprints ``w1``, ``w2`` of the strings that are no
    repeats within the bucket.
    """
    middle = RUNS - 1

    def emit(doc, tag, start, stop, w1=None, w2=None) -> pa.RecordBatch:
        marks = [pa.nulls(len(doc), pa.int64()) if w is None else pa.array(w) for w in (w1, w2)]
        places = [pa.array(c.astype(np.int32)) for c in (start, stop)]
        return pa.RecordBatch.from_arrays(
            [pa.array(doc), pa.array(tag), *places, *marks], names=["doc", "tag", "start", "stop", "w1", "w2"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = list(batches)
        table = pa.Table.from_batches(batches) if batches else None
        if table is None or not table.num_rows:
            return
        n = table.num_rows
        doc, tag, at, before, shared = (table.column(c).to_numpy() for c in ("doc", "tag", "at", "before", "shared"))
        data, stops = _binary(table.column("bytes").combine_chunks())
        sizes = np.diff(stops, prepend=0)
        after = sizes - before
        # One row for each suffix, all with their anchor in the same column.
        field = np.zeros((n, middle + LENGTH + 8), np.uint8)
        row = np.repeat(np.arange(n), sizes)
        field[row, np.arange(len(data)) - np.repeat(stops - sizes, sizes) + np.repeat(middle - before, sizes)] = data
        leads = np.ascontiguousarray(field[:, middle : middle + GRAM]).view(">u8").astype(np.uint64)
        order, group = multikey_order(list(leads.T), np.arange(n), np.zeros(n, np.int64))
        wanted = (np.bincount(group)[group] > 1) | shared[order]
        order, group = order[wanted], group[wanted]
        rank = np.empty(n, np.int64)
        rank[np.lexsort((at, tag, doc))] = np.arange(n)
        repeat = np.zeros((n, RUNS + 1), bool)
        for off in range(RUNS):
            some = (before[order] >= off) & (after[order] >= LENGTH - off)
            mine, of = order[some], group[some]
            if not len(mine):
                continue
            string = np.zeros((len(mine), LENGTH + 4), np.uint8)
            string[:, :LENGTH] = field[mine, middle - off : middle - off + LENGTH]
            by, same = multikey_order([*string.view(">u8").astype(np.uint64).T], np.arange(len(mine)), of)
            held = rank[mine[by]]
            starts = np.flatnonzero(np.append(True, same[1:] != same[:-1]))
            earliest = np.repeat(np.minimum.reduceat(held, starts), np.diff(starts, append=len(held)))
            later = held > earliest
            repeat[mine[by[later]], off] = True
            across = by[~later & shared[mine[by]]]
            for low in range(0, len(across), _BLOCK):
                now = across[low : low + _BLOCK]
                which = mine[now]
                yield emit(doc[which], tag[which], at[which] - off, at[which] - off + LENGTH, *_string_hashes(string[now, :LENGTH]))
        # Neighbouring distances of one suffix are one stretch.
        change = np.diff(repeat.astype(np.int8), axis=1, prepend=0)
        which, low = np.nonzero(change == 1)
        _, high = np.nonzero(change == -1)
        yield emit(doc[which], tag[which], at[which] - high + 1, at[which] - low + LENGTH)

    plain = rows.select("shared", "doc", "tag", "at", "before", "bytes")
    return plain.mapInArrow(run, "doc bigint, tag bigint, start int, stop int, w1 bigint, w2 bigint")


def _binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    large = column.cast(pa.large_binary())
    offsets = np.frombuffer(large.buffers()[1], np.int64)[large.offset : large.offset + len(large) + 1]
    return np.frombuffer(large.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets[1:] - offsets[0]


def _equal_strings(rows: DataFrame) -> DataFrame:
    """Repeated stretches among strings that are the first of their bucket."""
    place = F.struct("doc", "tag", "start")
    grouped = rows.groupBy("w1", "w2").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    firsts = materialize(grouped.where("first <> last").select("w1", "w2", "first"), "strings")
    return rows.join(firsts, ["w1", "w2"]).where(place != F.col("first")).select("doc", "tag", "start", "stop")


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: ``doc_id``, ``n_bytes``, the repeated stretches ``spans`` and the bytes ``kept`` without them.

    A byte is repeated when a string of LENGTH bytes of the UTF-8 text covers
    it that also starts earlier: in a document of a smaller id, or earlier in
    the same one.  Strings may overlap and never cross documents.  A null text
    is empty; texts shorter than LENGTH hold no string.  Rows that share an id
    are documents of their own, ordered by a hash of their texts; rows equal in
    id and text are one document and get the same result.  Rows without id come
    after all others.  Other columns are ignored.
    """
    texts = _text_order(id_col, text_col, docs)
    splitters = _splitters(texts)
    buckets = len(splitters) + 1
    dealt = _sparse_suffixes(texts, splitters).repartitionById(buckets, "bucket")
    settled = materialize(_settled(dealt, splitters), "settled")

    def of(kind: int) -> DataFrame:
        return settled.where(F.col("kind") == kind)

    shared_whole, shared_open = _across_buckets(of(2).drop("kind"))
    whole = of(0).select("doc", "tag", "at").union(shared_whole)
    open_ = of(1).select("doc", "tag", "at", "lead").union(shared_open)
    compared = materialize(_compared(_open_bytes(open_, texts, splitters).repartitionById(buckets, "bucket")), "compared")
    around = whole.select("doc", "tag", (F.col("at") - RUNS + 1).alias("start"), (F.col("at") + LENGTH).alias("stop"))
    local = compared.where("w1 is null").select("doc", "tag", "start", "stop")
    spans = around.union(local).union(_equal_strings(compared.where("w1 is not null"))).groupBy("doc", "tag")
    listed = spans.agg(F.collect_list("start").alias("starts"), F.collect_list("stop").alias("stops"))
    return _cut(texts.join(listed, ["doc", "tag"], "left").select("doc_id", "text", "starts", "stops"))


def _cut(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            data, ends = utf8(part.column("text"))
            begins = np.concatenate(([0], ends[:-1]))
            starts, stops = part.column("starts"), part.column("stops")
            spans, kept = [], []
            for k in range(part.num_rows):
                text = data[begins[k] : ends[k]]
                if not starts[k].is_valid:
                    spans.append([])
                    kept.append(text.tobytes())
                    continue
                low = np.maximum(starts[k].values.to_numpy(), 0)
                high = np.minimum(stops[k].values.to_numpy(), len(text))
                by = np.argsort(low, kind="stable")
                low, high = low[by], np.maximum.accumulate(high[by])
                new = np.append(True, low[1:] > high[:-1])
                first = low[new]
                last = high[np.append(np.flatnonzero(new)[1:] - 1, len(high) - 1)]
                spans.append([{"start": a, "end": b} for a, b in zip(first.tolist(), last.tolist(), strict=True)])
                edges = zip([0, *last.tolist()], [*first.tolist(), len(text)], strict=True)
                kept.append(b"".join(text[a:b].tobytes() for a, b in edges))
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(ends - begins), pa.array(spans, kind), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "spans", "kept"],
            )

    return rows.mapInArrow(run, "doc_id bigint, n_bytes bigint, spans array<struct<start:int,end:int>>, kept binary")


def digest(found: DataFrame) -> DataFrame:
    """Counts and a hash of what is left."""
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + (s["end"] - s["start"]))
    return found.select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
