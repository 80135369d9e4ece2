"""Near-duplicate vectors by spherical k-means cells and blocked cosine products.

A vector goes to the cell of its nearest centroid and, as a guest, to every
cell that could hold the middle of a pair it links with.  For unit vectors u
and v of cosine t or more the middle m = (u+v)/2 is at most
r = sqrt((1-t)/2) from either, so if c is the centroid nearest to m and b the
one nearest to u, then u.b - u.c <= r*|b-c|.  Both ends of every link thus meet
in the cell of c, and no link is lost however the cells lie.  Pairs that meet in
several cells count in the first one they share.

A cell that is large all the same is split in the same way by centroids of its
own.  Equal vectors are folded into one before.  A cell is multiplied block by block,
and a block product gives counts and a spanning forest, never the pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opslake.functions.scratch import materialize, remove
from opslake.llm.batches import map_slices, modest_sample, share
from opslake.llm.graph import components

COSINE = 0.98
#: About so many vectors fit the centroids, fewer where they are so long that these would not fit the bytes.
SAMPLE_ROWS = 20_000
SAMPLE_BYTES = 64 << 20
#: Vectors of one label that a cell should hold, and centroids at most: what is broadcast stays under 8 MB.
CELL_ROWS = 256
CENTROID_BYTES = 8 << 20
ROUNDS = 10
#: A cell of so many times the rows that it should hold is split; its parts at most, and the vectors they are fitted from.
SPLIT_CELLS = 16
MOST_PARTS = 1024
PART_SAMPLE = 2048
#: Share of the parts that a vector may visit on average for a split to be worth it.
WORTH = 0.25
#: Rows and columns of one product.
BLOCK = 1024
#: Products of vectors and centroids that are held at once.
PRODUCT = 1 << 21


def _unit(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; scaling by the largest component first keeps squares finite."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def spherical_kmeans(units: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids of ``units``; an empty cell keeps its centroid."""
    k = min(k, len(units))
    centroids = units[np.linspace(0, len(units) - 1, k).astype(int)].copy()
    parts = np.array_split(units, 1 + len(units) * k // PRODUCT)
    for _ in range(rounds):
        nearest = np.concatenate([(part @ centroids.T).argmax(axis=1) for part in parts])
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, units)
        size = np.linalg.norm(sums, axis=1)
        some = size > 1e-9
        centroids[some] = sums[some] / size[some, None]
    return centroids


def cells_of(units: np.ndarray, centroids: np.ndarray, cosine: float = COSINE) -> list[np.ndarray]:
    """For each vector the cells that it visits, in rising order."""
    reach = np.sqrt((1 - cosine) / 2)
    found: list[np.ndarray] = []
    # Only the centroids nearest to some vector are measured against all others, and a bounded number at once.
    for part in np.array_split(units, 1 + len(units) * len(centroids) // PRODUCT):
        scores = part @ centroids.T
        best = scores.argmax(axis=1)
        nearest, of = np.unique(best, return_inverse=True)
        apart = np.sqrt(np.maximum(0, 2 - 2 * centroids[nearest] @ centroids.T))
        gap = scores[np.arange(len(part)), best][:, None] - scores
        found += [np.flatnonzero(row) for row in gap <= reach * apart[of] + 1e-9]
    return found


def _first_shared(a: np.ndarray, b: np.ndarray) -> int:
    both = np.intersect1d(a, b, assume_unique=True)
    return int(both[0]) if len(both) else -1


def block_links(left: tuple, right: tuple | None, cell: int, cosine: float = COSINE, part: int = 0) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Links between two blocks, or within one if ``right`` is None.

    Each block is (units, copies, cells, parts).  Gives the linked copies of each
    row of either block, counting only pairs whose first shared cell is ``cell``
    and whose first shared part of it is ``part``, and a forest over the rows,
    right ones numbered behind the left ones.
    """
    units, copies, *lists = left
    other, other_copies, *other_lists = right or left
    i, j = np.nonzero(units @ other.T >= cosine)
    if right is None:
        i, j = i[i < j], j[i < j]
    # Which cells a vector visits repeats among near copies, so pairs of visits are looked up, not pairs of vectors.
    kinds: dict[tuple[bytes, bytes], int] = {}

    def numbered(cells: list, parts: list) -> np.ndarray:
        return np.array([kinds.setdefault((c.tobytes(), p.tobytes()), len(kinds)) for c, p in zip(cells, parts, strict=True)], np.int64)

    mine, theirs = numbered(*lists), numbered(*other_lists)
    visits = [tuple(np.frombuffer(x, np.int64) for x in kind) for kind in kinds]
    pairs, of = np.unique(mine[i] * len(kinds) + theirs[j], return_inverse=True)

    def meets_here(pair: int) -> bool:
        a, b = visits[pair // len(kinds)], visits[pair % len(kinds)]
        return _first_shared(a[0], b[0]) == cell and _first_shared(a[1], b[1]) == part

    here = np.array([meets_here(p) for p in pairs], bool)
    counted = here[of] if len(pairs) else np.zeros(0, bool)
    left_links = np.bincount(i[counted], other_copies[j[counted]], minlength=len(units)).astype(np.int64)
    right_links = np.bincount(j[counted], copies[i[counted]], minlength=len(other)).astype(np.int64)
    if right is None:
        left_links, right_links, shift = left_links + right_links, np.zeros(0, np.int64), 0
    else:
        shift = len(units)
    label = np.arange(shift + len(other))
    while len(i):
        before = label.copy()
        low = np.minimum(label[i], label[j + shift])
        np.minimum.at(label, i, low)
        np.minimum.at(label, j + shift, low)
        label = label[label]
        if np.array_equal(before, label):
            break
    forest = [(int(v), int(label[v])) for v in np.flatnonzero(label != np.arange(len(label)))]
    return left_links, right_links, forest


def _split_cells(seats: DataFrame, cosine: float, cell_rows: int) -> DataFrame:
    """``seats`` with ``parts``, the parts of its cell that a vector visits, and a row for each ``part``.

    A cell of more than SPLIT_CELLS times ``cell_rows`` vectors gets centroids of
    its own from a sample of it, and its vectors visit the parts as they visit
    cells, so links are kept as before.  A cell of near copies, which would
    visit most parts, stays whole.
    """
    place = ["label", "dims", "cell"]
    most = SPLIT_CELLS * cell_rows
    large = materialize(seats.groupBy(*place).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most), "large-cells")
    whole = F.array(F.lit(0).cast("bigint"))

    def fit_parts(frame: pd.DataFrame) -> pd.DataFrame:
        units = np.array([np.frombuffer(u, "<f8") for u in frame.sort_values("vec_id").unit])
        k = int(min(MOST_PARTS, max(2, frame.n.iloc[0] // cell_rows)))
        centroids = spherical_kmeans(units, k)
        visits = np.mean([len(x) for x in cells_of(units, centroids, cosine)])
        first = frame[place].iloc[:1].reset_index(drop=True).assign(centroids=[centroids.astype("<f8").tobytes()])
        return first if visits <= WORTH * len(centroids) else first[:0]

    sampled = seats.join(large, place).where(F.pmod(F.xxhash64("vec_id", "cell"), F.ceil(F.col("n") / PART_SAMPLE).cast("bigint")) == 0)
    kind = "label string, dims int, cell bigint"
    fitted = materialize(sampled.select(*place, "n", "vec_id", "unit").groupBy(*place).applyInPandas(fit_parts, f"{kind}, centroids binary"), "part-centroids")
    if fitted.isEmpty():
        return seats.select("*", whole.alias("parts"), F.lit(0).cast("bigint").alias("part"))

    split = materialize(fitted.select(*place).join(large, place).withColumn("shards", F.ceil(F.col("n") / PART_SAMPLE).cast("int")), "split-cells")
    rest = seats.join(split, place, "left_anti").withColumn("parts", whole)
    members = seats.join(split, place).withColumn("shard", F.pmod(F.xxhash64("vec_id"), "shards").cast("int"))
    # Each shard of a cell gets the centroids of its parts as one more row.
    told = fitted.join(split, place).select("*", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"))
    names = seats.columns
    columns = [c for c in names if c not in place]
    both = members.select(*place, "shard", *columns, F.lit(None).cast("binary").alias("centroids")).unionByName(
        told.select(*place, "shard", "centroids"), allowMissingColumns=True
    )

    def visit_parts(group: pa.Table) -> pa.Table:
        centroids = group.filter(pc.is_valid(group.column("centroids"))).column("centroids")[0].as_py()
        rows = group.filter(pc.is_null(group.column("centroids")))
        units = np.array([np.frombuffer(u, "<f8") for u in rows.column("unit").to_pylist()]).reshape(rows.num_rows, -1)
        matrix = np.frombuffer(centroids, "<f8").reshape(-1, group.column("dims")[0].as_py())
        parts = [x.tolist() for x in cells_of(units, matrix, cosine)] if rows.num_rows else []
        return rows.select(names).append_column("parts", pa.array(parts, pa.list_(pa.int64())))

    schema = T.StructType([*seats.schema.fields, T.StructField("parts", T.ArrayType(T.LongType()))])
    seated = both.groupBy(*place, "shard").applyInArrow(visit_parts, schema).select(*rest.columns)
    return materialize(rest.unionByName(seated), "seats").select("*", F.explode("parts").alias("part"))


def near_duplicates(
    embeddings: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    cosine: float = COSINE,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """One row per input row: ``vec_id``, ``n_links``, ``component_id`` and ``kept``.

    Vectors link when their labels are equal and their cosine, in double
    precision, is at least ``cosine``; ``n_links`` counts the other vectors
    linked directly, and the component is named after the smallest id reachable.
    A vector links with nothing when it or its label is null, when it is empty
    or zero, or has a null or non-finite component, and so do vectors of
    different length.  Rows that share an id are one vector, of which the
    greatest (label, vector) counts.  A row without id has no link and no
    component, and is kept.  Other columns are ignored.
    """
    spark = embeddings.sparkSession
    rows = embeddings.select(
        F.col(id_col).cast("bigint").alias("vec_id"),
        F.col(label_col).cast("string").alias("label"),
        F.col(vector_col).cast("array<double>").alias("vector"),
    )
    known = rows.where("vec_id is not null")
    twice = materialize(known.groupBy("vec_id").count().where("count > 1").select("vec_id"), "repeated")
    if not twice.isEmpty():
        one = known.join(twice, "vec_id", "left_semi").groupBy("vec_id").agg(F.max(F.struct("label", "vector")).alias("v"))
        known = known.join(twice, "vec_id", "left_anti").union(one.select("vec_id", "v.label", "v.vector"))

    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = known.where("label is not null and size(vector) > 0").where(finite).where(F.exists("vector", lambda x: x != 0))

    def norm(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = batch.column("vector")
        sizes = np.diff(column.offsets.to_numpy())
        values = column.flatten().to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        units = [np.empty(0)] * len(sizes)
        for size in np.unique(sizes):
            which = np.flatnonzero(sizes == size)
            for at, unit in zip(which, _unit(np.array([values[ends[r] - size : ends[r]] for r in which])), strict=True):
                units[at] = unit
        packed = [u.astype("<f8").tobytes() for u in units]
        return pa.RecordBatch.from_pydict(
            {
                "vec_id": batch.column("vec_id"),
                "label": batch.column("label"),
                "dims": pa.array(sizes, pa.int32()),
                "same": pa.array([xxhash.xxh3_128_digest(p) for p in packed], pa.binary()),
                "unit": pa.array(packed, pa.binary()),
            }
        )

    units = materialize(map_slices(usable, norm, "vec_id bigint, label string, dims int, same binary, unit binary"), "units")
    folded = units.groupBy("label", "dims", "same").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    members = materialize(units.join(folded, ["label", "dims", "same"]).select("vec_id", "rep", "copies"), "members")
    leads = units.join(members.where("vec_id = rep"), "vec_id").select("vec_id", "label", "dims", "copies", "unit")

    largest = {r.dims: r.n for r in units.groupBy("label", "dims").count().groupBy("dims").agg(F.max("count").alias("n")).collect()}
    wanted = min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * max(largest, default=1)))
    sample = modest_sample(units.select("vec_id", "dims", "unit"), "vec_id", wanted).limit(2 * wanted).collect()
    sample.sort(key=lambda r: r.vec_id)
    centroids: dict[int, np.ndarray] = {}
    for dims, most in largest.items():
        held = np.array([np.frombuffer(r.unit, "<f8") for r in sample if r.dims == dims])
        k = max(1, min(most // cell_rows, CENTROID_BYTES // (8 * dims * len(largest))))
        if len(held):  # a rare length without a sampled vector has one cell
            centroids[dims] = spherical_kmeans(held, int(k))
    shared = share(spark, centroids)

    def visit(batch: pa.RecordBatch) -> pa.RecordBatch:
        found: list[list[int]] = [[0]] * batch.num_rows
        packed, dims = batch.column("unit").to_pylist(), batch.column("dims").to_numpy()
        for size in np.unique(dims):
            which = np.flatnonzero(dims == size)
            if size in shared.value:
                mine = np.array([np.frombuffer(packed[r], "<f8") for r in which])
                for at, cells in zip(which, cells_of(mine, shared.value[size], cosine), strict=True):
                    found[at] = cells.tolist()
        return pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(found, pa.list_(pa.int64()))], names=[*batch.schema.names, "cells"]
        )

    kind = "vec_id bigint, label string, dims int, copies bigint, unit binary, cells array<bigint>"
    visits = materialize(map_slices(leads, visit, kind), "visits")
    seats = _split_cells(visits.select("*", F.explode("cells").alias("cell")), cosine, cell_rows)
    place = ["label", "dims", "cell", "part"]
    filled = materialize(seats.groupBy(*place).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")), "filled")
    placed = seats.join(filled, place).withColumn("block", F.pmod(F.xxhash64("vec_id"), "blocks").cast("int"))
    tasks = placed.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        *place, F.least("block", "with").alias("a"), F.greatest("block", "with").alias("b"), "block", "vec_id", "copies", "unit", "cells", "parts"
    )

    def multiply(frame: pd.DataFrame) -> pd.DataFrame:
        a, b, cell, part_of = (int(frame[c].iloc[0]) for c in ("a", "b", "cell", "part"))
        frame = frame.sort_values("vec_id")

        def block(part: pd.DataFrame):
            matrix = np.frombuffer(b"".join(part.unit), "<f8").reshape(len(part), -1)
            return matrix, part.copies.to_numpy(), *([np.asarray(c, np.int64) for c in part[n]] for n in ("cells", "parts"))

        left = frame[frame.block == a]
        right = frame[frame.block == b] if a != b else frame[:0]
        if not len(left) or (a != b and not len(right)):
            return pd.DataFrame({"src": [], "dst": [], "links": []}, dtype="int64")
        mine, theirs, forest = block_links(block(left), block(right) if a != b else None, cell, cosine, part_of)
        ids = np.concatenate((left.vec_id.to_numpy(), right.vec_id.to_numpy()))
        links = np.concatenate((mine, theirs))
        some = links > 0
        src = [ids[some], np.array([ids[s] for s, _ in forest], np.int64)]
        dst = [ids[some], np.array([ids[d] for _, d in forest], np.int64)]
        return pd.DataFrame({"src": np.concatenate(src), "dst": np.concatenate(dst), "links": np.concatenate((links[some], np.zeros(len(forest), np.int64)))})

    found = materialize(tasks.groupBy(*place, "a", "b").applyInPandas(multiply, "src bigint, dst bigint, links bigint"), "links")
    remove(visits)
    parts = components(found.select("src", "dst")).withColumnRenamed("vertex", "rep")
    links = found.groupBy(F.col("src").alias("rep")).agg(F.sum("links").alias("outside"))
    known_links = members.join(links, "rep", "left").join(parts, "rep", "left").select(
        "vec_id",
        (F.col("copies") - 1 + F.coalesce("outside", F.lit(0))).alias("n_links"),
        F.coalesce("component", "rep").alias("component_id"),
    )
    out = embeddings.select(F.col(id_col).cast("bigint").alias("vec_id")).join(known_links, "vec_id", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )
