"""Exact top-k search by inner product over a pivot-distance index.

Vectors are integers: floor(scale * x) of each component. The index keys every distinct vector by its nearest pivot and its
distance from it, sorts by that key and cuts the order into blocks; a cell is a ring, or annulus, of one pivot. For a query q
at distance d from the pivot, a vector x of norm n at distance r has

    <q, x> = (|q|^2 + n^2 - |q - x|^2) / 2 <= (|q|^2 + n^2 - (d - r)^2) / 2

by the triangle inequality, and |q| n at most. A query takes cells in the order of this bound, in rounds that reach eight times as
far each, and stops where no cell that is left can hold a score as good as its k-th. So results are exact whatever the pivots.

Null rows, null or non-finite components: a vector with any takes no part, nor does a row without an id. Shorter vectors are taken
as ending in zeros. Rows that repeat both id and vector count once; copies of one vector under many ids are indexed once, with the
k + 1 smallest of their ids, as no other of them can be among the k best of any query. Rows with the query's id aren't its
candidates. Equal scores go to the smaller id. An empty table gives no rows. Components beyond what a double's integers hold are
multiplied as whole numbers, and scores beyond a long are its nearest end.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelwright.llm.common import map_arrow, stored

#: Distinct vectors, the first by hash, that the pivots are fitted to on the driver.
SAMPLE = 8192
MOST_PIVOTS = 512
MOST_RINGS = 64
#: Vectors of a ring that the number of rings aims at, of a block at most, and queries of a pack at most.
RING_ROWS = 512
BLOCK_ROWS = 1024
PACK = 64
#: Cells that a query visits in the first round; a round reaches GROWTH times as far as the one before.
FIRST_CELLS = 4
GROWTH = 8
#: Share of the squared norms that bounds are raised by, well above the rounding of distances.
SLACK = 1e-6


def whole_vectors(df: DataFrame, id: str, vector: str, scale: int) -> DataFrame:
    """(id, v): the rows that take part, with whole components."""
    known = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    rows = df.select(F.col(id).cast("bigint").alias("id"), F.col(vector).alias("v")).filter("id IS NOT NULL AND v IS NOT NULL")
    return rows.filter(F.forall("v", known)).select("id", F.transform("v", lambda x: F.floor(x.cast("double") * scale)).alias("v"))


@dataclass(frozen=True)
class Numbers:
    """How vectors are kept and multiplied: components of a vector, and whether products exceed a double's integers."""

    dims: int
    wide: bool

    @property
    def kind(self) -> str:
        return "<i8" if self.wide else "<i4"

    def column(self, vectors: pa.Array) -> np.ndarray:
        """The rows of a list column as a matrix; shorter lists end in zeros."""
        lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
        out = np.zeros((len(vectors), self.dims), self.kind)
        flat = vectors.flatten().to_numpy(zero_copy_only=False)
        at = np.repeat(np.arange(len(vectors)), lengths)
        out[at, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
        return out

    def rows(self, data: bytes) -> np.ndarray:
        return np.frombuffer(data, self.kind).reshape(-1, self.dims)

    def products(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if self.wide:
            exact = a.astype(object) @ b.astype(object).T
            return np.clip(exact, -(1 << 63), (1 << 63) - 1).astype(np.int64)
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)


def _norms(x: np.ndarray) -> np.ndarray:
    x = x.astype(float)
    return np.einsum("ij,ij->i", x, x)


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = _norms(x)[:, None] + _norms(pivots) - 2 * (x.astype(float) @ pivots.T)
    return np.sqrt(np.maximum(square, 0))


def fit_pivots(sample: np.ndarray, n: int, steps: int = 8) -> np.ndarray:
    """n centres of the sample by Lloyd's steps from its first rows; a centre without rows stays where it is."""
    pivots = sample[:n].astype(float)
    for _ in range(steps):
        nearest = _distances(sample, pivots).argmin(axis=1)
        sums, counts = np.zeros_like(pivots), np.bincount(nearest, minlength=len(pivots))
        np.add.at(sums, nearest, sample)
        pivots = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], pivots)
    return pivots


@dataclass(frozen=True)
class Cells:
    """The pivots, and of each cell its number, pivot, least and largest distance and largest squared norm; MOST_PIVOTS x MOST_RINGS at most."""

    numbers: Numbers
    pivots: np.ndarray
    number: np.ndarray
    pivot: np.ndarray
    low: np.ndarray
    high: np.ndarray
    norm: np.ndarray

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """What a score of each query with a vector of each cell can't exceed."""
        own, far = _norms(queries)[:, None], _distances(queries, self.pivots)[:, self.pivot]
        gap = np.maximum(np.maximum(self.low - far, far - self.high), 0)
        return np.minimum((own + self.norm - gap**2) / 2, np.sqrt(own * self.norm)) + SLACK * (own + self.norm)


def distinct_vectors(vectors: DataFrame, k: int) -> DataFrame:
    """(v, ids): every distinct vector with the k + 1 smallest of its ids; each task passes on that many of a vector at most."""
    rows = vectors.dropDuplicates(["v", "id"])
    first = rows.withColumn("_r", F.row_number().over(Window.partitionBy("v").orderBy("id"))).filter(F.col("_r") <= k + 1)
    return first.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def keyed(vectors: DataFrame, pivots: np.ndarray, numbers: Numbers, ids: str) -> DataFrame:
    """vectors (v, ids or id) as (vector, the ids column, pivot, distance, norm): packed, with their key."""

    def near(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        x = numbers.column(batch.column("v"))
        far = _distances(x, pivots)
        pivot = far.argmin(axis=1)
        columns = [pa.array([row.tobytes() for row in x], pa.binary()), batch.column(ids), pa.array(pivot, pa.int32()), pa.array(far[np.arange(len(x)), pivot]), pa.array(_norms(x))]
        yield pa.RecordBatch.from_arrays(columns, names=["vector", ids, "pivot", "distance", "norm"])

    kind = vectors.schema[ids].dataType.simpleString()
    return map_arrow(vectors.select("v", ids), near, f"vector binary, {ids} {kind}, pivot int, distance double, norm double")


def _runs(keys: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Index ranges of equal consecutive keys, of at most `most` rows."""
    ends = [*(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
    start = 0
    for end in ends:
        yield from ((i, min(i + most, end)) for i in range(start, end, most))
        start = end


def build_index(vectors: DataFrame, numbers: Numbers, k: int) -> tuple[DataFrame, Cells] | None:
    """Sorted blocks of vectors (id, v), every one of them, in the shared folder, and their cells; None if there are none."""
    apart = stored(distinct_vectors(vectors, k), "vectors")
    n = apart.count()
    if not n:
        return None
    hashed = apart.select("v", F.xxhash64("v").alias("h")).orderBy("h", "v").limit(SAMPLE).select("v").toArrow()
    sample = numbers.column(hashed.column("v").combine_chunks())
    pivots = fit_pivots(sample, min(len(sample), MOST_PIVOTS, max(1, int(n**0.5) // 4)))
    rings = int(min(MOST_RINGS, max(1, n // (len(pivots) * RING_ROWS))))
    rows = stored(keyed(apart, pivots, numbers, "ids"), "keyed-vectors")
    edges = np.full((len(pivots), rings - 1), np.inf)
    if rings > 1:
        cuts = F.percentile_approx("distance", [i / rings for i in range(1, rings)], 1000)
        for pivot, at in rows.groupBy("pivot").agg(cuts).collect():  # rings of every pivot: MOST_PIVOTS x MOST_RINGS numbers at most
            edges[pivot] = at

    def cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        pivot, distance, norm = (batch.column(c).to_numpy() for c in ("pivot", "distance", "norm"))
        ring = np.empty(len(pivot), np.int64)
        for p in np.unique(pivot):
            ring[pivot == p] = np.searchsorted(edges[p], distance[pivot == p], side="right")
        cell = pivot * np.int64(rings) + ring
        parts = list(_runs(cell, BLOCK_ROWS))
        vectors, ids = batch.column("vector").to_pylist(), batch.column("ids").to_pylist()
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([int(cell[a]) for a, _ in parts], pa.int32()),
                pa.array([b"".join(vectors[a:b]) for a, b in parts], pa.binary()),
                pa.array([ids[a:b] for a, b in parts], pa.list_(pa.list_(pa.int64()))),
                pa.array([distance[a:b].tolist() for a, b in parts], pa.list_(pa.float64())),
                pa.array([float(norm[a:b].max()) for a, b in parts]),
            ],
            names=["cell", "vectors", "ids", "distances", "norm"],
        )

    key = ["pivot", "distance", "vector"]
    order = rows.repartitionByRange(*key).sortWithinPartitions(*key)
    blocks = stored(map_arrow(order, cut, "cell int, vectors binary, ids array<array<bigint>>, distances array<double>, norm double"), "vector-blocks")
    ends = blocks.groupBy("cell").agg(F.min(F.array_min("distances")), F.max(F.array_max("distances")), F.max("norm")).orderBy("cell").collect()
    cell, low, high, norm = (np.array(c) for c in zip(*ends))
    return blocks, Cells(numbers, pivots, cell, cell // rings, low, high, norm)


def query_packs(queries: DataFrame, cells: Cells) -> DataFrame:
    """(pack, ids, vectors): distinct queries packed with others near them."""

    def pack(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        vectors, ids = batch.column("vector").to_pylist(), batch.column("id").to_pylist()
        parts = list(_runs(np.zeros(len(ids)), PACK))
        columns = [pa.array([ids[a:b] for a, b in parts], pa.list_(pa.int64())), pa.array([b"".join(vectors[a:b]) for a, b in parts], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["ids", "vectors"])

    key = ["pivot", "distance", "id"]
    rows = keyed(queries.dropDuplicates(["v", "id"]), cells.pivots, cells.numbers, "id").repartitionByRange(*key).sortWithinPartitions(*key)
    return stored(map_arrow(rows, pack, "ids array<bigint>, vectors binary").withColumn("pack", F.monotonically_increasing_id()), "query-packs")


def wanted_cells(packs: DataFrame, cells: Cells, first: int, last: int) -> DataFrame:
    """(cell, pack, slots, ids, vectors, least): the queries of packs (with `best`, slot to k-th score) that need the cell, at places
    first to last of their order of bounds, and their k-th scores so far."""

    def want(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for pack, ids, data, best in zip(*(batch.column(c).to_pylist() for c in ("pack", "ids", "vectors", "best"))):
            q = cells.numbers.rows(data)
            least = np.full(len(ids), -np.inf)
            known = dict(best or [])
            for slot, score in known.items():
                least[slot] = score
            bounds = cells.bounds(q)
            order = np.argsort(-bounds, axis=1, kind="stable")[:, first:last]
            slot, place = np.nonzero(np.take_along_axis(bounds, order, axis=1) >= least[:, None])
            cell = order[slot, place]
            by_cell = np.argsort(cell, kind="stable")
            for a, b in _runs(cell[by_cell], PACK):
                slots = slot[by_cell[a:b]]
                out.append((int(cells.number[cell[by_cell[a]]]), pack, slots.tolist(), [ids[s] for s in slots], q[slots].tobytes(), [known.get(s) for s in slots.tolist()]))
        if out:
            kinds = (pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int64()))
            names = ["cell", "pack", "slots", "query_ids", "queries", "least"]
            for i in range(0, len(out), 256):
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out[i : i + 256]), kinds)], names=names)

    schema = "cell int, pack bigint, slots array<int>, query_ids array<bigint>, queries binary, least array<bigint>"
    return map_arrow(packs.select("pack", "ids", "vectors", "best"), want, schema)


def scored(wanted: DataFrame, blocks: DataFrame, cells: Cells, k: int) -> DataFrame:
    """(pack, slot, query_id, vec_id, score): of every block and query the k best at most, none below the query's k-th so far."""
    numbers, pivot_of = cells.numbers, dict(zip(cells.number.tolist(), cells.pivot.tolist()))

    def score(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[], [], [], [], []]
        names = ("cell", "pack", "slots", "query_ids", "queries", "least", "vectors", "ids", "distances", "norm")
        for cell, pack, slots, query_ids, queries, least, vectors, ids, distances, norm in zip(*(batch.column(c).to_pylist() for c in names)):
            q, far = numbers.rows(queries), np.array(distances)
            if None not in least:  # the annulus that can hold a good enough score
                own = _norms(q)
                at = _distances(q, cells.pivots[pivot_of[cell]][None, :])[:, 0]
                reach = np.sqrt(np.maximum((own + norm) * (1 + SLACK) - 2 * np.array(least, float), 0))
                a, b = np.searchsorted(far, (at - reach).min(), "left"), np.searchsorted(far, (at + reach).max(), "right")
            else:
                a, b = 0, len(far)
            if a >= b:
                continue
            numbered = ids[a:b]
            entry = np.repeat(np.arange(b - a), [len(x) for x in numbered])
            entry_id = np.array([i for x in numbered for i in x], np.int64)
            scores = numbers.products(q, numbers.rows(vectors)[a:b])
            for slot, own_id, most, row in zip(slots, query_ids, least, scores):
                other = np.flatnonzero(entry_id != own_id)
                found = row[entry[other]]
                floor = most if most is not None else np.iinfo(np.int64).min
                if len(found) > k:
                    floor = max(floor, int(np.partition(found, len(found) - k)[len(found) - k]))
                good = np.flatnonzero(found >= floor)
                good = good[np.lexsort((entry_id[other[good]], ~found[good]))[:k]]
                for column, values in zip(out, ([pack] * len(good), [slot] * len(good), [own_id] * len(good), entry_id[other[good]].tolist(), found[good].tolist())):
                    column.extend(values)
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 1 else pa.int64()) for i, c in enumerate(out)], names=["pack", "slot", "query_id", "vec_id", "score"])

    return map_arrow(wanted.join(blocks, "cell"), score, "pack bigint, slot int, query_id bigint, vec_id bigint, score bigint")


def exact_top_k(queries: DataFrame, candidates: DataFrame, k: int, id: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k candidates of the largest inner product, all of them if there are fewer."""
    spark = candidates.sparkSession
    asked, vectors = whole_vectors(queries, id, vector, scale), whole_vectors(candidates, id, vector, scale)
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    sizes = asked.unionByName(vectors).agg(F.max(F.size("v")).alias("dims"), F.max(norm).alias("norm")).first()
    built = build_index(vectors, Numbers(max(sizes["dims"], 1), sizes["norm"] >= 2.0**53), k) if sizes["dims"] is not None else None
    empty = spark.createDataFrame([], "pack bigint, slot int, query_id bigint, vec_id bigint, score bigint, rank int")
    if built is None:
        return empty.select("query_id", "rank", "vec_id", "score")
    blocks, cells = built
    packs, best, first, last = query_packs(asked, cells), empty, 0, FIRST_CELLS
    while first < len(cells.number):
        full = best.groupBy("pack", "slot").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n")).filter(F.col("n") == k)
        known = full.groupBy("pack").agg(F.map_from_entries(F.collect_list(F.struct("slot", "least"))).alias("best"))  # PACK at most
        wanted = stored(wanted_cells(packs.join(known, "pack", "left"), cells, first, last), "wanted-cells")
        if wanted.isEmpty():  # bounds fall along a query's order, so no later cell is needed either
            break
        found = scored(wanted, blocks, cells, k).unionByName(best.drop("rank"))
        order = Window.partitionBy("pack", "slot").orderBy(F.desc("score"), "vec_id")
        best = stored(found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k), "best-scores")
        first, last = last, last * GROWTH
    return best.select("query_id", "rank", "vec_id", "score")
