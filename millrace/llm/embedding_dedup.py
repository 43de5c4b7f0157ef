"""Embedding near-duplicates by product quantisation.

Unit vectors go to the inverted list of their nearest coarse centroid; their residuals are coded by subspace. A vector
then asks the lists that may hold a near one, those whose bisecting plane with its own list is close enough: of these the
nearest ``probes``, or all for an exact search.
There, distances come from per-query lookup tables over the codes; the coding error of a member bounds how far off
they are, so no near member is lost; what remains is decided by exact cosines in double precision.

Equal vectors are one, with a count. A list's members and askers are cut into blocks, one block pair being a unit of
work, so a list of any size is spread. A unit sends on, for each asker, the number of its links and a spanning forest
of them: never the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, partitions, saved, small_batches

KEY = "vec_id long, key binary, unit binary"


def unit_vector(v: list | None) -> np.ndarray | None:
    """The vector at length 1 in double precision; None if it is null, empty, zero or has null or non-finite parts."""
    if not v or None in v:
        return None
    x = np.asarray(v, np.float64)
    top = np.abs(x).max()
    if not np.isfinite(top) or top == 0:
        return None
    x = x / top
    return x / math.sqrt(float(x @ x))


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        units = [unit_vector(v) for v in b.column(1).to_pylist()]
        raw = [None if u is None else u.tobytes() for u in units]
        keys = [None if r is None else xxhash.xxh3_128_digest(r) for r in raw]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.binary()), pa.array(raw, pa.binary())], ["vec_id", "key", "unit"])


def matrix(cells: list[bytes], dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(cells), np.float64).reshape(len(cells), dims)


def kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Centroids of Lloyd's rounds from distinct starting rows; an empty cluster keeps its centroid."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = nearest(x, c)
        n = np.bincount(own, minlength=len(c))
        order = np.argsort(own, kind="stable")
        full = np.flatnonzero(n)
        c[full] = np.add.reduceat(x[order], np.r_[0, np.cumsum(n[full])[:-1]], axis=0) / n[full, None]
    return c


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1) - 2 * (x @ c.T), 0)


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([squares(x[a : a + 4096], c).argmin(1) for a in range(0, len(x), 4096)])


class ProductIndex:
    """Coarse centroids, subspace codebooks and the reach of a search."""

    def __init__(self, sample: np.ndarray, lists: int, subspaces: int, cosine: float, slack: float, seed: int, probes: int | None = None):
        self.dims = sample.shape[1]
        self.cosine, self.radius = cosine, math.sqrt(2 - 2 * cosine)
        self.reach, self.probes = slack * self.radius, probes
        self.centroids = kmeans(sample, lists, 8, seed)
        c = self.centroids
        self.gaps = np.sqrt(np.maximum(squares(c, c), 1e-12))
        self.spans = [(int(s[0]), int(s[-1]) + 1) for s in np.array_split(np.arange(self.dims), min(subspaces, self.dims))]
        residual = (sample - c[nearest(sample, c)])[:8192]
        self.books = [kmeans(residual[:, a:b], 256, 6, seed + 1 + i) for i, (a, b) in enumerate(self.spans)]

    def asked(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The list of each vector, and whether it asks each list, as a matrix."""
        d = squares(x, self.centroids)
        own = d.argmin(1)
        plane = (d - d[np.arange(len(x)), own][:, None]) / (2 * self.gaps[own])
        plane[np.arange(len(x)), own] = -1
        asks = plane <= self.reach
        if self.probes and self.probes < plane.shape[1]:
            asks &= plane <= np.partition(plane, self.probes - 1, axis=1)[:, self.probes - 1 : self.probes]
        return own, asks

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        """The list of each vector, its codes, its coding error, and the lists it has to ask (its own first)."""
        own, asks = self.asked(x)
        residual = x - self.centroids[own]
        codes, error = np.empty((len(x), len(self.spans)), np.uint8), np.zeros(len(x))
        for i, (a, b) in enumerate(self.spans):
            s = squares(residual[:, a:b], self.books[i])
            codes[:, i] = s.argmin(1)
            error += s[np.arange(len(x)), codes[:, i]]
        return own, codes, np.sqrt(error), [np.flatnonzero(a) for a in asks]

    def table_distances(self, x: np.ndarray, list_: int, codes: np.ndarray) -> np.ndarray:
        """Squared distances between vectors and coded members of a list, from lookup tables."""
        residual = x - self.centroids[list_]
        out = np.zeros((len(x), len(codes)))
        for i, (a, b) in enumerate(self.spans):
            out += squares(residual[:, a:b], self.books[i])[:, codes[:, i]]
        return out


MEMBER, ASKER = 0, 1
UNITS = "unit long, kind int, id long, copies long, codes binary, error double, vector binary"


def _unit(list_: int, member: int, asker: int) -> int:
    return list_ << 40 | member << 20 | asker


def _deal(index: ProductIndex, blocks: dict[int, tuple[int, int]]):
    """Members and askers of every unit. ``blocks``: list to (blocks of members, blocks of askers)."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            ids, copies, cells = (b.column(k).to_pylist() for k in range(3))
            own, codes, error, asks = index.place(matrix(cells, index.dims))
            out = []
            for i, v in enumerate(ids):
                lot = xxhash.xxh64_intdigest(v.to_bytes(8, "little", signed=True))
                mine = int(own[i])
                members, askers = blocks[mine]
                code = codes[i].tobytes()
                out += [(_unit(mine, lot % members, q), MEMBER, v, copies[i], code, float(error[i]), cells[i]) for q in range(askers)]
                for list_ in asks[i].tolist():
                    if list_ in blocks:
                        members, askers = blocks[list_]
                        out += [(_unit(list_, m, lot % askers), ASKER, v, copies[i], None, None, cells[i]) for m in range(members)]
                if len(out) > 8192:
                    yield _rows(out)
                    out = []
            if out:
                yield _rows(out)

    return run


def _rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.float64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], [x.split()[0] for x in UNITS.split(", ")])


def cosines(x: np.ndarray, y: np.ndarray, limit: float) -> np.ndarray:
    """Row-wise cosines of unit vectors; those within 1e-9 of the limit by exactly rounded sums."""
    c = (x * y).sum(1)
    for i in np.flatnonzero(np.abs(c - limit) < 1e-9):
        c[i] = math.fsum((x[i] * y[i]).tolist())
    return c


class _Work:
    """One unit: its members, and what its askers find."""

    def __init__(self, index: ProductIndex, list_: int, rows: list[tuple]):
        self.index, self.list = index, list_
        self.ids = np.array([r[0] for r in rows], np.int64)
        self.copies = np.array([r[1] for r in rows], np.int64)
        self.codes = np.frombuffer(b"".join(r[2] for r in rows), np.uint8).reshape(len(rows), -1)
        self.limit = (index.radius + np.array([r[3] for r in rows]) + 1e-9) ** 2 + 1e-9
        self.vectors = matrix([r[4] for r in rows], index.dims)
        self.root = np.arange(len(rows))
        self.asks: np.ndarray | None = None

    def ask(self, ids: list[int], copies: list[int], cells: list[bytes]) -> Iterator[tuple[int, int | None, int]]:
        """Links and edges of the askers, and links of members that don't ask the list of a linked asker themselves."""
        x, asker = matrix(cells, self.index.dims), np.array(ids, np.int64)
        near = self.index.table_distances(x, self.list, self.codes) <= self.limit
        near &= asker[:, None] != self.ids
        q, m = np.nonzero(near)
        keep = np.concatenate([cosines(x[q[a : a + 50_000]], self.vectors[m[a : a + 50_000]], self.index.cosine) for a in range(0, len(q), 50_000)]) >= self.index.cosine if len(q) else np.empty(0, bool)
        q, m = q[keep], m[keep]
        if not len(q):
            return
        own, _ = self.index.asked(x)
        if len(far := np.flatnonzero(own[q] != self.list)):
            if self.asks is None:
                self.asks = self.index.asked(self.vectors)[1]
            far = far[~self.asks[m[far], own[q[far]]]]
            more = np.bincount(m[far], np.array(copies, np.float64)[q[far]], len(self.ids)).astype(np.int64)
            yield from ((int(self.ids[i]), None, int(more[i])) for i in np.flatnonzero(more))
        edges = np.flatnonzero(np.diff(q)) + 1
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(q)], strict=True):
            v, linked = ids[q[a]], m[a:b]
            yield v, None, int(self.copies[linked].sum())
            roots = np.unique(self.root[linked])
            for r in roots.tolist():
                yield v, int(self.ids[r]), 0
            if len(roots) > 1:
                self.root[np.isin(self.root, roots)] = roots[0]


def _search(index: ProductIndex):
    def send(out):
        a, b, n = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], ["a", "b", "links"])

    def run(batches):
        now, work, members, ids, lots, cells, out = None, None, [], [], [], [], []

        def flush():
            nonlocal work, members, ids, lots, cells
            if ids:
                if work is None and members:
                    work, members = _Work(index, now >> 40, members), []
                if work is not None:
                    out.extend(work.ask(ids, lots, cells))
            ids, lots, cells = [], [], []

        for batch in batches:
            for unit, kind, id_, copies, codes, error, vector in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
                if unit != now:
                    flush()
                    now, work, members = unit, None, []
                if kind == MEMBER:
                    members.append((id_, copies, codes, error, vector))
                else:
                    ids.append(id_), lots.append(copies), cells.append(vector)
                    if len(ids) == 256:
                        flush()
                if len(out) > 20_000:
                    yield send(out)
                    out.clear()
        flush()
        if out:
            yield send(out)

    return run


def near_duplicate_vectors(vectors: DataFrame, *, cosine: float = 0.95, sample: int = 20_000, lists: int | None = None, subspaces: int = 16, slack: float = 0.5, probes: int | None = 8, block: int = 2048, seed: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Links vectors of cosine ``cosine`` or more: vec_id, n_links long (other vectors linked directly), component_id
    long (smallest id reachable by links), kept boolean (vec_id = component_id).

    The index is fitted on at most ``sample`` distinct vectors, chosen by a hash; every vector is indexed and asks.
    ``lists``: coarse centroids (default 2 sqrt(n), at most an eighth of the sample: raise the sample with the table). ``slack``: lists are asked up to this share of the
    search radius behind the bisecting plane, its own and the ``probes`` - 1 nearest of them, so that the work of a
    vector doesn't grow with the number of lists. Without a limit (None) a slack of 0.5 or more finds every link: of two
    linked vectors one at least asks the other's list, and it counts for both if the other doesn't ask.
    ``block``: members, and askers by eight, of one unit of work.

    Defined results: vectors that are null, empty, zero or hold null or non-finite parts link with nothing, nor do
    vectors of unlike dimensions, each of which has an index of its own; a row with a null id is returned with null
    component and kept; equal vectors link with each other; rows that repeat an id are judged each by its own vector,
    and only that vector's links make its component; an empty table gives an empty result; other columns are ignored.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
    keyed = saved(rows.mapInArrow(_keys, KEY), "units")
    valid = keyed.where("unit IS NOT NULL AND vec_id IS NOT NULL")
    facts = None
    for size in sorted(r["bytes"] for r in valid.select(F.length("unit").alias("bytes")).distinct().collect()):  # mostly one
        reps = valid.where(F.length("unit") == size).groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.min_by("unit", "vec_id").alias("unit"))
        reps = saved(reps.withColumn("node", F.monotonically_increasing_id()), "vectors")
        own = _linked(reps, size // 8, cosine, sample, lists, subspaces, slack, probes, block, seed)
        facts = own if facts is None else facts.unionByName(own)
    if facts is None:
        out = keyed.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    else:
        out = keyed.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("key")).alias("key")).join(facts, "key", "left")
        out = out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))).withColumnRenamed("vec_id", id_col)


def _linked(reps: DataFrame, dims: int, cosine: float, sample: int, lists: int | None, subspaces: int, slack: float, probes: int | None, block: int, seed: int) -> DataFrame:
    """(key, n, c) of distinct vectors of one dimension (key, rep, copies, unit, node): links and smallest id reachable."""
    spark, n = reps.sparkSession, reps.count()
    chosen = reps.orderBy(F.xxhash64("rep"), "rep").limit(sample).select("unit")  # at most ``sample`` rows
    index = ProductIndex(matrix([bytes(r[0]) for r in chosen.toLocalIterator()], dims), lists or max(1, min(sample // 8, int(2 * math.sqrt(n)))), subspaces, cosine, slack, seed, probes)

    def count_lists(batches):
        members, askers = (np.zeros(len(index.centroids), np.int64) for _ in range(2))
        for b in batches:
            if b.num_rows:
                own, _, _, asks = index.place(matrix(b.column(0).to_pylist(), dims))
                np.add.at(members, own, 1)
                np.add.at(askers, np.concatenate(asks), 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(members))), pa.array(members), pa.array(askers)], ["list", "members", "askers"])

    counted = reps.select("unit").mapInArrow(count_lists, "list long, members long, askers long").groupBy("list").agg(F.sum("members").alias("m"), F.sum("askers").alias("q"))
    blocks = {r["list"]: (-(-r["m"] // block), max(1, -(-r["q"] // (8 * block)))) for r in counted.collect() if r["m"]}  # as many rows as lists
    dealt = reps.select("node", "copies", "unit").mapInArrow(_deal(index, blocks), UNITS)
    dealt = dealt.repartition(partitions(spark), "unit").sortWithinPartitions("unit", "kind")
    found = saved(dealt.mapInArrow(_search(index), "a long, b long, links long"), "links")
    links = found.where("b IS NULL").groupBy("a").agg(F.sum("links").alias("others"))
    comp = components(found.where("b IS NOT NULL").select("a", "b"))

    # nodes are distinct vectors, numbered as they are stored: ids may repeat
    nodes = reps.select("key", "node", "rep", "copies")
    facts = nodes.join(links.withColumnRenamed("a", "node"), "node", "left").join(comp.withColumnRenamed("id", "node"), "node", "left")
    facts = saved(facts.select("key", "rep", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n"), "component"), "facts")
    linked = facts.where("component IS NOT NULL")
    least = linked.groupBy("component").agg(F.min("rep").alias("c"))
    return linked.join(least, "component").select("key", "n", "c").unionByName(facts.where("component IS NULL").select("key", "n", F.col("rep").alias("c")))
