"""N-gram Jaccard join with token-combination prefixes.

Tokens (shingles) are ordered by (document frequency, value). Two sets of similarity s or more share at least L tokens
within their prefixes of n - ceil(s n) + L tokens. Tokens of low frequency are indexed singly. Frequent ones are dealt
by a hash into g = L - 1 classes, and pairs within a class are indexed: of L shared frequent tokens, two fall into the
same class. With g in proportion to the size of the sets, a set has signatures in proportion to its size. g depends on
the size class (powers of two); sets near the limit of a class carry the signatures of both. A set whose prefix for
L = 1 has only rare tokens needs no more than these. So every pair of similar sets meets under a common signature.

Steps, each on all rows:

1. Every text becomes a sorted array of 64-bit shingle hashes and a 128-bit id of the set. A flush is some thousand
   texts of one task; its equal sets are one.
2. The distinct tokens of a flush go, packed as byte planes, to ranges by value, each with the number of its sets; those of
   two or more sets in all go back to their flush with the frequency. So a token is counted in one place, but by flushes,
   never by texts. The sets that hold it wait where the flush is gathered. A token of one set only can't be shared: it
   only fills the prefix.
3. Equal sets become one, and sets with enough shared tokens for any link are written out, with these tokens (enough for exact overlaps) and a
   1024-bit parity map of them, which bounds the difference of two sets from below.
4. In the list of a signature, members are compared with a hub of the list; each member takes its nearest hub, and an
   exact overlap decides. Lists of a few signatures of each set link most near copies so. Then all signatures are
   listed by component, and components that meet in a list are compared member by member, by parity maps inside the
   join, then exactly. So the components are exact, while a list that is one group of near copies costs its length,
   not its square.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, partitions, saved, small_batches

MAP_BITS = 1024
SEEDS = 6
FEW_PAIRS = 500_000
#: Ranges of token values for each shuffle partition; one range is in memory at a time.
FINER = 4
NO_ID = -(1 << 63)
FLUSH_TOKENS = 1_000_000
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased."""
    h = xxhash.xxh64_intdigest
    return np.array([h(w) for w in text.lower().split()], dtype=np.uint64)


def shingle_set(text: bytes | None, width: int) -> np.ndarray:
    """The sorted distinct hashes of the ``width``-word shingles; fewer words make one shingle, none make none."""
    if not text:
        return np.empty(0, np.uint64)
    words = word_hashes(text)
    n = len(words)
    if n == 0:
        return words
    span = min(width, n)
    out = np.full(n - span + 1, span, np.uint64)
    for k in range(span):
        out = (out ^ words[k : n - span + 1 + k]) * _M1
        out ^= out >> np.uint64(29)
        out *= _M2
        out ^= out >> np.uint64(32)
    return np.unique(out)


def planes(a: np.ndarray) -> bytes:
    """The bytes of an array, first all highest ones: sorted values then compress well."""
    return a.astype(a.dtype.newbyteorder(">"), copy=False).view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes()


def unplanes(b: bytes, kind: str, n: int, at: int) -> tuple[np.ndarray, int]:
    dt = np.dtype(kind)
    end = at + n * dt.itemsize
    raw = np.frombuffer(b, np.uint8, n * dt.itemsize, at).reshape(dt.itemsize, n).T
    return np.ascontiguousarray(raw).view(dt.newbyteorder(">")).reshape(n).astype(dt), end


def pack(*columns: np.ndarray) -> bytes:
    return len(columns[0]).to_bytes(4, "little") + b"".join(planes(c) for c in columns)


def unpack(b: bytes, kinds: str, at: int = 0) -> tuple[list[np.ndarray], int]:
    n, at, out = int.from_bytes(b[at : at + 4], "little"), at + 4, []
    for k in kinds.split():
        a, at = unplanes(b, k, n, at)
        out.append(a)
    return out, at


def part_of(h: np.ndarray, parts: int) -> np.ndarray:
    """The partition of a hash by its value, so that sorted hashes have sorted partitions."""
    return ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def home(flush, parts: int):
    """The partition that gathers the sets of a flush (a number or an array of them), by a mixing hash."""
    x = np.atleast_1d(np.asarray(flush, np.int64)).view(np.uint64) * _M1
    at = part_of((x ^ (x >> np.uint64(29))) * _M2, parts)
    return at if np.ndim(flush) else int(at[0])


def cut(parts_sorted: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(partition, start, end) of the runs."""
    edges = np.flatnonzero(np.diff(parts_sorted)) + 1
    for a, b in pairwise([0, *edges.tolist(), len(parts_sorted)]):
        if b > a:
            yield int(parts_sorted[a]), a, b


def batch(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    part, flush, kind, blob = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(flush, pa.int64()), pa.array(kind, pa.int32()), pa.array(blob, pa.binary())], ["part", "flush", "kind", "blob"])


PACKED = "part int, flush long, kind int, blob binary"
DOCS, PLACES, TOKENS, SHARED = range(4)
#: Distinct tokens of a flush whose places travel in one row.
PIECE = 8192


def chunks(rows: Iterator[tuple[int, int, int, bytes]], limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r[3])
        if size >= limit:
            yield batch(held)
            held, size = [], 0
    if held:
        yield batch(held)


def make_sets(width: int, parts: int):
    """Texts to packed rows: the distinct tokens of a flush by value, with the number of their sets; and, where the flush
    is gathered, the places of these sets, and the records (place, doc_id, n, set id) of the documents. Equal sets of a
    flush share a place."""

    def flush(number: int, ids: list, arrays: list) -> Iterator[tuple[int, int, int, bytes]]:
        places: dict[bytes, int] = {}
        uniq: list[np.ndarray] = []
        keys = []
        for a in arrays:
            key = xxhash.xxh3_128_digest(a.tobytes())
            keys.append(key)
            if key not in places:
                places[key] = len(uniq)
                uniq.append(a)
        place = np.array([places[k] for k in keys], np.uint16)
        ids_of_sets = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
        n = np.array([len(a) for a in arrays], np.int64)
        at = home(number, parts)
        yield at, number, DOCS, pack(place, np.array(ids, np.int64), n, ids_of_sets[:, 0], ids_of_sets[:, 1])
        tok = np.concatenate(uniq)
        who = np.repeat(np.arange(len(uniq), dtype=np.uint16), [len(a) for a in uniq])
        o = np.argsort(tok, kind="stable")
        tok, who = tok[o], who[o]
        starts = np.flatnonzero(np.r_[True, tok[1:] != tok[:-1]]) if len(tok) else np.empty(0, np.int64)
        ends = np.r_[starts, len(tok)]
        tok, sets = tok[starts], np.diff(ends).astype(np.uint16)
        for a in range(0, len(tok), PIECE):
            b = min(len(tok), a + PIECE)
            yield at, number, PLACES, a.to_bytes(4, "little") + pack(sets[a:b]) + pack(who[ends[a] : ends[b]])
        for p, a, b in cut(part_of(tok, parts * FINER)):
            yield p, number, TOKENS, a.to_bytes(4, "little") + pack(tok[a:b], sets[a:b])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, bytes]]:
        number, ids, arrays, held = TaskContext.get().partitionId() << 24, [], [], 0
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                a = shingle_set(t.as_py(), width)
                ids.append(NO_ID if i is None else i)
                arrays.append(a)
                held += len(a)
                if held >= FLUSH_TOKENS or len(ids) == (1 << 16) - 1:
                    yield from flush(number, ids, arrays)
                    number, ids, arrays, held = number + 1, [], [], 0
        if ids:
            yield from flush(number, ids, arrays)

    return lambda batches: chunks(rows(batches))


def return_shared(parts: int):
    """Of the tokens of a range, those in two or more sets go back to their flushes, by number, with the frequency. Other
    rows pass."""

    def answers(held: list[tuple[int, bytes]]) -> Iterator[tuple[int, int, int, bytes]]:
        arrays = [unpack(blob, "u8 u2", 4)[0] for _, blob in held]
        tok = np.concatenate([t for t, _ in arrays])
        o = np.argsort(tok, kind="stable")
        starts = np.flatnonzero(np.diff(tok[o], prepend=~tok[o][:1]))
        df = np.empty(len(tok), np.int64)
        df[o] = np.repeat(np.add.reduceat(np.concatenate([c for _, c in arrays])[o].astype(np.int64), starts), np.diff(np.r_[starts, len(tok)]))
        at = 0
        for (number, blob), (own, _) in zip(held, arrays, strict=True):
            many = np.flatnonzero(df[at : at + len(own)] >= 2)
            if len(many):
                first = int.from_bytes(blob[:4], "little")
                yield home(number, parts), number, SHARED, pack((first + many).astype(np.uint32), own[many], np.minimum(df[at + many], (1 << 32) - 1).astype(np.uint32))
            at += len(own)

    def rows(batches):
        now, held = None, []
        for b in batches:
            for part, number, kind, blob in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                if kind != TOKENS:
                    yield part, number, kind, blob
                    continue
                if part != now and held:
                    yield from answers(held)
                    held = []
                now = part
                held.append((number, blob))
        if held:
            yield from answers(held)

    return lambda batches: chunks(rows(batches))


def by_flush(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[int, list[bytes]]]:
    """The blobs of one flush after another, by kind; rows come sorted by it."""
    now, held = None, {}
    for b in batches:
        for number, kind, blob in zip(*(b.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
            if number != now and held:
                yield held
                held = {}
            now = number
            held.setdefault(kind, []).append(blob)
    if held:
        yield held


SETS = "kind int, doc_id long, n long, h1 long, h2 long, rare int, shared array<long>, parity array<long>"


def gather_sets(percent: int, rare_df: int):
    """Documents (kind 0) with the id of their set; and (kind 1) the sets of a flush with shared tokens enough for a
    link: their smallest doc_id, these tokens by frequency, how many of them are rare, and their parity map."""

    def emit(kind, doc_id, n, h1, h2, rare, shared, parity):
        size = len(n)
        fill = lambda x, t: pa.nulls(size, t) if x is None else pa.array(x, t)
        cols = [pa.array(np.full(size, kind), pa.int32()), fill(doc_id, pa.int64()), *(pa.array(x, pa.int64()) for x in (n, h1, h2)), fill(rare, pa.int32()), fill(shared, pa.list_(pa.int64())), fill(parity, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in SETS.split(", ")])

    def run(batches):
        for held in by_flush(batches):
            first: dict[int, tuple] = {}  # place of a set: smallest id, n, set id
            for blob in held.pop(DOCS):
                (place, doc, n, h1, h2), _ = unpack(blob, "u2 i8 i8 i8 i8")
                yield emit(0, pa.array(doc, mask=doc == NO_ID), n, h1, h2, None, None, None)
                for w, d, *rest in zip(*(x.tolist() for x in (place, doc, n, h1, h2)), strict=True):
                    if d != NO_ID and (w not in first or d < first[w][0]):
                        first[w] = d, *rest
            shared = [unpack(b, "u4 u8 u4")[0] for b in held.pop(SHARED, [])]
            if not shared:
                continue
            counts, places = [], []
            for blob in sorted(held.pop(PLACES), key=lambda b: int.from_bytes(b[:4], "little")):
                (sets,), at = unpack(blob, "u2", 4)
                counts.append(sets)
                places.append(unpack(blob, "u2", at)[0][0])
            sets, who = np.concatenate(counts).astype(np.int64), np.concatenate(places)
            del counts, places
            number, tok, df = (np.concatenate(x) for x in zip(*shared, strict=True))
            n_sets = sets[number]
            starts = (np.cumsum(sets) - sets)[number]
            place = who[np.repeat(starts - np.cumsum(n_sets) + n_sets, n_sets) + np.arange(n_sets.sum())]
            tok, df = np.repeat(tok, n_sets), np.repeat(df, n_sets)
            o = np.lexsort((tok, df, place))
            place, tok, df = place[o], tok[o], df[o]
            starts = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
            out = []
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(tok)], strict=True):
                at = first.get(int(place[a]))
                if at is None or 100 * (b - a) < percent * at[1]:
                    continue
                bits = np.bincount(tok[a:b] % np.uint64(MAP_BITS), minlength=MAP_BITS).astype(np.uint8) & 1
                out.append((*at, int((df[a:b] <= rare_df).sum()), tok[a:b].view(np.int64), np.packbits(bits).view(np.int64)))
                if len(out) == 1000:
                    yield emit(1, *zip(*out, strict=True))
                    out = []
            if out:
                yield emit(1, *zip(*out, strict=True))

    return run


def size_classes(n: int, percent: int) -> list[int]:
    """The size classes in which a set of ``n`` tokens meets all sets of similar size."""
    low, high = -(-percent * n // 100), n * 100 // percent
    return list(range(low.bit_length(), high.bit_length() + 1))


def set_signatures(n: int, rare: int, shared: np.ndarray, percent: int) -> np.ndarray:
    """The signatures of a set: ``shared`` holds its tokens of frequency 2 or more, the first ``rare`` of them rare."""
    lone, slack = n - len(shared), n + (-percent * n // 100)  # slack: tokens that a similar set may miss
    if slack + 1 - lone <= rare:
        return shared[: max(0, slack + 1 - lone)]
    out, longest = [], 0
    for c in size_classes(n, percent):
        g = max(1, min((100 - percent) * (1 << c) // 150, percent * percent * (1 << c) // 20_000 - 1))
        end = min(len(shared), slack + g + 1 - lone)
        longest = max(longest, end)
        often = shared[rare:end]
        lot = ((often * _M1) >> np.uint64(33)) % np.uint64(g)
        order = np.lexsort((often, lot))
        often, lot = often[order], lot[order]
        for k in range(1, len(often)):
            same = lot[k:] == lot[:-k]
            if not same.any():
                break
            x = (often[:-k][same] * _M1) ^ (often[k:][same] + np.uint64(c * int(_M2) & (1 << 64) - 1))
            out.append((x ^ (x >> np.uint64(31))) * _M2)
    return np.concatenate([shared[: min(rare, longest)], *out])


def signatures(percent: int, seeds: int | None = None, salt: int = 0):
    """(sig, id, component) rows of the sets: all signatures, or only the ``seeds`` smallest by a salted hash."""

    def run(batches):
        for b in batches:
            for rep, component, n, rare, shared in zip(*(b.column(k) for k in range(5)), strict=True):
                tok = shared.values.to_numpy(zero_copy_only=False).view(np.uint64)
                all_ = set_signatures(n.as_py(), rare.as_py(), tok, percent)
                if seeds is not None and len(all_) > seeds:
                    key = (all_ ^ np.uint64(salt * 0x5851F42D4C957F2D & (1 << 64) - 1)) * _M1
                    all_ = all_[np.argpartition(key ^ (key >> np.uint64(31)), seeds)[:seeds]]
                for a in range(0, len(all_), 200_000):
                    s = all_[a : a + 200_000].view(np.int64)
                    ids = (pa.array(np.full(len(s), x.as_py()), pa.int64()) for x in (rep, component))
                    yield pa.RecordBatch.from_arrays([pa.array(s), *ids], ["sig", "id", "component"])

    return run


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) with ``linked`` boolean, by exact overlaps.

    Where the pairs are few, which is counted, their ids go to the sets, so that only the sets they name are moved.
    """
    pairs = saved(pairs, "pairs")
    if pairs.count() <= FEW_PAIRS:
        named = pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct()
        sets = sets.join(F.broadcast(named), "rep", "left_semi")
    left = sets.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("shared").alias("sa"))
    right = sets.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("shared").alias("sb"))
    both = pairs.join(right, "b").join(left, "a").withColumn("inter", F.size(F.array_intersect("sa", "sb")).cast("long"))
    return both.select("a", "b", (100 * F.col("inter") >= percent * (F.col("na") + F.col("nb") - F.col("inter"))).alias("linked"))


def least_difference(x: str, y: str) -> Column:
    """A lower bound of the difference of two sets (structs of ``lone`` tokens and a ``parity`` map)."""
    bits = F.aggregate(F.zip_with(f"{x}.parity", f"{y}.parity", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda a, v: a + v)
    return F.col(f"{x}.lone") + F.col(f"{y}.lone") + bits


def may_link(x: str, y: str, percent: int) -> Column:
    """False only if the sets can't be similar enough: similarity s bounds the difference by (1 - s) / (1 + s) of both sizes."""
    both = F.col(f"{x}.n") + F.col(f"{y}.n")
    size = 100 * F.least(f"{x}.n", f"{y}.n") >= percent * F.greatest(f"{x}.n", f"{y}.n")
    return size & ((100 + percent) * least_difference(x, y) <= (100 - percent) * both)


def ngram_jaccard_join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, rare_df: int = 256, seed_rounds: int = 6) -> DataFrame:
    """Links documents whose sets of ``width``-word shingles have a Jaccard similarity of ``percent`` / 100 or more.

    Returns one row per input row: ``id_col`` long, ``n_shingles`` long (set size), ``copy_of`` long (smallest id with
    the same set), ``component_id`` long (smallest id reachable by links). Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z
    lower-cased; a text of fewer words is one shingle.

    Defined results: a null, empty or word-less text has an empty set and is linked with nothing; a row with a null id
    is returned with null ids and linked with nothing; rows that repeat an id are all returned, each with the component
    of its own text, which the other texts of the id neither join nor widen; an empty table gives an empty result; other columns are neither read nor returned.

    ``rare_df``: up to this frequency tokens are indexed singly; pairs are about twice as many as single tokens. ``seed_rounds``: most rounds of hub comparisons before all that is left is compared. Neither changes the result.
    """
    if not 51 <= percent <= 99:
        raise ValueError("percent must lie between 51 and 99")
    spark = docs.sparkSession
    small_batches(spark)
    parts = partitions(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    moved = rows.mapInArrow(make_sets(width, parts), PACKED).repartition(parts, "part").sortWithinPartitions("part")
    moved = moved.mapInArrow(return_shared(parts), PACKED).repartition(parts, "part").sortWithinPartitions("flush", "kind")
    all_sets = saved(moved.mapInArrow(gather_sets(percent, rare_df), SETS), "sets", partition_by="kind")
    members = all_sets.where("kind = 0").select("doc_id", F.col("n").alias("n_shingles"), "h1", "h2")
    reps = members.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"))
    reps = saved(reps.withColumn("number", F.monotonically_increasing_id()), "reps")
    # nodes are distinct sets: named by their smallest id, or, where an id has several, by the number of their row
    unique = reps.groupBy("rep").count().where("count > 1").isEmpty()
    nodes = reps.select("h1", "h2", "rep", F.col("rep" if unique else "number").alias("node"))
    sets = all_sets.where("kind = 1").withColumnRenamed("doc_id", "rep").join(nodes, ["h1", "h2", "rep"])
    sets = saved(sets.select(F.col("node").alias("rep"), "n", "rare", "shared", "parity"), "distinct")

    comp = components(set_links(sets, percent, seed_rounds)).withColumnRenamed("id", "node")
    if not unique:
        comp = comp.join(nodes.select("node", "rep"), "node")
        least = comp.groupBy("component").agg(F.min("rep").alias("least"))
        comp = comp.join(least, "component").select("node", F.col("least").alias("component"))
    facts = nodes.join(comp, "node", "left").select("h1", "h2", "rep", F.coalesce("component", "rep").alias("component"))
    out = members.join(facts, ["h1", "h2"], "left")
    known = F.col("doc_id").isNotNull()
    out = out.select("doc_id", "n_shingles", F.when(known, F.coalesce("rep", "doc_id")).alias("copy_of"), F.when(known, F.coalesce("component", "doc_id")).alias("component_id"))
    return out.withColumnRenamed("doc_id", id_col)


def offered(rows: DataFrame, facts: DataFrame, tried: DataFrame | None, percent: int, salt: int) -> DataFrame:
    """For each member of a list with several components its nearest hub that may link and wasn't tried: pairs (a, b).

    The hub of a list is its smallest id in the first round, then a member chosen by a salted hash.
    """
    first = F.col("id") if salt == 0 else F.xxhash64("id", F.lit(salt))
    hubs = rows.groupBy("sig").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min_by(F.struct("id", "component"), first).alias("h")).where("lo < hi")
    hubs = hubs.select("sig", F.col("h.id").alias("hub"), F.col("h.component").alias("hub_component"))
    offers = rows.join(hubs, "sig").where("hub_component <> component").select("hub", "id").distinct()
    offers = offers.join(facts, "id").join(facts.select(F.col("id").alias("hub"), F.col("s").alias("hs")), "hub").where(may_link("s", "hs", percent))
    offers = offers.select("id", "hub", least_difference("s", "hs").alias("d"))
    if tried is not None:
        offers = offers.join(tried.select(F.col("a").alias("hub"), F.col("b").alias("id")), ["hub", "id"], "left_anti")
    return offers.groupBy("id").agg(F.min_by("hub", F.struct("d", "hub")).alias("hub")).select(F.col("hub").alias("a"), F.col("id").alias("b"))


def set_links(sets: DataFrame, percent: int, seed_rounds: int) -> DataFrame:
    """Edges (a, b) between sets that span every component of the similarity graph.

    Seed rounds, while they find links, join most near copies by a few signatures of each set. Then all signatures are
    listed by component: two components that meet in a list are compared member by member, by parity maps inside the
    join. Of what may link, the nearest pair of two components is checked first, the rest only if they stay apart.
    """
    facts = sets.select(F.col("rep").alias("id"), F.struct("n", (F.col("n") - F.size("shared")).alias("lone"), "parity").alias("s"))
    links, tried = sets.sparkSession.createDataFrame([], "a long, b long"), None
    comp = None

    def placed(df: DataFrame, key: str) -> DataFrame:
        if comp is None:
            return df.withColumn("component", F.col(key))
        return df.join(comp.withColumnRenamed("id", "__id"), F.col(key) == F.col("__id"), "left").withColumn("component", F.coalesce("component", key)).drop("__id")

    def signed(seeds: int | None, salt: int) -> DataFrame:
        return placed(sets, "rep").select("rep", "component", "n", "rare", "shared").mapInArrow(signatures(percent, seeds, salt), "sig long, id long, component long")

    for round_ in range(seed_rounds):
        found = saved(verified(offered(signed(SEEDS, round_), facts, tried, percent, round_), sets, percent), "checked")
        tried = found if tried is None else tried.unionByName(found)
        if found.where("linked").isEmpty():
            break
        links = tried.where("linked").select("a", "b")
        comp = components(links)

    cells = signed(None, 0).select("sig", "component").distinct()
    # lists of the same components need one signature only: these are compared by two sums of hashes
    marks = [F.bit_xor(F.xxhash64("component", F.lit(i))).alias(f"x{i}") for i in range(2)]
    lists = cells.groupBy("sig").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), *marks).where("lo < hi")
    cells = saved(cells.join(lists.groupBy("lo", "hi", "x0", "x1").agg(F.min("sig").alias("sig")), "sig", "left_semi"), "open")
    if cells.isEmpty():
        return links
    members = saved(placed(facts, "id"), "members")
    sizes = members.groupBy("component").agg(F.count("*").alias("size"), F.min("s").alias("s")).withColumn("alone", F.when(F.col("size") == 1, F.col("s"))).drop("s")
    cells = cells.join(sizes, "component")
    one, two = (cells.select("sig", *(F.col(c).alias(f"{c}{i}") for c in ("component", "size", "alone"))) for i in (1, 2))
    # the smaller component first; single sets are ruled out at once
    order = (F.struct("size1", "component1") < F.struct("size2", "component2")) & (F.col("alone1").isNull() | F.col("alone2").isNull() | may_link("alone1", "alone2", percent))
    met = one.join(two, (one["sig"] == two["sig"]) & order).select(F.col("component1").alias("c1"), F.col("component2").alias("c2")).distinct()
    left = members.select(F.col("component").alias("c1"), F.col("id").alias("a"), F.col("s").alias("x"))
    right = members.select(F.col("component").alias("c2"), F.col("id").alias("b"), F.col("s").alias("y"))
    near = saved(met, "met").join(left, "c1").join(right, "c2").where(may_link("x", "y", percent))
    near = near.select("c1", "c2", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), least_difference("x", "y").alias("d"))
    near = saved(near.join(tried, ["a", "b"], "left_anti") if tried is not None else near, "near")

    first = near.groupBy("c1", "c2").agg(F.min_by(F.struct("a", "b"), F.struct("d", "a", "b")).alias("p")).select("p.a", "p.b")
    found = saved(verified(first, sets, percent), "checked")
    links = links.unionByName(found.where("linked").select("a", "b"))
    comp = components(links)
    rest = placed(near.withColumnRenamed("c1", "k1"), "a").withColumnRenamed("component", "now1")
    rest = placed(rest, "b").where("now1 <> component").select("a", "b").join(found, ["a", "b"], "left_anti")
    return saved(links.unionByName(verified(rest, sets, percent).where("linked").select("a", "b")), "links")
