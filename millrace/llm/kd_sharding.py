"""K-d tree partitioning: splits at distributed weighted medians along the widest metadata dimension.

All of it is DataFrame functions. The points are groups of equal texts, with their bytes as weight; their dimensions are
language, source (of a group the smallest of each) and size class, as codes of at most ``CODES`` values. A node is as
wide in a dimension as the spread of its bytes over all bytes in the order of that dimension: a common measure. A cut
goes through the weighted median of the widest dimension, and inside the median's code by a hash of the text; so a code
that holds any share of the rows can be cut, and copies of a text are neighbours in every order. A group of more than a
little of a shard's bytes is laid out as slices, by hashes of its ids, so that a cut can fall inside it, too.

All nodes of a level are treated together, in two jobs as a rule: the bytes of each code, then the bytes over the hashes
of the median's code. Only these histograms reach the driver: at most ``3 * CODES`` rows for each of the at most
``shards`` nodes, then ``BINS`` rows in all (or two a node, if these are more), whatever the input.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import inline, numbered, saved

#: Codes of a dimension, and bins of the hashes for all nodes of a level together.
CODES, BINS = 1024, 1 << 17
#: A place in a code's order: 32 bits of a hash of the text, then 15 of the slice and 15 of its part.
PLACE_BITS, SLICE_BITS = 62, 15
DIMENSIONS = ("lang", "source", "size_class")
LAW = "bytes"


@dataclass
class Node:
    shards: int
    first: int
    number: int
    dimension: int | None = None
    cut: tuple[int, int] | None = None  # code and place of the first point of the right side
    left: Node | None = None
    right: Node | None = None


def _codes(size: Column, lang: Column, source: Column) -> list[Column]:
    category = lambda c: F.pmod(F.xxhash64(c), F.lit(CODES)).cast("int")
    return [category(lang), category(source), F.least(F.lit(CODES - 1), F.floor(F.log2(size) * (CODES // 32))).cast("int")]


def _step(at: DataFrame, nodes: list[Node], how: str) -> DataFrame:
    """The points of the next level: each goes to the left or right child of its node. An inner join drops the points of
    nodes that aren't given, a left join keeps them where they are."""
    table = inline(at.sparkSession, [(n.number, n.dimension, *n.cut, n.left.number, n.right.number) for n in nodes], "__n, __d, __code, __place, __left, __right")
    code = F.element_at(F.array(*(f"c{d}" for d in range(len(DIMENSIONS)))), F.col("__d").cast("int") + 1)
    left = (code < F.col("__code")) | ((code == F.col("__code")) & (F.col("place") < F.col("__place")))
    child = F.when(F.col("__n").isNull(), F.col("node")).when(left, F.col("__left")).otherwise(F.col("__right"))
    return at.join(table, F.col("node") == F.col("__n"), how).withColumn("node", child).select(*at.columns)


def place_points(points: DataFrame, root: Node) -> DataFrame:
    """``points`` with their ``shard``."""
    at, level, leaves = points.withColumn("node", F.lit(0).cast("long")), [root], []
    while level:
        split = [n for n in level if n.left]
        leaves += [(n.number, n.first) for n in level if not n.left]
        at = _step(at, split, "left") if split else at
        level = [c for n in split for c in (n.left, n.right)]
    homes = inline(points.sparkSession, leaves, "__n, shard")
    return at.join(homes, F.col("node") == F.col("__n")).select(*points.columns, F.col("shard").cast("int"))


def spread(hist: dict[int, int], position: dict[int, float]) -> float:
    """The standard deviation of the bytes of ``hist`` (by code) over the positions of the codes."""
    total = sum(hist.values())
    mean = sum(b * position[c] for c, b in hist.items()) / total
    return (sum(b * (position[c] - mean) ** 2 for c, b in hist.items()) / total) ** 0.5


def positions(hist: dict[int, int]) -> dict[int, float]:
    """The share of all bytes below the middle of each code."""
    out, below, total = {}, 0, sum(hist.values())
    for c, b in sorted(hist.items()):
        out[c] = (below + b / 2) / total
        below += b
    return out


def median(hist: dict[int, int], goal: float, before: int) -> tuple[int, int, int]:
    """(the key at which the bytes reach ``goal``, the bytes before it, its own)."""
    for key, b in sorted(hist.items()):
        if before + b >= goal:
            break
        before += b
    return (key, before, b) if before + b >= goal else (key, before - b, b)


def build_tree(points: DataFrame, shards: int, slack: float) -> Node:
    """The tree over points (c0, c1, c2 int, place long, bytes long). A cut is off by at most ``slack`` bytes, or by the
    bytes of one point."""
    root, count = Node(shards, 0, 0), 1
    dims = range(len(DIMENSIONS))
    position: list[dict[int, float]] = []
    at, todo = points.select(*(f"c{d}" for d in dims), "place", "bytes", F.lit(0).cast("long").alias("node")), [root] if shards > 1 else []
    while todo:
        each = at.select("node", "bytes", F.explode(F.array(*(F.struct(F.lit(d).alias("d"), F.col(f"c{d}").alias("c")) for d in dims))).alias("x"))
        hist: dict[tuple[int, int], dict[int, int]] = {}
        for r in each.groupBy("node", F.col("x.d").alias("d"), F.col("x.c").alias("c")).agg(F.sum("bytes").alias("bytes")).collect():
            hist.setdefault((r["node"], r["d"]), {})[r["c"]] = r["bytes"]
        if not position and hist:
            position = [positions(hist[0, d]) for d in dims]
        nodes = {n.number: n for n in todo}
        goals: dict[int, float] = {}
        reach: dict[int, tuple[int, int, int]] = {}  # node: first place, last place, bytes before the first
        for node in todo:
            if (node.number, 0) not in hist:  # a node without points
                node.dimension, node.cut = 0, (0, 0)
                continue
            node.dimension = max(dims, key=lambda d, n=node.number: (spread(hist[n, d], position[d]), -d))
            own = hist[node.number, node.dimension]
            goals[node.number] = goal = sum(own.values()) * (node.shards // 2) / node.shards
            code, before, inside = median(own, goal, 0)
            if goal - before <= slack or before + inside - goal <= slack:
                node.cut = (code, 0) if goal - before <= before + inside - goal else (code + 1, 0)
            else:
                node.cut = (code, 0)
                reach[node.number] = 0, (1 << PLACE_BITS) - 1, before
        while reach:
            bins_each = max(2, BINS // len(reach))
            widths = {n: -(-(b - a + 1) // bins_each) for n, (a, b, _) in reach.items()}
            table = inline(points.sparkSession, [(n, nodes[n].dimension, nodes[n].cut[0], a, b, widths[n]) for n, (a, b, _) in reach.items()], "__n, __d, __code, first, last, width")
            near = at.join(table, F.col("node") == F.col("__n")).where((F.element_at(F.array(*(f"c{d}" for d in dims)), F.col("__d").cast("int") + 1) == F.col("__code")) & F.col("place").between(F.col("first"), F.col("last")))
            bins: dict[int, dict[int, int]] = {}
            for r in near.groupBy("node", F.expr("(place - first) div width").alias("bin")).agg(F.sum("bytes").alias("bytes")).collect():
                bins.setdefault(r["node"], {})[r["bin"]] = r["bytes"]
            for n, (a, _, before) in list(reach.items()):
                bin_, before, inside = median(bins[n], goals[n], before)
                start, low, high = a + bin_ * widths[n], goals[n] - before, before + inside - goals[n]
                if min(low, high) > slack and widths[n] > 1:
                    reach[n] = start, start + widths[n] - 1, before
                    continue
                nodes[n].cut = nodes[n].cut[0], start if low <= high else start + widths[n]
                del reach[n]
        for node in todo:
            half = node.shards // 2
            node.left, node.right = Node(half, node.first, count), Node(node.shards - half, node.first + half, count + 1)
            count += 2
        at = _step(at, todo, "inner")
        todo = [c for n in todo for c in (n.left, n.right) if c.shards > 1]
    return root


def sliced(points: DataFrame, slack: float) -> tuple[DataFrame, DataFrame]:
    """(the rows with the ``slice`` of their group; the points of the tree: h, slice, c0, c1, c2, place, bytes).

    ``points``: doc_id, uid, size, h (hash of the text), lang, source. A group of more than ``slack`` bytes is laid out
    in slices of about so many, by a hash of the id; a slice of four times as many, as of one repeated id, in parts, by
    a hash of the row number ``uid``. The tables of both hold at most one row for each ``slack`` bytes of the input.
    """
    most = (1 << SLICE_BITS) - 1
    pieces = lambda b: F.least(F.lit(most), F.ceil(F.col(b) / F.lit(slack))).cast("long")
    codes = [c.alias(f"c{i}") for i, c in enumerate(_codes(F.col("size"), F.col("lang"), F.col("source")))]
    groups = points.groupBy("h").agg(F.min("lang").alias("lang"), F.min("source").alias("source"), F.min("size").alias("size"), F.count("*").alias("n"), F.sum("size").alias("bytes"))
    groups = saved(groups.select("h", "n", "bytes", *codes), "groups")
    large = (F.col("n") > 1) & (F.col("bytes") > F.lit(slack))
    wide = F.broadcast(groups.where(large).select(F.col("h").alias("wh"), pieces("bytes").alias("m"), "c0", "c1", "c2"))
    cut = points.join(wide, F.col("h") == F.col("wh"), "left").withColumn("p", F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("m")), F.lit(0)))
    heavy = cut.where("m IS NOT NULL").groupBy("h", "p").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).where((F.col("n") > 1) & (F.col("bytes") > F.lit(4 * slack)))
    heavy = F.broadcast(saved(heavy.select(F.col("h").alias("hh"), F.col("p").alias("hp"), pieces("bytes").alias("m2")), "heavy"))
    cut = cut.join(heavy, (F.col("h") == F.col("hh")) & (F.col("p") == F.col("hp")), "left")
    part = F.coalesce(F.pmod(F.xxhash64("uid"), F.col("m2")), F.lit(0))
    rows = cut.withColumn("slice", F.shiftleft(F.col("p"), SLICE_BITS) + part)
    parts = rows.where("m IS NOT NULL").groupBy("h", "slice", "c0", "c1", "c2").agg(F.sum("size").alias("bytes"))
    whole = groups.where(~large).select("h", F.lit(0).cast("long").alias("slice"), "c0", "c1", "c2", "bytes")
    place = F.shiftleft(F.pmod(F.xxhash64("h", F.lit(1)), F.lit(1 << PLACE_BITS - 2 * SLICE_BITS)), 2 * SLICE_BITS) + F.col("slice")
    return rows.select(*points.columns, "slice"), saved(whole.unionByName(parts).withColumn("place", place), "points")


def kd_shards(docs: DataFrame, shards: int | None = None, *, target_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", tolerance: float = 0.001) -> DataFrame:
    """Puts every row into one of ``shards`` shards of nearly equal bytes (or of about ``target_bytes`` each).

    Returns doc_id, size long (UTF-8 bytes of the text plus 16), text_crc32 long, law 'bytes', shard int, slot long
    (0, 1, ... in the shard). Copies of a text, whatever their language and source, share a shard unless a cut falls
    into their group, which happens to at most ``shards - 1`` groups. ``tolerance``: how far a cut may be off, as a share
    of a shard.

    Defined results: a null text has no bytes and a null checksum, and all null texts are one group; null languages and
    sources are categories; rows that repeat an id or are all alike stay, with slots of their own, and are spread like
    others; an empty table gives an empty result; other columns are ignored.
    """
    if (shards is None) == (target_bytes is None):
        raise ValueError("give either shards or target_bytes")
    t = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.coalesce(F.octet_length(t), F.lit(0)) + 16).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"), F.xxhash64(t).alias("h"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"))
    rows = saved(rows.withColumn("uid", F.monotonically_increasing_id()), "rows")
    total = rows.agg(F.sum("size")).first()[0] or 0
    if shards is None:
        shards = max(1, -(-total // target_bytes))
    # at least a millionth of the input: the tables of slices stay that small for any number of shards
    slack = max(1.0, tolerance * total / shards, total / 1e6)
    keyed, points = sliced(rows, slack)
    tree = build_tree(points, shards, slack)
    homes = place_points(points, tree).select("h", "slice", "shard")
    placed = keyed.join(homes, ["h", "slice"]).select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "uid")
    return numbered(placed, "shard", ["uid"], "slot").drop("uid")
