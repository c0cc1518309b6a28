"""Hard negatives from STR-packed R-trees.

The vectors (integers) are tiled: cut by quantiles of the coordinate that varies
most, each slab by quantiles of the next one; what is still too large, by ties or
by the bound on slabs, is cut by a hash.  Each tile is a block with an R-tree of
its own, packed by sorting, cutting and sorting again (sort-tile-recursive): by
label, then by the coordinates in the order of their variance.  A node's box holds
the smallest and largest value of label and every coordinate.

The inner product of a vector and anything in a box lies in an interval: the sum
over the coordinates of the smaller and the larger product with the two sides.
A search keeps the nodes in a queue, the largest upper end first.  Boxes without
a suitable label and those whose interval misses the score window are dropped;
the search ends when the first upper end is strictly below the k-th score found
(an equal one may hold a smaller id).  Both searches are exact: the nearest rows
of the anchor's label, and for each of them the best rows of other labels within
the window that its score gives.

Every anchor meets every block once in each search, in tasks of their own; of a
block, only k rows for each anchor or window leave its task.  The anchors are
what is sent to the blocks, never the other way round.

Results for odd input: rows without id or label, with a null vector or with null
or non-finite components take no part; vectors are compared with those of their
own length only; rows with the anchor's id are its own; rows that repeat an id
are rows of their own; an id that stands for several different anchors has the rows
of each; anchors that are equal in all are one; equal scores go to the smaller id;
other columns, whatever their names, are not looked at; an empty table gives an
empty table.  Scores are longs; vectors so large that sums of products do not fit
are not supported.
"""

from __future__ import annotations

import bisect
import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.session import materialize

SCALE = 256
#: Rows of a block, of a leaf, and children of a node.
BLOCK_ROWS = 4096
LEAF = 256
FANOUT = 4
#: Slabs of one coordinate: at most SLABS ** 2 quantiles are sent to the tasks.
SLABS = 256
#: Anchors that are searched in a block at a time.
CHUNK = 256
#: Below this all sums of products are exact as doubles.
EXACT = 1 << 53
#: All scores.
ANY = (-(1 << 63), (1 << 63) - 1)

Leaf = Callable[[int], list[tuple[int, int]]]


def quantised(vectors: DataFrame, column: str, label: Column, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, dims, q): every component x as floor(scale * x)."""
    good = F.col(column).isNotNull() & F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & label.isNotNull() & good)
    q = F.transform(column, lambda x: F.floor(x.cast("double") * F.lit(scale)).cast("long"))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), F.size(column).alias("dims"), q.alias("q"))


def tiles(vectors: DataFrame) -> tuple[DataFrame, list[int]]:
    """The vectors with the ``tile`` (a string) of each, and the coordinates by falling variance; ``vectors`` is a stored table."""
    varying = vectors.select(F.posexplode("q").alias("axis", "value")).groupBy("axis").agg(F.variance("value").alias("spread")).collect()
    order = [r.axis for r in sorted(varying, key=lambda r: (-(r.spread or 0.0), r.axis))]
    slabs = min(SLABS, max(1, int(np.ceil(np.sqrt(vectors.count() / BLOCK_ROWS)))))
    rows = vectors.withColumn("slab", F.lit(0)).withColumn("tile", F.lit(0))
    if slabs > 1:
        for axis, column, by in ((order[0], "slab", F.lit(0)), (order[min(1, len(order) - 1)], "tile", F.col("slab"))):
            value = F.coalesce(F.get("q", F.lit(axis)), F.lit(0))
            cuts = rows.groupBy(by.alias("of")).agg(F.percentile_approx(value, [i / slabs for i in range(1, slabs)], 10000).alias("cuts"))
            # at most SLABS rows of SLABS numbers
            rows = rows.withColumn("of", by).join(F.broadcast(materialize(cuts, "tile-cuts")), "of")
            rows = rows.withColumn(column, F.size(F.filter("cuts", lambda c: c < value))).drop("cuts", "of")
    rows = materialize(rows, "tiled")
    sizes = rows.groupBy("dims", "slab", "tile").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("parts")).where("parts > 1")
    parted = rows.join(sizes, ["dims", "slab", "tile"], "left")
    part = F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.coalesce("parts", F.lit(1)))
    return parted.select("vec_id", "label", "dims", "q", F.concat_ws("/", "dims", "slab", "tile", part).alias("tile")), order


def pack(keys: list[np.ndarray], leaf: int = LEAF) -> np.ndarray:
    """The order of rows in which every ``leaf`` of them make a leaf: sorted by the first key, cut into slabs, each sorted by the next."""

    def split(rows: np.ndarray, depth: int) -> list[np.ndarray]:
        leaves = -(-len(rows) // leaf)
        if leaves <= 1 or depth == len(keys):
            return [rows]
        rows = rows[np.argsort(keys[depth][rows], kind="stable")]
        slabs = min(leaves, len(np.unique(keys[0][rows]))) if depth == 0 else int(np.ceil(np.sqrt(leaves)))
        size = -(-leaves // slabs) * leaf
        return [part for at in range(0, len(rows), size) for part in split(rows[at : at + size], depth + 1)]

    return np.concatenate(split(np.arange(len(keys[0])), 0))


class Tree:
    """The R-tree of a block: boxes of the leaves, then of the levels above, the root last; label is the first coordinate."""

    def __init__(self, ids: np.ndarray, label: np.ndarray, vectors: np.ndarray) -> None:
        self.ids, self.label, self.vectors = ids, label, vectors
        low = high = np.column_stack((label, vectors))
        lows, highs, self.children = [], [], []
        width, start = LEAF, 0
        while True:
            cuts = np.arange(0, len(low), width)
            self.children += [(start + a, start + min(a + width, len(low))) for a in cuts.tolist()]
            start += len(low) if lows else 0
            low, high = np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts)
            lows.append(low)
            highs.append(high)
            if len(low) == 1:
                break
            width = FANOUT
        self.leaves, self.low, self.high = len(lows[0]), np.concatenate(lows), np.concatenate(highs)
        self.root = len(self.low) - 1

    def intervals(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Smallest and largest inner product of every query with anything in every box."""
        up, down = np.maximum(queries, 0), np.minimum(queries, 0)
        low, high = self.low[:, 1:].T, self.high[:, 1:].T
        return up @ low + down @ high, up @ high + down @ low

    def best(self, leaf: Leaf, upper: list, suits: list, k: int, least: int, most: int) -> list[tuple[int, int]]:
        """The k best (score, id) from ``least`` to ``most``, by best-first search.

        ``leaf`` gives the rows of a leaf, best first; ``upper`` and ``suits`` are by node.
        """
        found: list[tuple[int, int]] = []  # (-score, id)
        queue = [(-upper[self.root], self.root)] if suits[self.root] else []
        while queue:
            bound, node = heapq.heappop(queue)
            if len(found) == k and bound > found[-1][0]:
                break
            if node < self.leaves:
                rows = leaf(node)
                first = bisect.bisect_left(rows, (-most,))
                found = sorted(found + [r for r in rows[first : first + k] if r[0] <= -least])[:k]
                continue
            for child in range(*self.children[node]):
                if suits[child]:
                    heapq.heappush(queue, (-upper[child], child))
        return [(-s, i) for s, i in found]


def build(vectors: DataFrame) -> DataFrame:
    """The index of quantised vectors: (dims, slot, ids, label, vectors), a row for each block, its rows in packed order."""
    tiled, order = tiles(vectors)

    def run(group: pa.Table) -> pa.Table:
        dims = group.column("dims")[0].as_py()
        ids, label = (group.column(c).to_numpy() for c in ("vec_id", "label"))
        values = group.column("q").combine_chunks().flatten().to_numpy().reshape(len(group), dims)
        rows = pack([label, *(values[:, i] for i in order if i < dims)])
        out = {"ids": ids[rows], "label": label[rows], "vectors": values[rows]}
        return pa.table({"dims": pa.array([dims], pa.int32()), **{c: pa.array([x.astype("<i8").tobytes()], pa.binary()) for c, x in out.items()}})

    packed = tiled.groupBy("tile").applyInArrow(run, "dims int, ids binary, label binary, vectors binary")
    stored = materialize(packed, "r-tree-blocks")
    blocks = max(1, stored.count())
    # blocks are dealt to as many slots; what is asked goes to every slot
    slot = F.pmod(F.xxhash64("dims", F.monotonically_increasing_id()), F.lit(blocks)).cast("int")
    return materialize(stored.withColumn("slot", slot).withColumn("slots", F.lit(blocks)), "r-tree")


def ask(index: DataFrame, asked: DataFrame, run, schema: str) -> DataFrame:
    """``run`` on (block, chunk of what is asked: ``dims`` and other columns), each block with all chunks of its dims."""
    first = index.select("slots").first()
    slots = first[0] if first else 1
    chunks = max(1, -(-asked.count() // CHUNK))
    names = [c for c in asked.columns if c != "dims"]
    numbered = asked.withColumn("chunk", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(chunks)))
    lists = materialize(numbered.groupBy("dims", "chunk").agg(F.collect_list(F.struct(*names)).alias("asked")), "asked")
    # an explicit number of partitions, for small blocks are much work, which adaptive merging cannot know
    dealt = lists.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1)))).repartition(slots, "slot").hint("merge")
    held = index.drop("slots").repartition(slots, "slot")
    return dealt.join(held, ["dims", "slot"]).select("dims", "ids", "label", "vectors", "asked").mapInArrow(run, schema)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Tree, list[dict], np.ndarray, np.ndarray, np.ndarray]]:
    """(tree, what is asked, queries, lower ends, upper ends) of every pair of a block and a chunk."""
    for batch in batches:
        for i in range(batch.num_rows):
            dims = batch.column("dims")[i].as_py()
            ids, label, flat = (np.frombuffer(batch.column(c)[i].as_py(), dtype="<i8") for c in ("ids", "label", "vectors"))
            vectors = flat.reshape(len(ids), dims)
            asked = batch.column("asked")[i].as_py()
            queries = np.array([a["q"] for a in asked], dtype=np.int64).reshape(len(asked), dims)
            largest = [int(np.abs(x).max(initial=0)) for x in (vectors, queries)]
            if largest[0] * largest[1] * max(1, dims) < EXACT:
                vectors, queries = vectors.astype(np.float64), queries.astype(np.float64)
            tree = Tree(ids, label, vectors)
            yield tree, asked, queries, *tree.intervals(queries)


def _leaf_rows(tree: Tree, query: np.ndarray, suit: np.ndarray, least: int, most: int) -> Leaf:
    """The rows of a leaf that count and score from ``least`` to ``most``, as sorted (-score, id), computed once."""
    known: dict[int, list[tuple[int, int]]] = {}

    def of(leaf: int) -> list[tuple[int, int]]:
        if leaf not in known:
            first, end = tree.children[leaf]
            scores = (tree.vectors[first:end] @ query).astype(np.int64)
            good = np.flatnonzero(suit[first:end] & (scores >= least) & (scores <= most))
            known[leaf] = sorted(zip((-scores[good]).tolist(), tree.ids[first + good].tolist()))
        return known[leaf]

    return of


def nearest_of_label(index: DataFrame, anchors: DataFrame, k: int) -> DataFrame:
    """(anchor, place, positive_id, score): the k best other rows of the anchor's label, for anchors (anchor, vec_id, label, dims, q)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tree, asked, queries, _, upper in _blocks(batches):
            out: list[tuple[int, int, int]] = []
            for i, a in enumerate(asked):
                suits = (tree.low[:, 0] <= a["label"]) & (tree.high[:, 0] >= a["label"])
                rows = (tree.label == a["label"]) & (tree.ids != a["vec_id"])
                leaf = _leaf_rows(tree, queries[i], rows, *ANY)
                found = tree.best(leaf, upper[i].tolist(), suits.tolist(), k, *ANY)
                out += [(a["anchor"], other, score) for score, other in found]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*out) if out else ([], [], []))], names=["anchor", "positive_id", "score"])

    found = ask(index, anchors.select("dims", "anchor", "vec_id", "label", "q"), run, "anchor long, positive_id long, score long")
    best = Window.partitionBy("anchor").orderBy(F.desc("score"), "positive_id")
    return found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)


def within_windows(index: DataFrame, anchors: DataFrame, k: int, low: int, high: int) -> DataFrame:
    """(anchor, place, rank, negative_id, negative_score): the k best rows of other labels with low * p <= 100 * score <= high * p.

    ``anchors`` have a list ``windows`` of (place, score p).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tree, asked, queries, lower, upper in _blocks(batches):
            out: list[tuple[int, int, int, int]] = []
            for i, a in enumerate(asked):
                other = ~((tree.low[:, 0] == a["label"]) & (tree.high[:, 0] == a["label"]))
                rows = (tree.label != a["label"]) & (tree.ids != a["vec_id"])
                windows = [(w["place"], -(-low * w["score"] // 100), high * w["score"] // 100) for w in a["windows"]]
                windows = [w for w in windows if w[1] <= w[2]]
                if not windows:
                    continue
                # the windows of an anchor overlap: a leaf is scored and sorted once for all of them
                leaf = _leaf_rows(tree, queries[i], rows, min(w[1] for w in windows), max(w[2] for w in windows))
                ends = upper[i].tolist()
                for place, least, most in windows:
                    suits = other & (upper[i] >= least) & (lower[i] <= most)
                    found = tree.best(leaf, ends, suits.tolist(), k, least, most)
                    out += [(a["anchor"], place, row, score) for score, row in found]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, pa.int64()) for x in (zip(*out) if out else ([], [], [], []))], names=["anchor", "place", "negative_id", "negative_score"],
            )

    found = ask(index, anchors.select("dims", "anchor", "vec_id", "label", "q", "windows"), run, "anchor long, place long, negative_id long, negative_score long")
    best = Window.partitionBy("anchor", "place").orderBy(F.desc("negative_score"), "negative_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, column: str = "embedding", label: Column | None = None,
    positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), scores as inner products of quantised vectors.

    An anchor's positives are its best other rows of its label; of each, the
    negatives are the best rows of other labels that score from ``low`` to
    ``high`` per cent of the positive's score.  ``is_anchor`` is a condition on vec_id.
    """
    stored = materialize(quantised(vectors, column, F.col("label") if label is None else label), "quantised")
    index = build(stored)
    anchors = stored.where(is_anchor).dropDuplicates(["vec_id", "label", "dims", "q"]).withColumn("anchor", F.monotonically_increasing_id())
    anchors = materialize(anchors, "anchors")
    near = materialize(nearest_of_label(index, anchors, positives), "positives")
    windows = near.groupBy("anchor").agg(F.collect_list(F.struct("place", "score")).alias("windows"))  # at most ``positives`` each
    hard = within_windows(index, anchors.join(windows, "anchor"), negatives, low, high)
    named = near.join(anchors.select("anchor", F.col("vec_id").alias("anchor_id")), "anchor")
    return hard.join(named, ["anchor", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", F.col("score").alias("positive_score"), "negative_score")
