"""Hard-negative mining: a forest of STR-packed R-trees, searched best first with score windows.

Vectors are dealt to tiles by sort-tile-recursive cuts of a bounded sample (label first, then
the coordinates of largest variance); a tile is a tree, an over-full one several. In a tree
the rows are packed the same way into leaves of LEAF, whose minimum bounding boxes are packed
FANOUT at a time. With q split into its positive part p and negative part m, every inner
product of q with a row of a box [lo, hi] lies in [p.lo + m.hi, p.hi + m.lo], coordinate by
coordinate. A queue gives the box of the highest upper end first. For an anchor a box is
pruned when its interval misses the score window, when its labels can't match, or when it is
strictly below the kth best found: a lower upper end, or an equal one with no smaller id.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from relgraph.session import cut

K = 5
"""Positives of an anchor, and negatives of a positive."""

ANCHORS = 100
"""Rows whose vec_id this divides are anchors."""

SCALE = 256.0

TREE = 32_768
"""Rows of a tree, about."""

LEAF, FANOUT = 32, 16

SAMPLE = 16_384
"""Rows that the tiles' cuts are taken from, about. Every row is indexed, by cuts that hold for all."""

_BLOCK = 512
_CHUNK = 65_536
_KEY = ["anchor_id", "anchor_label", "anchor_hash"]


def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id, label (changed where 7 divides the id) and embedding of the rows that take part."""
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    # scaled, so that what stands for a component is a finite double too
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double") * SCALE) < F.lit(float("inf"))))
    rows = embeddings.where("vec_id is not null and label is not null and embedding is not null").where(finite)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), moved.alias("label"), "embedding")


def _matrix(vectors: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    """floor(SCALE * x), x as double, of vectors with ``dims`` components each."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(SCALE * flat).reshape(len(vectors), dims)


# --- tiles -----------------------------------------------------------------------------------


@dataclass
class Slabs:
    """Cuts along one column, and what each slab is cut into; a leaf is a tile's number."""

    column: int
    cuts: np.ndarray
    inner: list


def _slabs(x: np.ndarray, parts: int, columns: list[int], fresh: list[int]) -> Slabs | int:
    if parts <= 1 or not columns or not len(x):
        fresh[0] += 1
        return fresh[0] - 1
    by = x[:, columns[0]]
    most = len(np.unique(by)) if columns[0] == 0 else 2
    slabs = min(parts, most)
    if slabs < 2:
        return _slabs(x, parts, columns[1:], fresh)
    ordered = np.sort(by)
    cuts = np.unique(ordered[(np.arange(1, slabs) * len(x)) // slabs])
    at = np.searchsorted(cuts, by, "right")
    inner = [_slabs(x[at == i], -(-parts // slabs), columns[1:], fresh) for i in range(len(cuts) + 1)]
    return Slabs(columns[0], cuts, inner)


def _tile(node: Slabs | int, x: np.ndarray, rows: np.ndarray, into: np.ndarray) -> None:
    if isinstance(node, int):
        into[rows] = node
        return
    at = np.searchsorted(node.cuts, x[rows, node.column], "right")
    for i, inner in enumerate(node.inner):
        here = rows[at == i]
        if len(here):
            _tile(inner, x, here, into)


def _with_label(table: pa.Table | pa.RecordBatch, dims: int) -> np.ndarray:
    labels = table.column("label").to_numpy(zero_copy_only=False) if isinstance(table, pa.RecordBatch) else table.column("label").to_numpy()
    return np.column_stack([labels.astype(np.float64), _matrix(table.column("embedding"), dims)])


def tiled(rows: DataFrame, trees: int) -> DataFrame:
    """The rows with dims (components) and tile, for about ``trees`` tiles of each number of components.

    The cuts are those of a sample of about SAMPLE rows, chosen by hash; it alone reaches the
    driver. Vectors of a length that the sample lacks are one tile each.
    """
    sized = rows.withColumn("dims", F.size("embedding"))
    n = rows.count()
    draw = F.shiftrightunsigned(F.xxhash64("vec_id", F.lit("tiles")), 11) / F.lit(float(1 << 53))
    sample = sized.where(draw < SAMPLE / max(n, 1)).orderBy("vec_id").toArrow()
    cuts: dict[int, Slabs | int] = {}
    for dims in set(sample.column("dims").to_pylist()):
        x = _with_label(sample.filter(pc.equal(sample.column("dims"), dims)), dims)
        columns = [0, *(1 + np.argsort(-x[:, 1:].var(axis=0), kind="stable")).tolist()]
        cuts[dims] = _slabs(x, max(1, min(trees, len(x) // 16)), columns, [0])

    def place(batches):
        for batch in batches:
            dims = batch.column("dims").to_numpy(zero_copy_only=False)
            tile = np.zeros(batch.num_rows, np.int32)
            for d in np.unique(dims).tolist():
                here = np.flatnonzero(dims == d)
                if d in cuts:
                    found = np.zeros(len(here), np.int32)
                    _tile(cuts[d], _with_label(batch.take(pa.array(here)), d), np.arange(len(here)), found)
                    tile[here] = found
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tile)], names=[*batch.schema.names, "tile"])

    kind = rows.schema["embedding"].dataType.simpleString()
    return sized.select("vec_id", "label", "embedding", "dims").mapInArrow(place, f"vec_id long, label long, embedding {kind}, dims int, tile int")


# --- trees -----------------------------------------------------------------------------------


def _str_order(x: np.ndarray, ids: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """The rows in packed order: sorted along one column, cut into two slabs of whole leaves, each along the next."""
    if len(rows) <= LEAF or not len(columns):
        return rows[np.argsort(ids[rows], kind="stable")]
    rows = rows[np.lexsort((ids[rows], x[rows, columns[0]]))]
    middle = -(-(len(rows) // 2) // LEAF) * LEAF
    return np.concatenate([_str_order(x, ids, part, columns[1:]) for part in (rows[:middle], rows[middle:])])


def _pack(table: pa.Table) -> pa.Table:
    """One row: a tree's vectors, ids and labels in packed order. Rows that are equal in full count once."""
    tree, dims = table.column("tree")[0].as_py(), table.column("dims")[0].as_py()
    raw = table.column("embedding").combine_chunks()
    exact = raw.flatten().to_numpy(zero_copy_only=False).reshape(len(raw), dims)
    ids, labels = (table.column(c).to_numpy() for c in ("vec_id", "label"))
    order = np.lexsort((*(exact[:, j] for j in range(dims)), labels, ids)) if len(np.unique(ids)) < len(ids) else np.arange(len(ids))
    same = np.zeros(len(order), bool)
    one, two = order[:-1], order[1:]
    same[1:] = (ids[one] == ids[two]) & (labels[one] == labels[two])
    same[1:] &= np.array([np.array_equal(exact[a], exact[b]) if s else False for a, b, s in zip(one, two, same[1:])], bool)
    keep = order[~same]
    ids, labels, x = ids[keep], labels[keep], _matrix(raw, dims)[keep]
    packed = []
    for label in np.unique(labels):
        rows = np.flatnonzero(labels == label)
        packed.append(_str_order(x, ids, rows, np.argsort(-x[rows].var(axis=0), kind="stable")))
    at = np.concatenate(packed)
    small = not x.size or np.abs(x).max() < 32_768
    vectors = np.ascontiguousarray(x[at]).astype("<i2" if small else "<f8").tobytes()
    return pa.table({
        "tree": pa.array([tree], pa.int64()), "dims": pa.array([dims], pa.int32()), "small": pa.array([bool(small)]),
        "labels_in": pa.array([np.unique(labels).tolist()], pa.list_(pa.int64())), "ids": pa.array([ids[at].astype("<i8").tobytes()], pa.binary()),
        "labels": pa.array([labels[at].astype("<i8").tobytes()], pa.binary()), "vectors": pa.array([vectors], pa.binary()),
    })


_TREES = "tree long, dims int, small boolean, labels_in array<long>, ids binary, labels binary, vectors binary"


def forest(rows: DataFrame, tree_rows: int = TREE, least: int = 1) -> tuple[DataFrame, int]:
    """The index: one row per packed tree, numbered from 0, and how many there are.

    At least ``least`` tiles are made, so that a small table too is work for all cores. A
    tile with more than ``tree_rows`` rows (a vector that very many rows share) becomes
    several trees, dealt by a hash of the id.
    """
    n = rows.count()
    placed = cut(tiled(rows, max(least, -(-n // tree_rows))), "tiles")
    # one row per tile: a window over all of them sees a few bytes for every tree
    before = Window.orderBy("dims", "tile").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("dims", "tile").agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / tree_rows))
    numbered = counts.withColumn("first", F.coalesce(F.sum("parts").over(before), F.lit(0))).drop("n")
    trees = numbered.agg(F.sum("parts")).first()[0] or 0
    of = F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("parts"))
    dealt = placed.join(numbered, ["dims", "tile"]).select(of.cast("long").alias("tree"), "dims", "vec_id", "label", "embedding")
    return cut(dealt.groupBy("tree").applyInArrow(_pack, _TREES), "forest"), int(trees)


class Tree:
    """Rows of a packed tree and the boxes of its nodes, leaves first."""

    def __init__(self, row: dict):
        dims = row["dims"]
        self.ids, self.labels = (np.frombuffer(row[c], "<i8") for c in ("ids", "labels"))
        self.x = np.frombuffer(row["vectors"], "<i2" if row["small"] else "<f8").astype(np.float64).reshape(len(self.ids), dims)
        starts = np.arange(0, len(self.ids), LEAF)
        low, high = (f.reduceat(self.x, starts) if dims else self.x[starts] for f in (np.minimum, np.maximum))
        least_label, most_label = (f.reduceat(self.labels, starts) for f in (np.minimum, np.maximum))
        least_id = np.minimum.reduceat(self.ids, starts)
        levels = [(low, high, least_label, most_label, least_id)]
        self.leaves, first = len(starts), 0
        self.children: dict[int, range] = {}
        while len(levels[-1][0]) > 1:
            below = levels[-1]
            at = np.arange(0, len(below[0]), FANOUT)
            reduced = [f.reduceat(c, at) if c.size else c[at] for f, c in zip((np.minimum, np.maximum, np.minimum, np.maximum, np.minimum), below)]
            up = first + len(below[0])
            for i, a in enumerate(at.tolist()):
                self.children[up + i] = range(first + a, min(first + a + FANOUT, up))
            levels.append(tuple(reduced))
            first = up
        self.low, self.high, self.least_label, self.most_label, self.least_id = (np.concatenate(c) for c in zip(*levels))
        self.root = len(self.low) - 1

    def rows(self, leaf: int) -> slice:
        return slice(leaf * LEAF, min((leaf + 1) * LEAF, len(self.ids)))


@dataclass
class Wanted:
    """Searches: each the first K rows with floor <= score <= cap, of the owner's label or of others."""

    owner: np.ndarray
    floor: np.ndarray
    cap: np.ndarray
    same_label: bool


NONE = -(2**63) + 1
"""In place of a score that is missing; scores below 2 - 2**63 or above 2**63 - 1 count as these."""

_LEAST, _MOST = NONE + 1, 2**63 - 1
_INTEGER = np.vectorize(int, otypes=[object])
_CLIPPED = np.vectorize(lambda score: min(max(score, _LEAST), _MOST), otypes=[np.int64])


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of rows of whole numbers, exact, in the arithmetic that their size asks for."""
    if not q.size or not x.size:
        return np.zeros((len(q), len(x)), np.int64)
    # no sum of absolute products, in any order of adding, is above this
    most = (np.abs(q) @ np.abs(x).max(0)).max() * (1 + 1e-9)
    if most < 2.0**53:
        return (q @ x.T).astype(np.int64)
    if most < 2.0**62 and max(np.abs(q).max(), np.abs(x).max()) < 2.0**62:
        return q.astype(np.int64) @ x.astype(np.int64).T
    return _CLIPPED(_INTEGER(q) @ _INTEGER(x).T)


def intervals(tree: Tree, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends between which all inner products with the rows of each box lie.

    From 2**53 on, where sums of doubles are rounded, the ends are moved apart by more than
    the rounding. Like scores they end at the range of a long.
    """
    plus, minus = np.maximum(q, 0), np.minimum(q, 0)
    lower, upper = plus @ tree.low.T + minus @ tree.high.T, plus @ tree.high.T + minus @ tree.low.T
    size = np.abs(q) @ np.maximum(np.abs(tree.low), np.abs(tree.high)).T
    slack = np.where(size < 2.0**52, 0.0, size * (2 * q.shape[1] + 16) * 2.0**-52)
    # where doubles overflow nothing is known
    ends = np.nan_to_num(lower - slack, nan=-np.inf), np.nan_to_num(upper + slack, nan=np.inf)
    return np.clip(ends[0], -(2.0**63), 2.0**63), np.clip(ends[1], -(2.0**63), 2.0**63)


def best_first(tree: Tree, q: np.ndarray, q_ids: np.ndarray, q_labels: np.ndarray, wanted: Wanted) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids of every search's first K rows in the tree, best first; missing ones score NONE.

    The anchors of a block share one queue, in which a box stands at the highest upper end of
    any anchor that it still concerns; pruning is by anchor and search. Same-label searches
    leave the anchor's own row out.
    """
    lower, upper = intervals(tree, q)
    scores = np.full((len(wanted.owner), K), NONE, np.int64)
    ids = np.full((len(wanted.owner), K), np.iinfo(np.int64).max)
    own, of = wanted.owner, q_labels[wanted.owner]

    def concerned(node: int) -> np.ndarray:
        """Searches that the box may still add a row to."""
        top, kth = upper[own, node], scores[:, -1]
        may = (top > kth) | ((top == kth) & (tree.least_id[node] < ids[:, -1]))
        may &= (top >= wanted.floor) & (lower[own, node] <= wanted.cap)
        if wanted.same_label:
            may &= (of >= tree.least_label[node]) & (of <= tree.most_label[node])
        elif tree.least_label[node] == tree.most_label[node]:
            may &= of != tree.least_label[node]
        return np.flatnonzero(may)

    queue = [(-np.inf, tree.root)]
    while queue:
        _, node = heapq.heappop(queue)
        live = concerned(node)
        if not len(live):
            continue
        if node in tree.children:
            anchors = np.unique(own[live])
            for child in tree.children[node]:
                heapq.heappush(queue, (-upper[anchors, child].max(), child))
            continue
        at = tree.rows(node)
        anchors, back = np.unique(own[live], return_inverse=True)
        found = products(q[anchors], tree.x[at])[back]
        row_ids, row_labels = tree.ids[at], tree.labels[at]
        fits = (found >= wanted.floor[live, None]) & (found <= wanted.cap[live, None])
        fits &= (row_labels == of[live, None]) == wanted.same_label
        kth, kth_id = scores[live, -1, None], ids[live, -1, None]
        fits &= (found > kth) | ((found == kth) & (row_ids < kth_id))
        if wanted.same_label:
            for i, j in zip(*np.nonzero(fits & (row_ids == q_ids[own[live], None]))):
                if np.array_equal(tree.x[at][j], q[own[live[i]]]):
                    fits[i, j] = False
        better = np.flatnonzero(fits.any(axis=1))
        if len(better):
            live = live[better]
            s = np.concatenate([scores[live], np.where(fits[better], found[better], NONE)], axis=1)
            t = np.concatenate([ids[live], np.where(fits[better], row_ids, np.iinfo(np.int64).max)], axis=1)
            order = np.lexsort((t, -s), axis=1)[:, :K]
            scores[live], ids[live] = np.take_along_axis(s, order, 1), np.take_along_axis(t, order, 1)
    return scores, ids


def _blocks(tree_rows: pa.Table, anchors: pa.Table):
    """The tree, and the anchors of its dimensions in blocks, those of one label side by side."""
    if not tree_rows.num_rows or not anchors.num_rows:
        return
    tree = Tree(tree_rows.slice(0, 1).to_pylist()[0])
    dims = tree.x.shape[1]
    anchors = anchors.filter(pc.equal(pc.list_value_length(anchors.column("embedding")), dims))
    anchors = anchors.sort_by([("anchor_label", "ascending"), ("anchor_id", "ascending")])
    for i in range(0, anchors.num_rows, _BLOCK):
        block = anchors.slice(i, _BLOCK)
        yield tree, block, _matrix(block.column("embedding"), dims), *(block.column(c).to_numpy() for c in _KEY)


_FOUND = "anchor_id long, anchor_label long, anchor_hash long, slot int, id long, score long"


def _rows(key: list[np.ndarray], wanted: Wanted, slot: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> pa.Table:
    search, place = np.nonzero(scores > NONE)
    names = [part.split()[0] for part in _FOUND.split(", ")]
    columns = [k[wanted.owner[search]] for k in key] + [slot[search].astype(np.int32), ids[search, place], scores[search, place]]
    return pa.table(dict(zip(names, columns)))


def _all(tables: list[pa.Table]) -> pa.Table:
    kinds = {"slot": pa.int32()}
    names = [part.split()[0] for part in _FOUND.split(", ")]
    return pa.concat_tables([pa.schema([(n, kinds.get(n, pa.int64())) for n in names]).empty_table(), *tables])


def _positives(trees: pa.Table, anchors: pa.Table) -> pa.Table:
    found = []
    for tree, _, q, ids, labels, hashes in _blocks(trees, anchors):
        n = len(ids)
        wanted = Wanted(np.arange(n), np.full(n, _LEAST), np.full(n, _MOST), True)
        found.append(_rows([ids, labels, hashes], wanted, np.zeros(n), *best_first(tree, q, ids, labels, wanted)))
    return _all(found)


def _negatives(trees: pa.Table, anchors: pa.Table) -> pa.Table:
    found = []
    for tree, block, q, ids, labels, hashes in _blocks(trees, anchors):
        lists = block.column("positive_scores").combine_chunks()
        owner = np.repeat(np.arange(len(ids)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        slot = np.concatenate([np.arange(n) for n in np.bincount(owner, minlength=len(ids))])
        cap = lists.flatten().to_numpy(zero_copy_only=False)
        wanted = Wanted(owner, cap - cap // 5, cap, False)
        # from 0.8 times the score on, which is what a fifth of it, rounded down, leaves; of a
        # negative positive score nothing lies between that and itself
        some = np.flatnonzero(wanted.floor <= wanted.cap)
        wanted = Wanted(owner[some], wanted.floor[some], cap[some], False)
        found.append(_rows([ids, labels, hashes], wanted, slot[some], *best_first(tree, q, ids, labels, wanted)))
    return _all(found)


def _first(found: DataFrame, keys: list[str]) -> DataFrame:
    """The first K rows of each key, with their rank."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc("id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= K)


def _met(trees: DataFrame, anchors: DataFrame, chunks: int, search) -> DataFrame:
    """What the searches of all anchors find in the trees that they are sent to (column tree), tree by tree.

    Anchors move, trees don't but once for each _CHUNK anchors, so that no task holds more of
    them than that.
    """
    chunk = F.pmod(F.xxhash64("anchor_id", F.lit("chunk")), F.lit(chunks))
    right = anchors.withColumn("chunk", chunk).groupBy("tree", "chunk")
    renamed = trees.withColumnRenamed("tree", "home")  # the anchors' column comes from the same frame
    left = renamed.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).groupBy("home", "copy")
    return left.cogroup(right).applyInArrow(search, _FOUND)


def hard_negatives(embeddings: DataFrame, tree_rows: int = TREE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; see the module.

    embeddings: vec_id, embedding (array of numbers), label; other columns are not read. Rows
    without an id, a label or a vector, or with a component that is null or not finite, take no
    part. Vectors of other lengths than the anchor's don't meet it; empty ones all score 0.
    Rows that are equal in full count once; rows that share only an id are different rows.
    Ties go to the smaller id. Scores are exact as far as a long holds them; what lies beyond
    counts as its end. An empty table gives no rows.
    """
    spark: SparkSession = embeddings.sparkSession
    rows = usable(embeddings)
    trees, n_trees = forest(rows, tree_rows, 2 * spark.sparkContext.defaultParallelism)
    anchors = rows.where(F.col("vec_id") % ANCHORS == 0).select(
        F.col("vec_id").alias("anchor_id"), F.col("label").alias("anchor_label"), F.xxhash64("embedding").alias("anchor_hash"), "embedding"
    )
    anchors = cut(anchors.dropDuplicates(), "anchors")
    chunks = max(1, -(-anchors.count() // _CHUNK))
    of_label = trees.select("tree", F.explode("labels_in").alias("anchor_label"))
    positives = _first(_met(trees, anchors.join(of_label, "anchor_label"), chunks, _positives), _KEY)
    positives = cut(positives.select(*_KEY, "id", "score", "rank"), "positives")
    scores = positives.groupBy(*_KEY).agg(F.sort_array(F.collect_list(F.struct("rank", "score"))).alias("p"))
    with_scores = anchors.join(scores.select(*_KEY, F.col("p.score").alias("positive_scores")), _KEY)
    sent = with_scores.withColumn("tree", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(n_trees, 1) - 1).cast("long"))))
    negatives = _first(_met(trees, sent, chunks, _negatives), [*_KEY, "slot"])
    known = positives.select(*_KEY, (F.col("rank") - 1).alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return negatives.join(known, [*_KEY, "slot"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
        F.col("positive_score").cast("long").alias("positive_score"), F.col("score").cast("long").alias("negative_score"),
    )
