"""All pairs of embeddings at or above a cosine, by dual traversal of cover trees.

Equal vectors are one class. A bounded sample gives the upper levels of a cover tree: nested nets with halving radii under the angle metric, the more points the more
classes there are. Every class descends these levels to a net point of the lowest one; a node's covering radius comes from all its members. Nodes make up
blocks, and a pair of blocks is compared only if two of their nodes are within both covering radii and the threshold's angle; a class is sent to such pairs only if
it is itself within reach of a node of the other block. Inside a task, both blocks get cover trees of their own, nested nets again, and node pairs are
dropped, or taken whole, by their covering radii. What is left is compared on its first coordinates: by Cauchy-Schwarz the others can't add more than
the product of their lengths, so pairs that can't reach the threshold are dropped, and the rest are compared in double precision. A task returns counts of links
and a spanning forest of them, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, give_back, stage
from .graph import components

COSINE = 0.9
#: Classes that the upper levels are fitted on, at most, and net points of their lowest level: at least the second number, one for NODE_CLASSES
#: classes, and no more than the sample. Every class is indexed whatever these are.
SAMPLE, NODES, NODE_CLASSES = 4096, 128, 2048
#: Classes and bytes of a block at most. Fewer classes are dealt into as many blocks as give each core some TASKS pairs, of LEAST_BLOCK classes at least.
BLOCK, BLOCK_BYTES, LEAST_BLOCK, TASKS = 1 << 15, 64 << 20, 2048, 4
LEAF, CHILDREN = 1024, 48
#: Share of pairs of children that must be decided by radii for a node to be split.
USEFUL = 0.25
#: Rows of a leaf's product that are held at once.
ROWS = 1024
#: Angles are trusted to this much; closer calls are compared exactly.
EPSILON = 1e-6


def angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1, 1))


def unit(vectors: np.ndarray) -> np.ndarray:
    x = vectors.astype(np.float64)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def nets(points: np.ndarray, most: int) -> list[tuple[float, np.ndarray]]:
    """Nested nets (radius, indices of points) with halving radii, by farthest-first traversal, until one covers all points closely or has ``most`` points."""
    if not len(points):
        return []
    chosen, far = [0], angles(points, points[:1])[:, 0]
    radius, out = np.pi, []
    while len(chosen) < min(most, len(points)):
        i = int(far.argmax())
        while far[i] <= radius and radius > 1e-3:
            out.append((radius, np.array(chosen)))
            radius /= 2
        if far[i] <= 1e-3:
            break
        chosen.append(i)
        far = np.minimum(far, angles(points, points[i : i + 1])[:, 0])
    out.append((float(far.max()), np.array(chosen)))
    return out


class Node:
    """A node covers ``at`` around its centre; its children's centres are a net of halved radius that holds the centre itself.

    It stays whole where that net's balls are so wide that few pairs of them would be dropped, or taken whole, by their radii.
    """

    __slots__ = ("at", "center", "radius", "children")

    def __init__(self, x: np.ndarray, at: np.ndarray, center: int, dist: np.ndarray, limit: float):
        self.at, self.center, self.radius, self.children = at, x[center], float(dist.max()), []
        if len(at) <= LEAF or self.radius <= EPSILON:
            return
        order = np.concatenate(([center], at[at != center]))
        level = nets(x[order], CHILDREN)
        points = order[next((net for radius, net in level if radius <= self.radius / 2), level[-1][1])]
        if len(points) < 2:
            return
        d = angles(x[at], x[points])
        near = d.argmin(1)
        least = d[np.arange(len(at)), near]
        radii = np.zeros(len(points))
        np.maximum.at(radii, near, least)
        gaps, wide = angles(x[points], x[points]), radii[:, None] + radii
        if ((gaps - wide > limit) | (gaps + wide < limit)).mean() < USEFUL:
            return
        self.children = [Node(x, at[own], int(points[k]), least[own], limit) for k in range(len(points)) if (own := near == k).any()]


def tree(x: np.ndarray, limit: float) -> Node:
    at = np.arange(len(x))
    return Node(x, at, 0, angles(x, x[:1])[:, 0], limit)


class Forest:
    def __init__(self, n: int):
        self.root, self.edges = np.arange(n), []

    def find(self, a: int) -> int:
        while (up := int(self.root[a])) != a:
            self.root[a] = self.root[up]
            a = up
        return a

    def join(self, a: int, b: int) -> None:
        p, q = self.find(a), self.find(b)
        if p != q:
            self.root[max(p, q)] = min(p, q)
            self.edges.append((a, b))

    def join_all(self, a: np.ndarray, b: np.ndarray) -> None:
        """:meth:`join` for each pair, but one a pair of components only."""
        if not len(a):
            return
        while (up := self.root[self.root]).tobytes() != self.root.tobytes():
            self.root = up
        p, q = self.root[a], self.root[b]
        apart = np.flatnonzero(p != q)
        low, high = np.minimum(p, q)[apart], np.maximum(p, q)[apart]
        for k in apart[np.unique(low * len(self.root) + high, return_index=True)[1]].tolist():
            self.join(int(a[k]), int(b[k]))


class Heads:
    """The first coordinates of unit vectors in single precision, and the length of what is left out as one more: products of these are bounds on the cosines."""

    def __init__(self, x: np.ndarray):
        k = min(x.shape[1], max(8, -(-x.shape[1] // 4)))
        rest = np.sqrt(np.maximum(0.0, 1 - (x[:, :k] ** 2).sum(1, keepdims=True))) if x.shape[1] > k else np.zeros((len(x), 1))
        self.head = np.concatenate((x[:, :k], rest), 1).astype(np.float32)

    def possible(self, p: np.ndarray, q: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
        """Places in p and q of the pairs that may reach ``cosine``."""
        at = np.flatnonzero(self.head[p] @ self.head[q].T >= np.float32(cosine - 1e-4))
        return at // len(q), at % len(q)


def dual(x: np.ndarray, weight: np.ndarray, split: int, cosine: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Links between x[:split] and x[split:], or inside x if ``split`` is its length: weight linked to each row, and a spanning forest."""
    limit = float(np.arccos(cosine))
    count, forest, heads = np.zeros(len(x), np.int64), Forest(len(x)), Heads(x)
    one = split == len(x)
    if one:
        a = b = tree(x, limit)
    else:
        a, b = tree(x[:split], limit), tree(x[split:], limit)

        def shift(n: Node) -> None:
            n.at = n.at + split
            for c in n.children:
                shift(c)

        shift(b)
    todo = [(a, b)]
    while todo:
        p, q = todo.pop()
        if p is q:
            if p.children:
                todo += [(c, d) for i, c in enumerate(p.children) for d in p.children[i:]]
                continue
            gap, same = 0.0, True
        else:
            gap, same = float(np.arccos(np.clip(p.center @ q.center, -1, 1))), False
            if gap - p.radius - q.radius > limit + EPSILON:
                continue
        if gap + p.radius + q.radius < limit - EPSILON:
            if same:
                count[p.at] += weight[p.at].sum() - weight[p.at]
            else:
                count[p.at] += weight[q.at].sum()
                count[q.at] += weight[p.at].sum()
            first, other = int(p.at[0]), int((p if same else q).at[0])  # all of the one link with all of the other
            forest.join_all(np.full(len(q.at), first), q.at)
            forest.join_all(p.at, np.full(len(p.at), other))
            continue
        if p.children or q.children:
            if p.children and (not q.children or p.radius >= q.radius):
                todo += [(c, q) for c in p.children]
            else:
                todo += [(p, c) for c in q.children]
            continue
        for at, bt in ((at, bt) for at in range(0, len(p.at), ROWS) for bt in range(0, len(q.at), 4 * ROWS)):
            if same and bt + 4 * ROWS <= at:
                continue
            rows, others = p.at[at : at + ROWS], q.at[bt : bt + 4 * ROWS]
            i, j = heads.possible(rows, others, cosine)
            if exact := 8 * len(i) > len(rows) * len(others):  # the first coordinates say little here
                i, j = np.nonzero(x[rows] @ x[others].T >= cosine)
            i, j = rows[i], others[j]
            if same:
                i, j = i[i < j], j[i < j]
            for k in range(0, len(i), 1 << 16):
                a, b = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
                if not exact:
                    hit = np.einsum("ij,ij->i", x[a], x[b]) >= cosine
                    a, b = a[hit], b[hit]
                count += np.bincount(a, weight[b], len(x)).astype(np.int64) + np.bincount(b, weight[a], len(x)).astype(np.int64)
                forest.join_all(a, b)
    return count, forest.edges


def _vectors(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


class Levels:
    """Nested nets of the sample, as plain arrays: each level's centres, and for each centre the children of the next level that it has."""

    def __init__(self, points: np.ndarray, most: int):
        found = [net for _, net in nets(points, most)]
        # levels that grow at least fourfold, so that a descent has few steps; the lowest one is always there
        kept = [found[-1]]
        for net in found[-2::-1]:
            if 4 * len(net) <= len(kept[-1]):
                kept.append(net)
        self.nets = kept[::-1]
        self.centers = [points[net] for net in self.nets]
        self.parents = [np.zeros(len(self.nets[0]), np.int64)] + [angles(c, up).argmin(1) for up, c in zip(self.centers, self.centers[1:], strict=False)]

    def parts(self) -> tuple:
        return self.centers, self.parents


def descend(x: np.ndarray, centers: list[np.ndarray], parents: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A node of the lowest level for each row of x, by the nearest child at each level, and its angle."""
    d = angles(x, centers[0])
    near = d.argmin(1)
    dist = d[np.arange(len(x)), near]
    for own, parent in zip(centers[1:], parents[1:], strict=True):
        out = np.zeros(len(x), np.int64)
        for k in np.unique(near):
            rows, children = np.flatnonzero(near == k), np.flatnonzero(parent == k)
            d = angles(x[rows], own[children])  # every net point is its own child, so there is one
            best = d.argmin(1)
            out[rows], dist[rows] = children[best], d[np.arange(len(rows)), best]
        near = out
    return near, dist


def _assign(dims: int, shipped):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near, dist = descend(unit(_vectors(batch.column(2), dims)), *shipped.value)
            yield pa.record_batch([*batch.columns, pa.array(near, pa.int32()), pa.array(dist, pa.float64())], [*batch.schema.names, "node", "dist"])
        give_back()

    return run


def _deal(dims: int, shipped):
    """A row for each pair of blocks that a class takes part in: (i, j, right: it is of block j > i, cls, weight, vec)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centers, reach, first, pieces, owner, starts, partners = shipped.value
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.slice(at, 1000)
                cls, near = part.column(0).to_numpy(), part.column(3).to_numpy()
                own = first[near] + (cls.view(np.uint64) % pieces[near].astype(np.uint64)).astype(np.int64)
                d = angles(unit(_vectors(part.column(2), dims)), centers)[:, owner]  # by (block, node), blocks together
                visit = np.logical_or.reduceat(d <= reach[owner] + EPSILON, starts, axis=1) & partners[own]
                visit[np.arange(len(own)), own] = True
                row, block = np.nonzero(visit)
                mine = own[row]
                columns = [pa.array(np.minimum(mine, block), pa.int32()), pa.array(np.maximum(mine, block), pa.int32()), pa.array(mine > block), *(part.column(k).take(pa.array(row)) for k in (0, 1, 2))]
                yield pa.record_batch(columns, ["i", "j", "right", "cls", "weight", "vec"])
        give_back()

    return run


def _traverse(dims: int, cosine: float):
    def solve(rows: pa.Table) -> list[tuple]:
        right = rows.column("right").to_numpy()
        i, j = rows.column("i")[0].as_py(), rows.column("j")[0].as_py()
        split = len(rows) if i == j else int((~right).sum())
        if i != j and split in (0, len(rows)):
            return []
        cls, weight = rows.column("cls").to_numpy(), rows.column("weight").to_numpy()
        x = unit(_vectors(rows.column("vec").combine_chunks(), dims))
        count, edges = dual(x, weight, split, cosine)
        some = np.flatnonzero(count)
        return [*((int(cls[k]), None, int(count[k])) for k in some), *((int(cls[a]), int(cls[b]), 0) for a, b in edges)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        pair = None

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held
            if held:
                got = solve(pa.Table.from_batches(held))
                held = []
                if got:
                    yield pa.record_batch([pa.array([g[k] for g in got], pa.int64()) for k in range(3)], ["a", "b", "n"])

        for batch in batches:
            i, j = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(i) != 0) | (np.diff(j) != 0)) + 1).tolist(), len(batch)]
            for p, q in zip(cuts, cuts[1:], strict=False):
                if p == q:
                    continue
                if pair != (i[p], j[p]):
                    yield from flush()
                    pair = (i[p], j[p])
                held.append(batch.slice(p, q - p))
        yield from flush()
        give_back()

    return run


def blocks_of(centers: np.ndarray, sizes: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Nodes to blocks: the first block and number of blocks of each node, and the nodes that each block holds.

    Small nodes share a block with their neighbours in a walk from centre to nearest centre; a large node is cut into several.
    """
    first, pieces = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64)
    held: list[list[int]] = []
    free, at, current = np.ones(len(sizes), bool), 0, block + 1.0
    while True:
        free[at] = False
        if sizes[at] > block:
            first[at], pieces[at] = len(held), -(-int(sizes[at]) // block)
            held += [[at] for _ in range(pieces[at])]
            current = block + 1
        else:
            if current + sizes[at] > block:
                held.append([])
                current = 0
            first[at] = len(held) - 1
            held[-1].append(at)
            current += sizes[at]
        if not free.any():
            return first, pieces, [np.array(h) for h in held]
        rest = np.flatnonzero(free)
        at = int(rest[(centers[rest] @ centers[at]).argmax()])


def _links(classes: DataFrame, dims: int, n: int, cosine: float) -> DataFrame:
    """(a, null, n): links counted for class a; (a, b, 0): an edge of a spanning forest. ``n`` classes have vectors of ``dims`` components."""
    context = classes.sparkSession.sparkContext
    own = classes.where(F.size("vec") == dims).select("cls", "weight", "vec")
    sample = own.orderBy(F.xxhash64("cls"), "cls").limit(SAMPLE).select("vec").toPandas()["vec"]
    points = unit(np.array(sample.tolist(), np.float64).reshape(-1, dims))
    levels = Levels(points, max(NODES, n // NODE_CLASSES))
    centers = levels.centers[-1]
    placed = stage(own.mapInArrow(_assign(dims, context.broadcast(levels.parts())), "cls long, weight long, vec array<float>, node int, dist double"), "placed")
    nodes = placed.groupBy("node").agg(F.count("*").alias("n"), F.max("dist").alias("radius")).collect()  # as many rows as the lowest level has points, at most SAMPLE
    sizes, radius = np.zeros(len(centers), np.int64), np.full(len(centers), -10.0)
    for r in nodes:
        sizes[r["node"]], radius[r["node"]] = r["n"], r["radius"]
    limit = float(np.arccos(cosine))
    most = min(BLOCK, max(256, BLOCK_BYTES // (8 * dims)))
    wanted = int(np.ceil(np.sqrt(2 * TASKS * context.defaultParallelism)))
    first, pieces, held = blocks_of(centers, sizes, min(most, max(LEAST_BLOCK, -(-n // wanted))))
    owner, starts = np.concatenate(held), np.cumsum([0, *[len(h) for h in held[:-1]]])
    partners = np.zeros((len(held), len(held)), bool)
    for k, nodes_of in enumerate(held):
        near = (angles(centers[nodes_of], centers) <= radius[nodes_of][:, None] + radius + limit + EPSILON).any(0)
        partners[k] = np.logical_or.reduceat(near[owner], starts)
    shipped = context.broadcast((centers, radius + limit, first, pieces, owner, starts, partners | partners.T))
    dealt = placed.select("cls", "weight", "vec", "node").mapInArrow(_deal(dims, shipped), "i int, j int, right boolean, cls long, weight long, vec array<float>")
    pairs = dealt.repartition("i", "j").sortWithinPartitions("i", "j", "right")
    found = stage(pairs.mapInArrow(_traverse(dims, cosine), "a long, b long, n long"), "found")
    discard(placed)
    return found


def near_vectors(embeddings: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per row: vec_id, n_links (other rows linked directly), component_id (smallest vec_id reachable, itself included), kept.

    Rows link at a cosine of at least ``cosine`` in double precision. Vectors that are null, empty, zero, or hold null or non-finite components link with nothing;
    nor do vectors of different lengths, or rows with a null vec_id (component_id null, kept). Rows that repeat an id are vectors of their own in
    n_links. Extra columns are ignored whatever their names; an empty table gives no rows.
    """
    rows = embeddings.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<float>").alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    rows = stage(rows.select("vec_id", F.when(F.col("vec_id").isNotNull() & finite, F.col("vec")).alias("vec")).withColumn("cls", F.when(F.col("vec").isNotNull(), F.xxhash64("vec"))), "vectors")
    classes = stage(rows.where("cls is not null").groupBy("cls").agg(F.min("vec_id").alias("id"), F.count("*").alias("weight"), F.first("vec").alias("vec")), "classes")
    found = None
    for r in classes.groupBy(F.size("vec").alias("dims")).count().orderBy("dims").collect():
        part = _links(classes, r["dims"], r["count"], cosine)
        found = part if found is None else found.union(part)
    if found is None:
        found = embeddings.sparkSession.createDataFrame([], "a long, b long, n long")
    found = stage(found, "links")
    counts = found.where("b is null").groupBy("a").agg(F.sum("n").alias("n"))
    part = components(found.where("b is not null").select("a", "b"))
    named = classes.join(part, F.col("cls") == F.col("node"), "left").join(counts, F.col("cls") == F.col("a"), "left")
    named = named.select("cls", "id", F.coalesce("component", "cls").alias("comp"), (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    smallest = named.groupBy("comp").agg(F.min("id").alias("component"))
    verdicts = named.join(smallest, "comp").select("cls", "n_links", "component")
    out = stage(
        rows.select("vec_id", "cls").join(verdicts, "cls", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id")),
        "near-vectors",
    )
    discard(rows, classes, found)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


ORACLE_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT a AS id, a AS root FROM p UNION SELECT p.b, r.root FROM r JOIN p ON p.a = r.id),
c AS (SELECT a AS id, count(*) AS n FROM p GROUP BY a),
m AS (SELECT id, min(root) AS root FROM r GROUP BY id)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(root, vec_id) AS component_id, vec_id = coalesce(root, vec_id) AS kept
FROM embeddings LEFT JOIN c ON c.id = vec_id LEFT JOIN m ON m.id = vec_id
"""
