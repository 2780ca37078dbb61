"""Nearest vectors by inner product: a hierarchical k-means tree, searched best bin first.

The tree is fitted on a bounded sample (``SAMPLE`` vectors, those with the smallest
hashes), split ``FANOUT`` ways until a leaf holds ``LEAF_SAMPLE`` of them. Every vector
is then put into a leaf. Vectors of different length are made comparable by one more
component, sqrt(M^2 - |x|^2) with M the greatest length, so that the nearest points of
the tree's space are those with the largest inner products.

A query takes the tree's nodes from a priority queue (product with the centre plus two
standard deviations of the node's vectors) and visits leaves in that order. How many
is calibrated: for ``CALIBRATE`` queries the true neighbours are found among all
vectors, and visits are widened until the leaves visited hold ``TARGET`` of them. The
query goes on if its leaves hold too few vectors to fill its list.

Equal vectors are one node that carries its smallest ids, so a vector that a third of
the rows share is searched, and searched for, once. Nodes and queries meet in tiles
(bin of leaves, chunk of the bin, block of queries) of at most about ``CHUNK`` x
``BLOCK``; a bin is a run of small leaves or one large leaf cut into chunks. Each tile
gives each query its best; the lists are merged and handed to all queries with that
vector. Products are taken by matrix multiplication, and what is near the cut again in
order of the components, so the score is the same wherever a pair meets.

Defined results: vectors that are null, empty, zero or hold a null or non-finite
component take no part, nor do those without an id or of another number of components
than most vectors have (the smaller number, if tied). Equal rows count once. An id that
occurs with different vectors is a candidate with each of them, and as a query gets a
list for each; only the query's own row is left out. Ties go to the smaller id. Fewer
than ``top`` candidates give them all; no queries or an empty table give no rows; other
columns are not read.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseflow.llm.common import written

TOP = 20
QUERY_STEP = 20         # queries: ids divisible by this
SAMPLE = 20_000
FANOUT = 8
LEAF_SAMPLE = 50
ROUNDS = 8
CALIBRATE = 200
TARGET = 0.95
CHUNK = 4_096
BLOCK = 4_096
SALTS = 32
KEY = ("k1", "k2")


class Tree:
    """Nodes of a fitted tree: ``centres`` (one row a node, node 0 the root), their
    ``spread``, ``children`` and the ``leaf`` number of those without."""

    def __init__(self, vectors, longest: float, seed: int = 0):
        import numpy as np

        self.longest = longest
        self.rng = np.random.default_rng(seed)
        points = self.lifted(vectors)
        self.children, self.leaf, centres, spread = [], [], [], []
        todo, leaves = [(np.arange(len(points)), None)], 0
        while todo:
            rows, parent = todo.pop(0)
            own, me = points[rows], len(centres)
            if parent is not None:
                self.children[parent].append(me)
            centre = own.mean(axis=0) if len(rows) else np.zeros(points.shape[1])
            centres.append(centre)
            spread.append(float(np.sqrt(((own - centre) ** 2).sum(axis=1).mean() / points.shape[1])) if len(rows) else 0.0)
            self.children.append([])
            parts = self._split(own) if len(rows) > LEAF_SAMPLE else []
            self.leaf.append(-1 if parts else leaves)
            leaves += not parts
            todo += [(rows[p], me) for p in parts]
        self.centres, self.spread, self.leaves = np.array(centres), np.array(spread), leaves
        del self.rng

    def _split(self, own):
        """Row numbers of each part, or nothing where the points can't be parted."""
        import numpy as np

        first = np.unique(own[self.rng.permutation(len(own))[:4 * FANOUT]], axis=0)
        if len(first) < 2:
            first = np.unique(own, axis=0)
        centres = first[self.rng.permutation(len(first))[:FANOUT]]
        for _ in range(ROUNDS):
            at = _nearest(own, centres)
            parts = [p for p in (np.flatnonzero(at == k) for k in range(len(centres))) if len(p)]
            centres = np.array([own[p].mean(axis=0) for p in parts])
        return parts if len(parts) > 1 else []

    def lifted(self, vectors):
        import numpy as np

        rest = np.maximum(self.longest ** 2 - (vectors ** 2).sum(axis=1), 0)
        return np.hstack([vectors, np.sqrt(rest)[:, None]])

    def leaf_of(self, vectors):
        """The leaf each vector belongs to."""
        import numpy as np

        points = self.lifted(vectors)
        node = np.zeros(len(points), "int64")
        todo = [0] if len(points) else []
        while todo:
            n = todo.pop()
            if self.children[n]:
                rows = np.flatnonzero(node == n)
                kids = np.array(self.children[n])
                node[rows] = kids[_nearest(points[rows], self.centres[kids])]
                todo += [k for k in kids if (node[rows] == k).any()]
        return np.array(self.leaf)[node]

    def priorities(self, queries):
        """Of each query and node: what a good vector of the node should give."""
        import numpy as np

        return queries @ self.centres[:, :-1].T + 2 * np.linalg.norm(queries, axis=1)[:, None] * self.spread

    def best_first(self, priority):
        """Leaves in the order in which one query visits them (``priority`` of each node)."""
        queue = [(0.0, 0)]
        while queue:
            node = heapq.heappop(queue)[1]
            if not self.children[node]:
                yield self.leaf[node]
            for kid in self.children[node]:
                heapq.heappush(queue, (-priority[kid], kid))


def _nearest(points, centres):
    return ((centres ** 2).sum(axis=1) - 2 * (points @ centres.T)).argmin(axis=1)


def matrix(column):
    """Rows of an Arrow list column as a float64 matrix."""
    import numpy as np
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype("float64")
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def exact_scores(queries, vectors):
    """Inner products of the rows, components added in order."""
    out = queries[:, 0] * vectors[:, 0]
    for d in range(1, queries.shape[1]):
        out = out + queries[:, d] * vectors[:, d]
    return out


def best_entries(queries, scores, vectors, ids, keys, own, most: int):
    """(query row, id, score, same, vector row) of the ``most`` best entries of each query.
    ``scores``: query x vector, -inf where the two don't meet; ``ids``: the ids of each
    vector; ``own`` the key of each query, ``keys`` of each vector."""
    import numpy as np

    out = []
    k = min(most, scores.shape[1])
    cut = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
    with np.errstate(invalid="ignore"):
        cut = cut - 1e-12 * (np.abs(cut) + np.linalg.norm(queries, axis=1) * np.linalg.norm(vectors, axis=1).max())
    at, near = np.nonzero((scores >= cut[:, None]) & (scores > -np.inf))
    real = exact_scores(queries[at], vectors[near])
    bounds = np.searchsorted(at, np.arange(len(queries) + 1))
    for q, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
        got = sorted((-s, i, keys[v] != own[q], v) for s, v in zip(real[a:b].tolist(), near[a:b].tolist()) for i in ids[v])
        out += [(q, i, -s, not other, v) for s, i, other, v in got[:most]]
    return out


def valid_rows(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, v, k1, k2 (a 128-bit hash of v) of the rows that take part, whatever
    their number of components."""
    x = F.col("v")
    fine = ((F.size(x) > 0) & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
            & F.exists(x, lambda e: e != 0))
    return (vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("v"))
            .where(F.col("vec_id").isNotNull() & x.isNotNull()).where(fine)
            .select("vec_id", "v", F.xxhash64(x).alias("k1"), F.xxhash64(F.lit(1), x).alias("k2")))


def nodes_of(rows: DataFrame, step: int, top: int) -> DataFrame:
    """k1, k2, v, ids, asks: one row per distinct vector with its ``top`` + 1 smallest
    ids; ``asks``: a query has this vector."""
    by_key = Window.partitionBy(*KEY).orderBy("vec_id")
    salted = Window.partitionBy(*KEY, F.pmod(F.xxhash64("vec_id"), F.lit(SALTS))).orderBy("vec_id")
    ids = rows.select(*KEY, "vec_id").distinct()
    for w in (salted, by_key):
        ids = ids.withColumn("at", F.row_number().over(w)).where(F.col("at") <= top + 1).drop("at")
    ids = ids.groupBy(*KEY).agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    return (rows.groupBy(*KEY).agg(F.first("v").alias("v"), F.max(F.col("vec_id") % step == 0).alias("asks"))
            .join(ids, list(KEY)).select(*KEY, "v", "ids", "asks"))


def _top_lists(parts: DataFrame, most: int) -> DataFrame:
    """The best entries of each query key, of parts (k1, k2, vec_id, score, same, ...)."""
    best = Window.partitionBy(*KEY).orderBy(F.desc("score"), "vec_id", F.desc("same"))
    return parts.withColumn("at", F.row_number().over(best)).where(F.col("at") <= most)


def _sample(nodes: DataFrame, rows: int, of: int):
    """About ``rows`` of the ``of`` nodes, by their hashes, at most twice as many (driver)."""
    share = min(1.0, rows / max(of, 1))
    got = nodes.where(F.pmod("k2", F.lit(1 << 30)) < int(share * (1 << 30)) + 1).select(*KEY, "v").limit(2 * rows)
    return got.orderBy(*KEY).toArrow()


def true_neighbours(assigned: DataFrame, asked, top: int):
    """(query number, leaf) of the ``top`` nearest of each row of ``asked`` (an Arrow
    table k1, k2, v of bounded size), found among all vectors."""
    queries, own = matrix(asked["v"]), list(zip(asked["k1"].to_pylist(), asked["k2"].to_pylist()))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        best = [[] for _ in own]
        for b in batches:
            if not b.num_rows:
                continue
            x, ids, leaf = matrix(b.column("v")), b.column("ids").to_pylist(), b.column("leaf").to_pylist()
            keys = list(zip(b.column("k1").to_pylist(), b.column("k2").to_pylist()))
            for q, i, s, same, v in best_entries(queries, queries @ x.T, x, ids, keys, own, top + 1):
                best[q].append((-s, i, same, leaf[v]))
            best = [sorted(g)[:top + 1] for g in best]
        rows = [(*own[q], i, -s, same, at, q) for q, g in enumerate(best) for s, i, same, at in g]
        names = ["k1", "k2", "vec_id", "score", "same", "leaf", "q"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.bool_(), pa.int32(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds)], names=names)

    parts = assigned.select(*KEY, "v", "ids", "leaf").mapInArrow(
        run, "k1 long, k2 long, vec_id long, score double, same boolean, leaf int, q int")
    lists = _top_lists(parts, top + 1).where(~F.col("same") | (F.col("at") > 1))
    return [(r["q"], r["leaf"]) for r in lists.where(F.col("at") <= top + 1).select("q", "leaf").collect()]


def calibrated_visits(tree: Tree, asked, truth, target: float) -> int:
    """The fewest leaf visits that reach ``target`` of the (query number, leaf) of ``truth``."""
    import numpy as np

    priority = tree.priorities(matrix(asked["v"])) if len(asked) else []
    needed, order = [], {}
    for q, leaf in truth:
        if q not in order:
            order[q] = {x: k + 1 for k, x in enumerate(tree.best_first(priority[q]))}
        needed.append(order[q][leaf])
    return int(np.sort(needed)[max(0, int(np.ceil(target * len(needed))) - 1)]) if needed else 1


def bins_of(rows_in_leaf: list[int], chunk: int):
    """(bin of each leaf, chunks of each bin): runs of leaves that hold ``chunk`` rows
    together at most; a larger leaf is a bin of several chunks."""
    bins, chunks, have = [], [], None
    for n in rows_in_leaf:
        if n > chunk or have is None or have + n > chunk:
            chunks.append(max(1, -(-n // chunk)))
            have = None if n > chunk else n
        else:
            have += n
        bins.append(len(chunks) - 1)
    return bins, chunks


class Index:
    """``rows`` (k1, k2, v, ids, asks, leaf) written with their leaves, and the tree."""

    def __init__(self, tree: Tree, rows: DataFrame, visits: int):
        self.tree, self.rows, self.visits = tree, rows, visits


def build(vectors: DataFrame, step: int = QUERY_STEP, top: int = TOP, target: float = TARGET,
          id_col: str = "vec_id", vec_col: str = "embedding"):
    """(valid rows, Index), or None where no vector takes part or none is a query."""
    import numpy as np

    rows = valid_rows(vectors, id_col, vec_col)
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    kinds = rows.groupBy(F.size("v").alias("d")).agg(F.count("v").alias("n"), F.max(norm).alias("m"))
    kind = kinds.orderBy(F.desc("n"), "d").first()
    if kind is None:
        return None
    rows = rows.where(F.size("v") == kind["d"])
    nodes = written(nodes_of(rows, step, top))
    count = nodes.agg(F.count("k1").alias("n"), F.count_if("asks").alias("asks")).first()
    if not count["asks"]:
        return None
    tree = Tree(matrix(_sample(nodes, SAMPLE, count["n"])["v"]), float(np.sqrt(kind["m"])))

    def assign(batches):
        import pyarrow as pa

        for b in batches:
            if b.num_rows:
                yield b.append_column("leaf", pa.array(tree.leaf_of(matrix(b.column("v"))), pa.int32()))

    element = nodes.schema["v"].dataType.simpleString()
    assigned = written(nodes.mapInArrow(assign, f"k1 long, k2 long, v {element}, ids array<long>, asks boolean, leaf int"))
    asked = _sample(nodes.where("asks"), CALIBRATE, count["asks"])
    visits = calibrated_visits(tree, asked, true_neighbours(assigned, asked, top), target)
    return rows, Index(tree, assigned, visits)


def search(index: Index, top: int = TOP) -> DataFrame:
    """k1, k2, entries: the best ``top`` + 1 entries (vec_id, score, same) of each
    vector that asks, best first."""
    tree, visits = index.tree, index.visits
    sizes = {r["leaf"]: r for r in index.rows.groupBy("leaf").agg(
        F.count("leaf").alias("n"), F.sum(F.size("ids")).alias("entries"),
        F.count_if("asks").alias("asks")).collect()}     # one row a leaf
    entries = [sizes[k]["entries"] if k in sizes else 0 for k in range(tree.leaves)]
    bins, chunks = bins_of([sizes[k]["n"] if k in sizes else 0 for k in range(tree.leaves)], CHUNK)
    blocks = max(1, -(-sum(r["asks"] for r in sizes.values()) // BLOCK))
    element = index.rows.schema["v"].dataType.simpleString()

    def visit(batches):
        import pyarrow as pa

        for b in batches:
            if not b.num_rows:
                continue
            at, where, leaves = [], [], []
            for q, priority in enumerate(tree.priorities(matrix(b.column("v")))):
                mine, seen, have = {}, 0, 0
                for leaf in tree.best_first(priority):
                    if seen >= visits and have > top:
                        break
                    seen += 1
                    have += entries[leaf]
                    if entries[leaf]:
                        mine.setdefault(bins[leaf], []).append(leaf)
                for x, some in mine.items():
                    at.append(q)
                    where.append(x)
                    leaves.append(some)
            taken = b.select(["k1", "k2", "v"]).take(pa.array(at, pa.int64()))
            yield (taken.append_column("bin", pa.array(where, pa.int32()))
                   .append_column("leaves", pa.array(leaves, pa.list_(pa.int32()))))

    asks = index.rows.where("asks").select(*KEY, "v").mapInArrow(
        visit, f"k1 long, k2 long, v {element}, bin int, leaves array<int>")
    in_bin = lambda values, at: F.get(F.lit(values), at)
    block = F.pmod("k2", F.lit(blocks))
    asks = asks.select("bin", block.alias("block"), *KEY, "v", "leaves",
                       F.explode(F.sequence(F.lit(0), in_bin(chunks, F.col("bin")) - 1)).alias("chunk"))
    rows = (index.rows.select(in_bin(bins, F.col("leaf")).alias("bin"), "leaf", *KEY, "v", "ids")
            .select("*", F.pmod("k1", in_bin(chunks, F.col("bin"))).cast("int").alias("chunk"),
                    F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block")))

    def tile(left, right):
        import numpy as np
        import pyarrow as pa

        out = []
        if left.num_rows and right.num_rows:
            right = right.sort_by("leaf")
            x, q = matrix(right["v"]), matrix(left["v"])
            leaf = right["leaf"].to_numpy()
            names, starts = np.unique(leaf, return_index=True)
            ends = np.r_[starts[1:], len(leaf)]
            ids, lists = right["ids"].to_pylist(), left["leaves"].to_pylist()
            keys, own = (list(zip(t["k1"].to_pylist(), t["k2"].to_pylist())) for t in (right, left))
            step = max(1, 2_000_000 // len(leaf))
            for a in range(0, len(q), step):
                some = q[a:a + step]
                scores = np.full((len(some), len(leaf)), -np.inf)
                wanted = {}
                for k, mine in enumerate(lists[a:a + step]):
                    for one in mine:
                        wanted.setdefault(one, []).append(k)
                for name, s, e in zip(names.tolist(), starts, ends):
                    if name in wanted:
                        scores[wanted[name], s:e] = some[wanted[name]] @ x[s:e].T
                out += [(*own[a + k], i, s, same) for k, i, s, same, _ in
                        best_entries(some, scores, x, ids, keys, own[a:a + step], top + 1)]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.bool_()]
        return pa.table({n: pa.array([r[c] for r in out], t)
                         for c, (n, t) in enumerate(zip(("k1", "k2", "vec_id", "score", "same"), kinds))})

    key = ("bin", "chunk", "block")
    parts = (asks.groupBy(*key).cogroup(rows.groupBy(*key))
             .applyInArrow(tile, "k1 long, k2 long, vec_id long, score double, same boolean"))
    return _top_lists(parts, top + 1).groupBy(*KEY).agg(
        F.sort_array(F.collect_list(F.struct("at", "vec_id", "score", "same"))).alias("entries"))


def nearest(vectors: DataFrame, step: int = QUERY_STEP, top: int = TOP, target: float = TARGET,
            id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: of each row whose id is divisible by ``step`` the
    ``top`` nearest found among all other rows."""
    got = build(vectors, step, top, target, id_col, vec_col)
    if got is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows, index = got
    queries = rows.where(F.col("vec_id") % step == 0).select(F.col("vec_id").alias("query_id"), *KEY).distinct()
    others = F.filter("entries", lambda e: ~(e["same"] & (e["vec_id"] == F.col("query_id"))))
    return (queries.join(search(index, top), list(KEY))
            .select("query_id", F.posexplode(F.slice(others, 1, top)).alias("rank", "e"))
            .select("query_id", (F.col("rank") + 1).alias("rank"), "e.vec_id", "e.score"))
