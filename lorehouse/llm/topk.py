"""Operator 10: exact top-k inner products, by ball-tree branch and bound per shard.

Candidates fall into cells, each around one of a bounded number of sampled vectors,
and a cell of more rows than a task should hold is dealt over several shards. Over
each shard a tree of balls is built, once, and written as arrays to the shared
folder. No vector x of a ball with centre c and radius r gives a query q more than
q.c + |q| r: a query takes the balls of a shard in the order of that bound and stops
below its current kth score.

Every query first meets the shard that it lies in itself. The kth score found there
goes along with it, and only shards whose root ball may still beat it are visited. A
task reads its shard's tree and lets the queries stream by in batches: no vector is
copied for a block of queries, and a query is copied to the shards in its reach alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Components of the vectors of one shard, about: 32 MB.
SHARD_CELLS = 1 << 22
#: Cells at most, and components of their sampled centres that go to all tasks.
PIVOTS, PIVOT_CELLS = 1_024, 1 << 22
#: Components of root balls that go to all tasks at once; more are taken in blocks.
ROOT_CELLS = 1 << 22
LEAF = 64
#: Leaves that each query visits in its own order; those left are then visited one by one, by all queries that they may still serve.
OWN_TURNS = 4
#: Bytes of a tree in one row.
PART = 1 << 16
#: Inner products below this are exact in doubles.
EXACT = float(1 << 52)
_LONG = (-(1 << 63), (1 << 63) - 1)
_KEY = ("dim", "cell", "salt")
_KEY_TYPES = "dim int, cell int, salt int"


class BallTree:
    """Rows of x with their ids and how often each counts, in the order of the leaves."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, times: np.ndarray, leaf: int = LEAF):
        order = np.arange(len(x))
        nodes: list[list[int]] = []  # first row, end, left, right
        centres, radii = [], []
        todo = [(0, len(x), -1, 0)]
        while todo:
            a, b, parent, side = todo.pop()
            rows = x[order[a:b]]
            centre = rows.mean(axis=0)
            away = np.sqrt(((rows - centre) ** 2).sum(axis=1))
            me = len(nodes)
            nodes.append([a, b, -1, -1])
            centres.append(centre)
            radii.append(away.max(initial=0.0))
            if parent >= 0:
                nodes[parent][2 + side] = me
            if b - a > leaf and radii[-1] > 0:
                far = rows[away.argmax()]
                other = rows[((rows - far) ** 2).sum(axis=1).argmax()]
                split = np.argsort(rows @ (other - far), kind="stable")
                order[a:b] = order[a:b][split]
                middle = (a + b) // 2
                todo += [(a, middle, me, 0), (middle, b, me, 1)]
        self.x, self.ids, self.times = x[order], ids[order], times[order]
        self.nodes, self.centres, self.radii = np.array(nodes), np.array(centres).reshape(len(nodes), x.shape[1]), np.array(radii)

    def to_bytes(self) -> bytes:
        head = np.array([len(self.ids), self.x.shape[1], len(self.radii)], dtype="<i8")
        whole = (head, self.ids.astype("<i8"), self.times.astype("<i8"), self.nodes.astype("<i8"), self.radii.astype("<f8"), self.centres.astype("<f8"), self.x.astype("<f8"))
        return b"".join(a.tobytes() for a in whole)

    @classmethod
    def from_bytes(cls, raw: bytes) -> BallTree:
        n, dim, m = np.frombuffer(raw, "<i8", 3)
        at = 24

        def take(count: int, kind: str) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, kind, count, at)
            at += 8 * count
            return out

        tree = cls.__new__(cls)
        tree.ids, tree.times, tree.nodes, tree.radii = take(n, "<i8"), take(n, "<i8"), take(4 * m, "<i8").reshape(m, 4), take(m, "<f8")
        tree.centres, tree.x = take(m * dim, "<f8").reshape(m, dim), take(n * dim, "<f8").reshape(n, dim)
        return tree


def reach(q: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """For each query and ball a value that no inner product of the two exceeds, rounding included."""
    norm = np.sqrt((q**2).sum(axis=1))
    far = np.sqrt((centres**2).sum(axis=1)) + radii
    return q @ centres.T + np.outer(norm, radii) + 1e-9 * (np.outer(norm, far) + 1)


def search(q: np.ndarray, q_ids: np.ndarray, kth: np.ndarray, tree: BallTree, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, row of the tree, score) of the k best rows with another id for each row of q, kth or better, ties to the smaller id. A row that counts several times is one of them."""
    longest = np.sqrt((tree.x**2).sum(axis=1).max(initial=0.0)) * np.sqrt((q**2).sum(axis=1).max(initial=0.0))
    if longest >= EXACT:
        return _search_whole(q, q_ids, tree, k)
    kth = kth.astype(float).copy()
    best_row, best = np.full((len(q), k), -1), np.full((len(q), k), -np.inf)
    ids = np.append(tree.ids, np.iinfo(np.int64).max)  # of row -1

    # Downwards: the leaves that a query may have to visit, with their bounds.
    visits: list[tuple[np.ndarray, np.ndarray, int]] = []
    todo = [(0, np.arange(len(q)))]
    while todo:
        node, rows = todo.pop()
        value = reach(q[rows], tree.centres[node : node + 1], tree.radii[node : node + 1])[:, 0]
        stay = value >= kth[rows]
        rows, value = rows[stay], value[stay]
        if len(rows):
            _, _, left, right = tree.nodes[node]
            if left < 0:
                visits.append((rows, value, node))
            else:
                todo += [(left, rows), (right, rows)]
    if not visits:
        none = np.empty(0, dtype=np.int64)
        return none, none, none

    def visit(node: int, rows: np.ndarray) -> None:
        a, b, _, _ = tree.nodes[node]
        scores = q[rows] @ tree.x[a:b].T
        scores[tree.ids[a:b] == q_ids[rows][:, None]] = -np.inf
        some = scores.max(axis=1) >= kth[rows]
        rows, scores = rows[some], scores[some]
        if len(rows):
            at = np.hstack([best_row[rows], np.broadcast_to(np.arange(a, b), scores.shape)])
            scores = np.hstack([best[rows], scores])
            top = np.lexsort((ids[at], -scores), axis=1)[:, :k]
            best_row[rows], best[rows] = np.take_along_axis(at, top, 1), np.take_along_axis(scores, top, 1)
            kth[rows] = np.maximum(kth[rows], best[rows, -1])

    row = np.concatenate([v[0] for v in visits])
    value = np.concatenate([v[1] for v in visits])
    leaf = np.concatenate([np.full(len(v[0]), v[2]) for v in visits])
    order = np.lexsort((-value, row))
    row, value, leaf = row[order], value[order], leaf[order]
    turn = np.arange(len(row)) - np.searchsorted(row, row)
    for t in range(OWN_TURNS):  # the t-th best leaf of every query
        at = np.flatnonzero(turn == t)
        at = at[value[at] >= kth[row[at]]]
        for node in np.unique(leaf[at]):
            visit(node, row[at[leaf[at] == node]])
    rest = np.flatnonzero(turn >= OWN_TURNS)
    rest = rest[value[rest] >= kth[row[rest]]]
    rest = rest[np.argsort(leaf[rest], kind="stable")]
    parts = np.split(rest, np.flatnonzero(np.diff(leaf[rest])) + 1) if len(rest) else []
    for at in sorted(parts, key=lambda at: -value[at].max()):
        at = at[value[at] >= kth[row[at]]]
        if len(at):
            visit(leaf[at[0]], row[at])
    n, j = np.nonzero(np.isfinite(best))
    return n, best_row[n, j], best[n, j].astype(np.int64)


def _search_whole(q: np.ndarray, q_ids: np.ndarray, tree: BallTree, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same in whole numbers of any size, held at the ends of a long, one after the other."""
    x = [[int(v) for v in row] for row in tree.x]
    out = []
    for n, row in enumerate(q):
        whole = [int(v) for v in row]
        scores = [(-min(max(sum(a * b for a, b in zip(whole, y, strict=True)), _LONG[0]), _LONG[1]), int(i), m) for m, (y, i) in enumerate(zip(x, tree.ids, strict=True)) if i != q_ids[n]]
        out += [(n, m, -s) for s, _, m in sorted(scores)[:k]]
    a = np.array(out, dtype=np.int64).reshape(-1, 3)
    return a[:, 0], a[:, 1], a[:, 2]


def _by_length(vectors: pd.Series) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, vectors as one matrix) for each length among some vectors."""
    n = np.array([len(v) for v in vectors])
    for dim in np.unique(n):
        at = np.flatnonzero(n == dim)
        yield at, np.stack(vectors.to_numpy()[at]).astype(float).reshape(len(at), dim)


def _cells(rows: DataFrame, shard_cells: int, most: int) -> DataFrame:
    """rows (vec_id, v, dim) with cell, the nearest sampled vector of its length, -1 where there is none, and salt, its part of a cell that is too large for one shard."""
    size = rows.agg(F.count("*").alias("n"), F.sum(F.greatest("dim", F.lit(1))).alias("cells"), F.max("dim").alias("dim")).first()
    n, wide = size["n"], max(size["dim"] or 1, 1)
    wanted = int(min(most, PIVOT_CELLS // wide, (size["cells"] or 0) // shard_cells))
    drawn = F.xxhash64("vec_id", F.lit(10))
    few = rows.where(F.pmod(drawn, F.lit(1 << 30)) < F.lit(int(min(1, 4 * wanted / max(n, 1)) * (1 << 30)))).orderBy(drawn, "v").limit(wanted)
    chosen: dict[int, list] = {}
    for r in few.select("v").collect() if wanted else ():  # `most` rows at most
        chosen.setdefault(len(r["v"]), []).append(r["v"])
    first, pivots = 0, {}
    for dim, vs in sorted(chosen.items()):
        pivots[dim] = (first, np.unique(np.array(vs, dtype=float).reshape(-1, dim), axis=0))
        first += len(vs)
    held = rows.sparkSession.sparkContext.broadcast(pivots)

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cell = np.full(len(batch), -1, dtype=np.int32)
            for at, x in _by_length(batch["v"]):
                if x.shape[1] in held.value:
                    start, p = held.value[x.shape[1]]
                    cell[at] = start + ((p**2).sum(axis=1) - 2 * x @ p.T).argmin(axis=1)
            yield batch.assign(cell=cell)

    out = cut(rows.mapInPandas(placed, f"{_types(rows)}, cell int"))
    # Cells over the size of a shard: no more than there are shards.
    large = out.groupBy("dim", "cell").agg((F.count("*") * F.greatest("dim", F.lit(1)) / F.lit(shard_cells)).alias("parts")).where(F.col("parts") > 1)
    large = large.select("dim", "cell", F.ceil("parts").cast("int").alias("parts"))
    return out.join(large, ["dim", "cell"], "left").withColumn("salt", F.pmod(F.xxhash64("vec_id", "v"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")


def _types(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", shard_cells: int = SHARD_CELLS, pivots: int = PIVOTS, root_cells: int = ROOT_CELLS) -> DataFrame:
    """query_id, rank, vec_id, score: for every row whose id is divisible by `every` its k highest integer inner products.

    Vectors that are null or hold a null or non-finite component take no part, nor
    do rows without an id, and vectors meet those of their own length only. Every
    row is a candidate, repeated ones as often as they are there, but a query never
    meets its own id. Rows that repeat a query's id and vector are one query; rows of
    one id with other vectors ask together for the k best scores of all. Scores
    beyond a long are held at its ends. An empty table gives an empty one.
    """
    spark = vectors.sparkSession

    def floors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for v in batch["v"]:
                x = np.floor(256 * np.asarray(v, dtype=float))
                out.append(x + 0.0 if np.isfinite(x).all() else None)
            yield batch.assign(v=out)

    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda c: c.isNull()))
    # Of equal rows k at most can count for one query.
    rows = cut(rows.mapInPandas(floors, rows.schema).where(F.col("v").isNotNull()).groupBy("vec_id", "v").agg(F.least(F.count("*"), F.lit(k)).alias("times")).withColumn("dim", F.size("v")))
    rows = cut(_cells(rows, shard_cells, pivots))

    def planted(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        tree = BallTree(np.stack(part["v"].to_numpy()).astype(float).reshape(len(part), key[0]), part["vec_id"].to_numpy(), part["times"].to_numpy())
        raw = tree.to_bytes()
        cuts = range(0, len(raw), PART)
        root = np.append(tree.centres[0], tree.radii[0])
        return pd.DataFrame({"dim": key[0], "cell": key[1], "salt": key[2], "part": np.arange(len(cuts)), "blob": [raw[a : a + PART] for a in cuts], "root": [root] + [None] * (len(cuts) - 1)})

    trees = cut(rows.groupBy(*_KEY).applyInPandas(planted, f"{_KEY_TYPES}, part int, blob binary, root array<double>"))
    queries = cut(rows.where(F.col("vec_id") % every == 0).drop("times"))

    def streamed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, blobs, tree = None, [], None
        for batch in batches:
            for key, rows in batch.groupby(list(_KEY), sort=False):  # in the order of the rows
                if key != at:
                    at, blobs, tree = key, [], None
                blobs += [b for b in rows["blob"] if b is not None]
                asked = rows[rows["blob"].isna()]
                if not len(asked) or not blobs and tree is None:
                    continue
                if tree is None:
                    tree, blobs = BallTree.from_bytes(b"".join(blobs)), []
                q_ids = asked["vec_id"].to_numpy().astype(np.int64)
                n, m, score = search(np.stack(asked["v"].to_numpy()).astype(float).reshape(len(asked), key[0]), q_ids, asked["kth"].to_numpy(), tree, k)
                yield pd.DataFrame({"query_id": q_ids[n], "vec_id": tree.ids[m], "score": score, "times": tree.times[m]})

    def met(asked: DataFrame) -> DataFrame:
        """What queries (vec_id, v, kth) find in the shard that they name: after each tree come its queries."""
        both = trees.select(*_KEY, "part", "blob").unionByName(asked.select(*_KEY, "vec_id", "v", "kth"), allowMissingColumns=True)
        in_order = both.repartition(*_KEY).sortWithinPartitions(*_KEY, F.col("blob").isNull(), "part")
        return in_order.mapInPandas(streamed, "query_id bigint, vec_id bigint, score bigint, times bigint")

    by_rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def best(found: DataFrame) -> DataFrame:
        """The first k of each query. Rows that count several times are that many."""
        few = found.withColumn("nth", F.row_number().over(by_rank)).where(F.col("nth") <= k)
        every_one = few.withColumn("_t", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).withColumn("rank", F.row_number().over(by_rank))
        return every_one.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    first = cut(met(queries.withColumn("kth", F.lit(float("-inf")))))
    known = best(first).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("kth"))
    asking = cut(queries.join(known, "vec_id", "left").withColumn("kth", F.coalesce("kth", F.lit(float("-inf")))))
    found = first
    roots = trees.where(F.col("root").isNotNull()).select(*_KEY, "root")
    cells = roots.agg(F.sum(F.size("root"))).first()[0] or 0
    blocks = 1 + cells // root_cells
    for block in range(blocks):
        held = spark.sparkContext.broadcast(_stacked(roots.where(F.pmod(F.xxhash64(*_KEY), F.lit(blocks)) == block).collect()))  # about root_cells components

        def sent(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for at, x in _by_length(batch["v"]):
                    keys, centres, radii = held.value.get(x.shape[1], (np.empty((0, 3), dtype=int), np.empty((0, x.shape[1])), np.empty(0)))
                    own = batch[list(_KEY)].to_numpy()[at]
                    away = (own[:, None, :] != keys[None, :, :]).any(axis=2)
                    n, m = np.nonzero((reach(x, centres, radii) >= batch["kth"].to_numpy()[at][:, None]) & away)
                    for a in range(0, len(n), 10_000):
                        some = batch[["vec_id", "v", "kth"]].iloc[at[n[a : a + 10_000]]].reset_index(drop=True)
                        yield some.assign(**dict(zip(_KEY, keys[m[a : a + 10_000]].T.astype(np.int32), strict=True)))

        found = found.unionByName(met(asking.mapInPandas(sent, f"vec_id bigint, v array<double>, kth double, {_KEY_TYPES}")))
    return best(found)


def _stacked(roots: list) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: keys, centres and radii of root balls."""
    out: dict[int, list] = {}
    for r in roots:
        out.setdefault(r["dim"], []).append(r)
    return {d: (np.array([[r[c] for c in _KEY] for r in rs]), np.array([r["root"][:-1] for r in rs], dtype=float).reshape(len(rs), d), np.array([r["root"][-1] for r in rs])) for d, rs in out.items()}
