"""Exact top-k inner-product search with ball trees.

The vectors are dealt by space: a bounded sample gives pivots, a vector goes to the cell of its nearest pivot, and a cell is cut into
shards of a bounded size, each with a ball tree. Before anything is shuffled, the ball of a cell tells which queries can find
anything in it: a node's upper bound is the inner product with its centre plus query length times radius. What is left of a
block of queries goes down a shard's tree, nodes in the order of their bounds, and a node is left out for the queries
whose current kth score it cannot reach.

The current kth score is shared in waves. A query is searched first in one shard of the cell of its highest inner product, then in that
cell's other shards and the next best cells, then in all cells left; each wave starts from the kth score of those before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .staging import forget, written

SHARD_ROWS = 8192
QUERY_ROWS = 2048
LEAF = 128
#: Cells of a dimension at most, and sampled rows for each of them.
CELLS = 1024
PIVOT_SAMPLE = 8
#: Cells of the second wave besides that of the first.
NEXT_CELLS = 3
EXACT = 2.0**53
NO_ID = np.iinfo(np.int64).max
LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def build_tree(x: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The order of the rows, and of each node its (start, end, left child or -1, right child), centre and radius."""
    order, nodes, centres, radii = np.arange(len(x)), [], [], []

    def add(start: int, end: int) -> int:
        rows = x[order[start:end]]
        centre = rows.mean(axis=0)
        at = len(nodes)
        nodes.append([start, end, -1, -1])
        centres.append(centre)
        radii.append(np.sqrt(((rows - centre) ** 2).sum(axis=1).max()))
        return at

    stack = [add(0, len(x))] if len(x) else []
    while stack:
        at = stack.pop()
        start, end = nodes[at][:2]
        if end - start <= leaf or radii[at] == 0:
            continue
        rows = x[order[start:end]]
        a = rows[((rows - centres[at]) ** 2).sum(axis=1).argmax()]
        b = rows[((rows - a) ** 2).sum(axis=1).argmax()]
        side = np.argsort(rows @ (b - a), kind="stable")
        order[start:end] = order[start:end][side]
        middle = (start + end) // 2
        nodes[at][2], nodes[at][3] = add(start, middle), add(middle, end)
        stack += nodes[at][2:]
    return order, np.array(nodes, np.int64).reshape(-1, 4), np.array(centres).reshape(len(nodes), x.shape[1]), np.array(radii)


def upper_bounds(q: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """Of each query and ball, no less than any inner product; never below the least long, where scores saturate."""
    norms = np.sqrt((q**2).sum(axis=1))[:, None]
    reach = radii[None] * (1 + 1e-9) + 1e-9 * np.sqrt((centres**2).sum(axis=1))[None]
    return np.maximum(q @ centres.T + norms * reach + 1e-6, float(LEAST))


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products of long vectors, as longs. Those beyond 64 bits become the nearest long."""
    top = float(np.abs(q.astype(float)).max(initial=0)) * float(np.abs(x.astype(float)).max(initial=0)) * x.shape[1]
    if top < EXACT:
        return (q.astype(float) @ x.astype(float).T).astype(np.int64)
    if top < 2.0**62:
        return q.astype(np.int64) @ x.astype(np.int64).T
    whole = q.astype(np.int64).astype(object) @ x.astype(np.int64).astype(object).T
    return np.array([[min(max(v, LEAST), MOST) for v in row] for row in whole], np.int64).reshape(whole.shape)


def at_most(scores: np.ndarray) -> np.ndarray:
    """As floats, rounded down."""
    return np.where(np.abs(scores.astype(float)) < EXACT, scores, np.nextafter(scores.astype(float), -np.inf))


def search_tree(tree: tuple, x: np.ndarray, ids: np.ndarray, q: np.ndarray, q_ids: np.ndarray, kth: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of the query, id, score) of all that may be among a query's k best: scores of at least its kth so far.

    ``x`` and ``ids`` lie in tree order; vectors and scores are longs. Of each query at most k rows come back, ties to the smaller id."""
    _, nodes, centres, radii = tree
    n, kth = len(q), kth.astype(float).copy()
    best_s, best_i = np.full((n, k), LEAST), np.full((n, k), NO_ID)
    absent = np.ones((n, k), bool)
    if not len(nodes):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    bounds = upper_bounds(q.astype(float), centres, radii)
    heap = [(float(bounds[:, 0].max()), 0)]
    while heap:
        heap.sort()
        _, at = heap.pop()
        live = np.flatnonzero(bounds[:, at] >= kth)
        if not len(live):
            continue
        start, end, left, right = nodes[at]
        if left >= 0:
            heap += [(float(bounds[live, c].max()), int(c)) for c in (left, right)]
            continue
        scores = products(q[live], x[start:end])
        own = ids[start:end]
        no = (own[None] == q_ids[live][:, None]) | (scores.astype(float) < kth[live][:, None])
        some = ~no.all(axis=1)
        live, scores, no = live[some], scores[some], no[some]
        if not len(live):
            continue
        s = np.hstack([best_s[live], scores])
        i = np.hstack([best_i[live], np.broadcast_to(own, scores.shape)])
        gone = np.hstack([absent[live], no])
        top = np.lexsort((i, ~s, gone), axis=-1)[:, :k]  # ~s falls where s rises
        best_s[live], best_i[live], absent[live] = (np.take_along_axis(a, top, axis=1) for a in (s, i, gone))
        full = live[~absent[live, -1]]
        kth[full] = np.maximum(kth[full], at_most(best_s[full, -1]))
    rows, places = np.nonzero(~absent)
    return rows, best_i[rows, places], best_s[rows, places]


def quantised(df: DataFrame, key: str, vector: str, scale: float) -> DataFrame:
    """``id`` and ``v`` (floor(scale * x) as long); without null keys, null or empty vectors, and null or non-finite components.
    A component beyond 64 bits becomes the nearest long."""
    finite = F.forall(F.col(vector), lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    rows = df.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0) & finite)
    return rows.select(F.col(key).cast("long").alias("id"), F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double"))).alias("v"))


def packed(x: np.ndarray) -> tuple[str, bytes]:
    """The narrowest integers that hold ``x``, and its bytes."""
    for kind in ("i1", "i2", "i4"):
        if not x.size or (np.iinfo(kind).min <= x.min() and x.max() <= np.iinfo(kind).max):
            return kind, np.ascontiguousarray(x, kind).tobytes()
    return "i8", np.ascontiguousarray(x, "i8").tobytes()


def unpacked(kind: str, raw: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(raw, kind).reshape(-1, dim).astype(np.int64)


def _pivots(rows: DataFrame, counts: dict[int, int], shard_rows: int) -> dict[int, np.ndarray]:
    """Of each dimension, different vectors from a sample of PIVOT_SAMPLE for each cell: one for each shard, CELLS at most."""
    wanted = {d: min(CELLS, -(-n // shard_rows)) for d, n in counts.items()}
    spots = 1 << 30
    spot = F.pmod(F.xxhash64(F.col("v"), F.lit("pivot")), F.lit(spots))
    few = F.lit(False)
    for d, cells in wanted.items():
        few = few | ((F.col("dim") == d) & (spot < int(spots * min(1.0, PIVOT_SAMPLE * (cells + 4) / counts[d]))))
    found: dict[int, list] = {}
    # equal vectors share their spot: they come as one, however many they are
    for r in rows.where(few).select("dim", "v", spot.alias("spot")).distinct().orderBy("spot").limit(PIVOT_SAMPLE * (sum(wanted.values()) + 4 * len(wanted)) * 4).collect():
        if len(found.setdefault(r["dim"], [])) < wanted[r["dim"]]:
            found[r["dim"]].append(r["v"])
    return {d: np.array(found.get(d) or [[0] * d], float) for d in wanted}


def _distances(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest pivot, and the distance from it."""
    near = ((pivots**2).sum(axis=1)[None] - 2 * (x @ pivots.T)).argmin(axis=1)
    return near, np.sqrt(((x - pivots[near]) ** 2).sum(axis=1))


def top_k(queries: DataFrame, rows: DataFrame, k: int, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id`` and ``score``: the k rows of the highest integer inner product with each query.

    Both tables have ``id`` and ``v`` (array of long); other columns, whatever their names, are not read. A row is no
    candidate for a query of its own id or of another dimension. Ties go to the smaller id, and repeated rows count as often as they
    occur; a repeated query is one query. A score beyond 64 bits is reported, and ranks, as the nearest long. Empty tables give
    an empty result.
    """
    spark = rows.sparkSession
    rows = rows.select("id", "v").withColumn("dim", F.size("v"))
    counts = {r["dim"]: r["count"] for r in rows.groupBy("dim").count().collect()}
    if not counts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    pivots = spark.sparkContext.broadcast(_pivots(rows, counts, shard_rows))

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for dim, part in pdf.groupby("dim"):
                x = np.stack(part["v"].to_numpy())
                cell, far = _distances(x.astype(float), pivots.value[dim])
                yield pd.DataFrame({"id": part["id"], "v": list(x), "dim": dim, "cell": cell, "far": far})

    dealt = written(rows.mapInPandas(deal, "id long, v array<long>, dim int, cell int, far double").withColumn("row", F.monotonically_increasing_id()), "dealt")
    cells = dealt.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()
    salts = {(c["dim"], c["cell"]): -(-c["n"] // shard_rows) for c in cells}
    balls: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    for dim in counts:
        held = sorted((c["cell"], c["far"]) for c in cells if c["dim"] == dim)
        at = np.array([c for c, _ in held])
        balls[dim] = (at, pivots.value[dim][at], np.array([f for _, f in held]) * (1 + 1e-9))
    known = spark.sparkContext.broadcast((balls, salts))

    def trees(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf["v"].to_numpy())
        ids = pdf["id"].to_numpy(np.int64)
        order, *tree = build_tree(x.astype(float))
        kind, raw = packed(x[order])
        parts = {f"t{i}": [p.tobytes()] for i, p in enumerate([ids[order], *tree])}
        return pd.DataFrame({"dim": [key[0]], "cell": [key[1]], "salt": [key[2]], "kind": [kind], "x": [raw], **parts})

    many = F.create_map(*[F.lit(x) for (d, c), n in salts.items() if n > 1 for x in (f"{d} {c}", n)]) if max(salts.values()) > 1 else None
    salt = F.lit(0) if many is None else F.pmod("row", F.coalesce(many[F.concat_ws(" ", "dim", "cell")], F.lit(1))).cast("int")
    forest = dealt.withColumn("salt", salt).select("id", "v", "dim", "cell", "salt").groupBy("dim", "cell", "salt")
    schema = "dim int, cell int, salt int, kind string, x binary, t0 binary, t1 binary, t2 binary, t3 binary"
    forest = written(forest.applyInPandas(trees, schema), "trees")
    forget(dealt)

    def ask(wave: int):  # noqa: ANN202
        """For each batch of queries, the shards of the wave that can hold one of their k best, with just those queries."""

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in frames:
                for dim, every in pdf.groupby("dim"):
                    for start in range(0, len(every), query_rows):
                        yield blocks(int(dim), every.iloc[start : start + query_rows])

        def blocks(dim: int, part: pd.DataFrame) -> pd.DataFrame:
            (at, centres, radii), shards_of = known.value[0][dim], known.value[1]
            q, ids = np.stack(part["v"].to_numpy()), part["id"].to_numpy(np.int64)
            kth = part["kth"].to_numpy(float)
            kth = np.where(np.isnan(kth), -np.inf, kth)
            bounds = upper_bounds(q.astype(float), centres, radii)
            home = (q.astype(float) @ centres.T).argmax(axis=1)
            ahead = np.argsort(-np.where(np.arange(len(at)) == home[:, None], np.inf, bounds), axis=1)[:, : 1 + NEXT_CELLS]
            near = np.zeros(bounds.shape, bool)
            np.put_along_axis(near, ahead, True, axis=1)
            out = []
            for j, cell in enumerate(at.tolist()):
                n = shards_of[dim, cell]
                mine, reached = home == j, bounds[:, j] >= kth
                for s in range(n):
                    first = mine & (ids % n == s)
                    live = np.flatnonzero((first, near[:, j] & ~first, ~near[:, j])[wave] & reached)
                    if len(live):
                        kind, raw = packed(q[live])
                        out.append((dim, cell, s, ids[live].tobytes(), kth[live].tobytes(), kind, raw))
            return pd.DataFrame(out, columns=["dim", "cell", "salt", "q_ids", "q_kth", "q_kind", "q"])

        return run

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                ids, x, q = np.frombuffer(r.t0, np.int64), unpacked(r.kind, r.x, r.dim), unpacked(r.q_kind, r.q, r.dim)
                tree = (None, np.frombuffer(r.t1, np.int64).reshape(-1, 4), np.frombuffer(r.t2).reshape(-1, r.dim), np.frombuffer(r.t3))
                q_ids = np.frombuffer(r.q_ids, np.int64)
                row, i, s = search_tree(tree, x, ids, q, q_ids, np.frombuffer(r.q_kth), k)
                yield pd.DataFrame({"query_id": q_ids[row], "vec_id": i, "score": s})

    asked = queries.select("id", "v").withColumn("dim", F.size("v")).where(F.col("dim").isin(list(counts))).distinct()
    asked = written(asked, "asked")
    by_rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = None
    for wave in range(3):
        if found is None:
            now = asked.withColumn("kth", F.lit(None).cast("double"))
        else:
            kth = found.withColumn("r", F.row_number().over(by_rank)).where(F.col("r") == k)
            # one less where a double may round the score up
            score = F.when(F.abs(F.col("score").cast("double")) < EXACT, F.col("score").cast("double")).otherwise(F.col("score").cast("double") * (1 - F.signum("score") * 1e-15))
            now = asked.join(kth.select(F.col("query_id").alias("id"), score.alias("kth")), "id", "left")
        blocks = now.select("id", "v", "dim", "kth").mapInPandas(ask(wave), "dim int, cell int, salt int, q_ids binary, q_kth binary, q_kind string, q binary")
        hits = written(forest.join(blocks, ["dim", "cell", "salt"]).mapInPandas(search, "query_id long, vec_id long, score long"), f"wave{wave}")
        found = hits if found is None else found.union(hits)
    found = found.withColumn("rank", F.row_number().over(by_rank)).where(F.col("rank") <= k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
