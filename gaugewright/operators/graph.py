"""Knowledge graphs: a table of nodes and a table of edges."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import prod

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.shared import written
from .communities import SMALL, leiden


@dataclass(frozen=True)
class Graph:
    """``nodes``: id, type, and properties as columns; ``edges``: id, type, src, dst, bidirectional, and properties."""

    nodes: DataFrame
    edges: DataFrame

    def save(self, path: str) -> None:
        self.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
        self.edges.write.mode("overwrite").parquet(f"{path}/edges")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Graph:
        """Read a saved graph; an edge to a node that is not there is an error."""
        graph = Graph(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges"))
        if dangling := graph.dangling().limit(1).collect():
            raise KeyError(f"edge {dangling[0]['id']} has an end that is no node")
        return graph

    def dangling(self) -> DataFrame:
        ids = self.nodes.select(F.col("id").alias("_id"))
        ends = self.edges.select("id", F.explode(F.array("src", "dst")).alias("end"))
        return ends.join(ids, F.col("end") == F.col("_id"), "left_anti")

    def where(self, predicate: Column) -> Graph:
        """The nodes that fit, and the edges with both ends among them."""
        nodes = self.nodes.where(predicate)
        ids = nodes.select(F.col("id").alias("_id"))
        edges = self.edges.join(ids, F.col("src") == F.col("_id"), "left_semi").join(ids, F.col("dst") == F.col("_id"), "left_semi")
        return Graph(nodes, edges)

    def without(self, ids: DataFrame) -> Graph:
        """Drop the nodes of column ``id`` and the edges that touch them."""
        gone = ids.select(F.col("id").alias("_id"))
        edges = self.edges.join(gone, F.col("src") == F.col("_id"), "left_anti").join(gone, F.col("dst") == F.col("_id"), "left_anti")
        return Graph(self.nodes.join(gone, F.col("id") == F.col("_id"), "left_anti"), edges)

    def remove(self, *ids: object) -> Graph:
        """Drop nodes by their ids; one that is not there is an error."""
        there = {r["id"] for r in self.nodes.where(F.col("id").isin(*ids)).select("id").distinct().collect()}
        if missing := [i for i in ids if i not in there]:
            raise ValueError(f"no such node: {', '.join(map(str, missing))}")
        return Graph(self.nodes.where(~F.col("id").isin(*ids)), self.edges.where(~F.col("src").isin(*ids) & ~F.col("dst").isin(*ids)))

    def rated_summaries(self, summary: str = "summary") -> DataFrame:
        """``id``, ``summary`` and ``page_content`` of the nodes to be rated: a chunk by the summary of its first parent, any other by its own. Nodes
        without one are not rated, and so never dropped for it."""
        up = self.edges.where(F.col("type") == "child").groupBy(F.col("dst").alias("_chunk")).agg(F.min("src").alias("_up"))
        own = self.nodes.select(F.col("id").alias("_up"), F.col(summary).alias("_of"))
        chunks = self.nodes.where(F.col("type") == "chunk").join(up, F.col("id") == F.col("_chunk")).join(own, "_up").select("id", F.col("_of").alias("summary"), "page_content")
        others = self.nodes.where(F.col("type") != "chunk").select("id", F.col(summary).alias("summary"), "page_content")
        return chunks.unionByName(others).where(F.length(F.trim("summary")) > 0)

    def with_property(self, name: str, value: Column) -> Graph:
        """Set a property where it is absent."""
        name = name.lower()
        value = F.coalesce(F.col(name), value) if name in self.nodes.columns else value
        return Graph(self.nodes.withColumn(name, value), self.edges)

    def add(self, nodes: DataFrame, edges: DataFrame) -> Graph:
        return Graph(self.nodes.unionByName(nodes, allowMissingColumns=True), self.edges.unionByName(edges, allowMissingColumns=True))

    def drop_low_scores(self, scores: DataFrame, least: float = 2) -> Graph:
        """Drop nodes whose score (id, score) is ``least`` or lower; a node without a score stays."""
        return self.without(scores.where(F.col("score") <= least).select("id"))


def hops(edges: DataFrame, start: DataFrame, depth: int, kind: str = "child", up: bool = False) -> DataFrame:
    """(root, id, depth): the nodes within ``depth`` edges of ``kind`` below each start node, or above it. One join per level."""
    a, b = ("dst", "src") if up else ("src", "dst")
    steps = edges.where(F.col("type") == kind).select(F.col(a).alias("_from"), F.col(b).alias("_to")).distinct()
    level = start.select(F.col("id").alias("root"), F.col("id").alias("id"), F.lit(0).alias("depth"))
    found = None
    for d in range(1, depth + 1):
        level = level.join(steps, F.col("id") == F.col("_from")).select("root", F.col("_to").alias("id"), F.lit(d).alias("depth")).distinct()
        found = level if found is None else found.union(level)
    return found.groupBy("root", "id").agg(F.min("depth").alias("depth")) if found is not None else level.limit(0)


def triples(graph: Graph, predicate: Column | None = None) -> DataFrame:
    """Distinct (a, type, b) with a < b of edges that join two nodes; loops are left out."""
    edges = graph.edges if predicate is None else graph.edges.where(predicate)
    return edges.where("src <> dst").select(F.least("src", "dst").alias("a"), "type", F.greatest("src", "dst").alias("b")).distinct()


def neighbours(edges: DataFrame) -> DataFrame:
    """(src, dst) of every step: edges from source to target, bidirectional ones both ways; no loops."""
    forward = edges.select("src", "dst")
    back = edges.where(F.coalesce("bidirectional", F.lit(False))).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return forward.union(back).where("src <> dst").distinct()


#: A community that could hold fewer simple paths than this is listed whole; of others so many walks of each length are taken.
MOST_PATHS = 1000
#: Steps that a task extends paths by, about: a step may make hundreds of paths, which its bytes do not tell.
STEPS = 5000


def simple_paths(edges: DataFrame, depth: int, starts: DataFrame | None = None) -> DataFrame:
    """``root`` and ``path`` (array of ids): all simple paths of 1 to ``depth`` edges, from the nodes ``starts`` (id) or from every one."""
    steps = written(neighbours(edges), "steps")
    level = steps if starts is None else steps.join(starts.select(F.col("id").alias("_id")), F.col("src") == F.col("_id"), "left_semi")
    level = level.select(F.col("src").alias("root"), F.array("src", "dst").alias("path"))
    found, parts = level, max(64, steps.count() // STEPS)
    dealt = steps.repartition(parts, "src")
    for _ in range(depth - 1):
        ends = level.withColumn("src", F.element_at("path", -1)).repartition(parts, "src")
        grown = ends.join(dealt, "src").where(~F.array_contains("path", F.col("dst")))
        level = written(grown.select("root", F.concat("path", F.array("dst")).alias("path")), "paths")
        found = found.union(level)
    return found


#: Steps of the communities that are packed together, about; paths that a task lists, about; cells of a table of neighbours; sets of a batch.
PACKED, LISTED, CELLS, BATCH = 200_000, 4_000_000, 1 << 22, 1 << 16


def _starts(ends: np.ndarray, n: int) -> np.ndarray:
    return np.searchsorted(ends, np.arange(n + 1))


def _packed(table: pa.Table) -> pa.Table:
    """Steps (src, dst) as one row: the nodes' sorted names, and the places that each node leads to and is reached from."""
    names = pc.unique(pa.chunked_array([*table["src"].chunks, *table["dst"].chunks]))
    names = names.take(pc.sort_indices(names))
    u, v = (pc.index_in(table[c], value_set=names).to_numpy().astype(np.int64) for c in ("src", "dst"))
    n, row = len(names), {}
    for way, key in (("out", u * n + v), ("into", v * n + u)):
        key.sort()
        row[way] = key
    same, paths = bool(np.array_equal(row["out"], row["into"])), int(np.bincount(u, minlength=n) @ np.bincount(v, minlength=n))
    parts = {way: [x.tobytes() for x in (_starts(key // n, n), (key % n).astype(np.int32))] for way, key in row.items()}
    if same:  # every step goes both ways
        parts["into"] = [b"", b""]
    return pa.table({"names": pa.ListArray.from_arrays([0, n], names), "shares": pa.array([1 + paths // LISTED], "int32"), **{f"{way}_{what}": pa.array([x], "binary") for way, both in parts.items() for what, x in zip(("start", "ends"), both)}})


def _of_middle(b: int, out: tuple[np.ndarray, np.ndarray], into: tuple[np.ndarray, np.ndarray], place: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places x < y so that a path of two steps leads over ``b`` between them, and none over a smaller one of the three: so each set comes up once.
    ``place`` is -1 everywhere, before and after."""
    of = lambda steps, i: steps[1][steps[0][i] : steps[0][i + 1]]
    near = of(out, b) if into is out else np.union1d(of(out, b), of(into, b))
    d = len(near)
    place[near] = np.arange(d)
    to, back = (np.ones(d, bool) if into is out else np.isin(near, of(steps, b), assume_unique=True) for steps in (out, into))

    def joined(steps: tuple[np.ndarray, np.ndarray], xs: np.ndarray) -> np.ndarray:
        first, many = steps[0][xs], steps[0][xs + 1] - steps[0][xs]
        at = np.repeat(first - np.cumsum(many) + many, many) + np.arange(many.sum())
        column, row = place[steps[1][at]], np.repeat(np.arange(len(xs)), many)
        found = np.zeros((len(xs), d), bool)
        found[row[column >= 0], column[column >= 0]] = True
        return found

    for low in range(0, d, max(1, CELLS // max(1, d))):
        xs = near[low : low + max(1, CELLS // d)]
        i = slice(low, low + len(xs))
        leads = joined(out, xs)  # from x to y
        led = leads if into is out else joined(into, xs)  # from y to x
        over_x = (to[i, None] & leads) | (back[i, None] & led)
        over_y = (to & led) | (back & leads)
        kept = (back[i, None] & to) | (to[i, None] & back)
        kept &= ~(over_x & (xs < b)[:, None]) & ~(over_y & (near < b))
        x, y = np.nonzero(kept & (np.arange(d) > np.arange(low, low + len(xs))[:, None]))
        yield xs[x], near[y]
    place[near] = -1


def _listed(names: pa.Array, share: int, shares: int, out: tuple[np.ndarray, np.ndarray], into: tuple[np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The sets of every ``shares``-th node, as the end of one step or the middle of two."""

    def batches(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        rows = np.concatenate(parts)
        for at in range(0, len(rows), BATCH):
            some = rows[at : at + BATCH]
            ends = np.arange(len(some) + 1, dtype=np.int32) * rows.shape[1]
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, names.take(pa.array(some.ravel())))], ["cluster"])

    place, twos, threes, held = np.full(len(names), -1, np.int32), [], [], 0
    for b in range(share, len(names), shares):
        ends = np.concatenate([steps[1][steps[0][b] : steps[0][b + 1]] for steps in (out, into)])
        later = np.unique(ends[ends > b])
        twos.append(np.stack([np.full(len(later), b, np.int32), later], 1))
        for x, y in _of_middle(b, out, into, place):
            low, high = np.minimum(x, b), np.maximum(y, b)
            threes.append(np.stack([low, x + y + b - low - high, high], 1).astype(np.int32))
            held += len(x)
            if held >= BATCH:
                yield from batches(threes)
                threes, held = [], 0
    for parts in (twos, threes):
        if parts:
            yield from batches(parts)


def sets_of_two_steps(steps: DataFrame, groups: DataFrame) -> DataFrame:
    """``cluster`` (sorted ids): the different node sets of paths of 1 or 2 of the ``steps`` (src, dst), each within one of ``groups`` (id, community).

    The communities' steps are packed, each into a row, and go to as many tasks as their paths ask for. A task lists the paths over its own
    nodes, and leaves out the sets that a path over a smaller node has too, so the sets need not meet to be told apart."""
    kind = steps.schema["src"].dataType.simpleString()
    steps = written(steps.join(groups.select(F.col("id").alias("src"), "community"), "src"), "steps")
    size = written(steps.groupBy("community").agg(F.count("*").alias("n")), "sizes")
    bins = max(1, steps.count() // PACKED)
    key = F.when(F.col("n") > PACKED, F.xxhash64("community")).otherwise(F.pmod(F.xxhash64("community"), F.lit(bins)))
    fit = size.where(F.col("n") <= 2 * SMALL).select("community", key.alias("key"))
    ways = [f"{way}_{what}" for way in ("out", "into") for what in ("start", "ends")]
    packs = steps.join(fit, "community").groupBy("key").applyInArrow(lambda _, table: _packed(table.select(["src", "dst"])), f"names array<{kind}>, shares int, " + ", ".join(f"{w} binary" for w in ways))
    packs = written(packs, "packs")
    tasks = max(1, packs.agg(F.sum("shares")).first()[0] or 0)
    dealt = packs.withColumn("pack", F.monotonically_increasing_id()).withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    dealt = dealt.repartition(min(tasks, 20_000), "pack", "share")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                at = lambda name: batch.column(name)[i]  # noqa: B023, E731
                out, into = ((np.frombuffer(at(f"{w}_start").as_buffer(), np.int64), np.frombuffer(at(f"{w}_ends").as_buffer(), np.int32)) for w in ("out", "into"))
                yield from _listed(at("names").values, at("share").as_py(), at("shares").as_py(), out, into if len(into[0]) else out)

    found = dealt.select("names", "share", "shares", *ways).mapInArrow(run, f"cluster array<{kind}>")
    large = size.where(F.col("n") > 2 * SMALL)
    if large.isEmpty():
        return found
    paths = simple_paths(steps.join(large, "community", "left_semi").withColumn("bidirectional", F.lit(False)), 2)
    return found.union(paths.select(F.array_sort("path").alias("cluster")).distinct())


def _first_of_each(df: DataFrame, by: str, order: Column, n: int, parts: int = 64) -> DataFrame:
    """``df`` with ``turn`` (from 0): the first ``n`` rows of each ``by``. Parts of a large group are ranked before their first rows meet."""
    parted = df.withColumn("_part", F.pmod(F.xxhash64(order), F.lit(parts)))
    parted = parted.withColumn("_turn", F.row_number().over(Window.partitionBy(by, "_part").orderBy(order))).where(F.col("_turn") <= n)
    return parted.withColumn("turn", F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1).where(F.col("turn") < n).drop("_part", "_turn")


def random_walks(steps: DataFrame, groups: DataFrame, depths: list[int], n: int = MOST_PATHS, seed: int = 42) -> DataFrame:
    """``path``: for each group of nodes (id, community) ``n`` walks of each depth along ``steps`` (src, dst) that stay in the group.

    A walk starts at one of the group's nodes, these taken in turn in an order by hash, and goes on to a neighbour drawn by the hash of
    seed, walk and step: one join a step, whatever the number of paths. Nodes from which walks get stuck are left out first, as are
    groups that then have no more nodes than a depth has edges."""
    inside = steps.join(groups.select(F.col("id").alias("src"), "community"), "src").join(groups.select(F.col("id").alias("dst"), F.col("community").alias("_c")), "dst")
    alive = written(inside.where("community = _c").select("community", "src", "dst"), "steps")
    while True:  # a dead end may leave another one behind
        sources = alive.select(F.col("src").alias("_id")).distinct()
        fewer = written(alive.join(sources, F.col("dst") == F.col("_id"), "left_semi"), "steps")
        if fewer.count() == alive.count():
            break
        alive = fewer
    nodes = alive.groupBy("community", "src").agg(F.count("*").alias("degree"))
    order = F.xxhash64(F.lit(seed), F.col("src"))
    count = nodes.groupBy("community").agg(F.count("*").alias("nodes"))
    starts = written(_first_of_each(nodes.withColumn("_order", order), "community", F.struct("_order", "src"), n).join(count, "community"), "starts")
    walk = F.explode(F.sequence(F.col("turn"), F.lit(n - 1), F.least(F.col("nodes"), F.lit(n)).cast("int"))).alias("walk")
    depth = F.explode(F.array(*map(F.lit, depths))).alias("depth")
    walks = starts.select("community", "src", "degree", "nodes", walk).select("*", depth).where("nodes > depth")
    numbered = alive.withColumn("at", F.row_number().over(Window.partitionBy("src").orderBy("dst")) - 1).select("src", "at", F.col("dst").alias("to"))
    ends = nodes.select(F.col("src").alias("to"), F.col("degree").alias("next"))
    numbered = written(numbered.join(ends, "to"), "numbered")
    level = walks.select("community", "walk", "depth", "degree", F.array("src").alias("path"), "src")
    found = None
    for step in range(max(depths)):
        drawn = F.pmod(F.xxhash64(F.lit(seed), "community", "walk", "depth", F.lit(step)), F.col("degree")).cast("int")
        onward = level.withColumn("at", drawn).join(numbered, ["src", "at"])
        level = onward.select("community", "walk", "depth", F.col("next").alias("degree"), F.concat("path", F.array("to")).alias("path"), F.col("to").alias("src"))
        level = written(level, "walks")
        done = level.where(F.col("depth") == step + 1).select("path")
        found = done if found is None else found.union(done)
        level = level.where(F.col("depth") > step + 1)
    return found


def indirect_clusters(graph: Graph, depth: int = 3, predicate: Column | None = None, most_paths: int | None = MOST_PATHS, seed: int = 42) -> DataFrame:
    """``cluster`` (sorted ids): the different node sets of paths of 1 to ``depth`` edges within communities (Leiden).

    A community whose nodes, if all were joined, had fewer than ``most_paths`` paths of ``depth`` edges is listed whole, as are all where
    ``most_paths`` is None. Of each other one, ``most_paths`` random walks of 2 edges, and of each number up to ``depth``, are taken."""
    if depth < 2:
        raise ValueError("the depth must be 2 or more")
    edges = graph.edges if predicate is None else graph.edges.where(predicate)
    edges = written(edges.select("src", "dst", "bidirectional"), "edges")
    label = written(leiden(edges), "communities")
    if most_paths is None:
        whole, large = label, None
    else:
        size = label.groupBy("community").agg(F.count("*").cast("double").alias("n"))
        bound = F.when(F.col("n") - depth - 1 <= 0, 0.0).otherwise(prod((F.col("n") - i for i in range(depth + 1)), start=F.lit(1.0)))
        whole = label.join(size.where(bound < most_paths), "community", "left_semi")
        large = written(label.join(size.where(bound >= most_paths), "community", "left_semi"), "large")
    ends = [whole.select(F.col("id").alias(e), F.col("community").alias(f"c_{e}")) for e in ("src", "dst")]
    inside = edges.join(ends[0], "src").join(ends[1], "dst").where("c_src = c_dst").select("src", "dst", "bidirectional")
    as_sets = lambda paths: paths.select(F.array_sort(F.array_distinct("path")).alias("cluster")).where("size(cluster) > 1").distinct()
    walks = random_walks(neighbours(edges), large, list(range(2, depth + 1)), most_paths, seed) if large is not None and not large.isEmpty() else None
    if depth == 2:
        found = sets_of_two_steps(neighbours(inside), whole)
        return found if walks is None else found.union(as_sets(walks))
    found = simple_paths(inside, depth).select("path")
    return as_sets(found if walks is None else found.union(walks))


def maximal_sets(sets: DataFrame, column: str = "cluster") -> DataFrame:
    """The different sets (arrays without repeats) of a column that lie within no other: a set within another holds its own rarest element there, so
    sets meet at their rarest elements only. Empty sets stay only where there is no other; nulls go."""
    different = written(sets.where(F.col(column).isNotNull()).select(F.array_sort(F.array_distinct(column)).alias("s")).distinct(), "sets")
    held = different.select("s", F.explode("s").alias("e"))
    often = held.groupBy("e").agg(F.count("*").alias("n"))
    ranked = written(held.join(often, "e"), "held")
    rarest = ranked.groupBy("s").agg(F.min_by("e", F.struct("n", "e")).alias("e"))
    around = ranked.select(F.col("s").alias("t"), "e")
    within = rarest.join(around, "e").where((F.size("t") > F.size("s")) & (F.size(F.array_except("s", "t")) == 0)).select("s").distinct()
    empty = F.size("s") == 0
    kept = different.where(~empty).join(within, "s", "left_anti")
    if kept.isEmpty():
        kept = different
    return kept.select(F.col("s").alias(column))


def n_indirect_clusters(graph: Graph, n: int, depth: int = 3, predicate: Column | None = None, seed: int = 42) -> DataFrame:
    """``cluster`` (sorted ids): up to ``n`` node sets of paths that go on until they have ``depth`` nodes or find no new neighbour; none lies within
    another. Start nodes are drawn by hash, as many as ``n`` sets can need; of each start as many paths a level are followed, in
    an order by hash; the sets are dealt round robin over the starts. Raises if no edge is left."""
    if depth < 2 or n < 1:
        raise ValueError("the depth must be 2 or more, and n 1 or more")
    edges = graph.edges if predicate is None else graph.edges.where(predicate)
    steps = written(neighbours(edges), "steps")
    pairs = steps.select(F.least("src", "dst"), F.greatest("src", "dst")).distinct().count()
    if not pairs:
        raise ValueError("no edge fits: there is nothing to make clusters of")
    joined = steps.select("src").union(steps.select("dst")).distinct().count()
    most = (n - 1) * depth + 1 if pairs < joined else max(n, depth, 10)
    by_hash = lambda c: F.xxhash64(F.lit(seed), c)
    starts = steps.select("src").distinct().orderBy(by_hash(F.col("src")), "src").limit(most)
    level = written(starts.select(F.col("src").alias("root"), F.array("src").alias("path")), "starts")
    found = None
    for size in range(2, depth + 1):
        grown = level.join(steps, F.element_at("path", -1) == F.col("src")).where(~F.array_contains("path", F.col("dst")))
        grown = grown.select("root", "path", F.concat("path", F.array("dst")).alias("next"))
        stuck = level.where("size(path) > 1").join(grown.select("root", "path").distinct(), ["root", "path"], "left_anti")
        found = stuck if found is None else found.unionByName(stuck)
        grown = grown.select("root", F.col("next").alias("path")).withColumn("_order", by_hash(F.array_join(F.col("path").cast("array<string>"), ",")))
        level = written(_first_of_each(grown, "root", F.struct("_order", "path"), most + 1).select("root", "path"), f"paths{size}")
    sets = written(found.unionByName(level).select("root", F.array_sort("path").alias("cluster")).groupBy("cluster").agg(F.min("root").alias("root")), "sets")
    kept = sets.join(maximal_sets(sets), "cluster")
    dealt = _first_of_each(kept.withColumn("_order", by_hash(F.array_join(F.col("cluster").cast("array<string>"), ","))), "root", F.struct("_order", "cluster"), n)
    return dealt.orderBy("turn", by_hash(F.col("root")), "root").limit(n).select("cluster")


def similarity_edges(pairs: DataFrame, kind: str, score: str = "similarity", bidirectional: bool = True) -> DataFrame:
    """Pairs (src, dst, score) as edges of a graph."""
    return pairs.select(F.concat_ws("-", F.lit(kind), "src", "dst").alias("id"), F.lit(kind).alias("type"), F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), F.lit(bidirectional).alias("bidirectional"), F.col(score).alias("score"))
