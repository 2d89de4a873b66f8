"""Communities of a graph by the Leiden method, in rounds over tables of edges, nodes and labels.

Each level moves nodes to the neighbouring community of the largest gain in modularity, refines each community into parts that are connected
and well knit, and makes the parts the nodes of the next level, which starts from the communities. In a round only a part of the
nodes move, chosen by hash, so that two never swap places; a round that lowers the modularity is taken back and tried with fewer
nodes. Every round is a few joins and groupings by node or community; what comes to the driver is a count and a sum.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import forget, written

#: One node in so many moves in a round; the next figure counts once a round has not raised the modularity.
SHARES = (2, 8, 32)
#: Rounds of refinement: with each, about half of the nodes that still stand alone may join others.
REFINEMENTS = 4
GAIN = 1e-9
#: Edges of a component that a task takes whole, or of what the rounds have left of a larger one: about 400 MB.
SMALL = 5_000_000
#: Edges of the components that go to a task together, about.
TOGETHER = 20_000


@dataclass(frozen=True)
class Level:
    """``edges``: u, v, w, both ways and without loops; ``nodes``: id, k (its degree) and loop (the weight inside it), k and loop of both ways."""

    edges: DataFrame
    nodes: DataFrame
    twice: float  # the degrees' sum


def first_level(edges: DataFrame) -> Level:
    """Of edges (src, dst): each pair of different nodes once, however often and in whatever direction it is there."""
    pairs = edges.select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).where("u < v").distinct()
    both = written(pairs.union(pairs.select("v", "u")).withColumn("w", F.lit(1.0)), "edges")
    nodes = written(both.groupBy(F.col("u").alias("id")).agg(F.sum("w").alias("k"), F.lit(0.0).alias("loop")), "nodes")
    return Level(both, nodes, float(nodes.agg(F.sum("k")).first()[0] or 0))


def _turn(column: str, number: int, share: int) -> Column:
    """Whether it is a node's turn in a round."""
    return F.pmod(F.xxhash64(F.lit(number), F.col(column)), F.lit(share)) == 0


def _scored(level: Level, labels: DataFrame) -> DataFrame:
    """Of each node: its label ``c``, its weight to its own community, what staying is worth, and the best community and its worth."""
    totals = labels.join(level.nodes, "id").groupBy("c").agg(F.sum("k").alias("s"))
    there = level.edges.join(labels.select(F.col("id").alias("v"), "c"), "v").groupBy("u", "c").agg(F.sum("w").alias("inside"))
    own = labels.select(F.col("id").alias("u"), "c", F.lit(0.0).alias("inside"))  # for a node without neighbours in its community
    offers = there.unionByName(own).groupBy("u", "c").agg(F.sum("inside").alias("inside")).join(totals, "c")
    held = labels.join(level.nodes, "id").select(F.col("id").alias("u"), F.col("c").alias("own"), "k", "loop")
    here = F.col("c") == F.col("own")
    worth = F.col("inside") - F.col("k") * (F.col("s") - F.when(here, F.col("k")).otherwise(0.0)) / level.twice
    offers = offers.join(held, "u").select("u", "own", "k", "loop", "c", here.alias("here"), "inside", worth.alias("worth"))
    best = F.max_by("c", F.struct("worth", F.col("here").alias("stays")))
    picked = offers.groupBy("u", "own", "k", "loop").agg(
        best.alias("best"), F.max("worth").alias("worth"), F.max(F.when(F.col("here"), F.col("worth"))).alias("stay"), F.max(F.when(F.col("here"), F.col("inside"))).alias("inside")
    )
    return picked


def _modularity(level: Level, scored: DataFrame) -> tuple[float, int]:
    """The modularity, and how many nodes would gain by moving."""
    willing = F.count(F.when(F.col("worth") > F.col("stay") + GAIN, 1)).alias("willing")
    parts = scored.groupBy("own").agg(F.sum(F.col("inside") + F.col("loop")).alias("inside"), F.sum("k").alias("s"), willing)
    value = F.sum(F.col("inside") / level.twice - (F.col("s") / level.twice) ** 2)
    return tuple(parts.agg(value, F.sum("willing")).first())


def modularity(edges: DataFrame, labels: DataFrame) -> float:
    """Of communities (id, community) of all nodes that have an edge (src, dst); 0 for a graph without edges."""
    level = first_level(edges)
    return _modularity(level, _scored(level, labels.select("id", F.col("community").alias("c"))))[0] if level.twice else 0.0


def _moved(level: Level, labels: DataFrame) -> DataFrame:
    """Labels after moves that each raise the modularity, until no node gains by moving."""
    kept = written(_scored(level, labels), "scored")
    (value, willing), number, tries = _modularity(level, kept), 0, iter(SHARES)
    share = next(tries)
    while willing and share:
        number += 1
        goes = (F.col("worth") > F.col("stay") + GAIN) & _turn("u", number, share)
        tried = kept.select(F.col("u").alias("id"), F.when(goes, F.col("best")).otherwise(F.col("own")).alias("c"))
        scored = written(_scored(level, tried), "scored")
        now, more = _modularity(level, scored)
        if now > value + GAIN:
            forget(kept)
            kept, value, willing = scored, now, more
        else:  # too many at once, or by chance none of the willing ones
            forget(scored)
            share = next(tries, 0)
    return kept.select(F.col("u").alias("id"), F.col("own").alias("c"))


def _refined(level: Level, labels: DataFrame) -> DataFrame:
    """``id``, ``c`` and ``part``: the communities' parts. A node that stands alone may join a part that stays; parts never lose a node,
    so each is connected. Only nodes and parts that are well knit into their community take part."""
    named = labels.select(F.col("id").alias("v"), F.col("c").alias("c_v"))
    inside = level.edges.join(labels.select(F.col("id").alias("u"), "c"), "u").join(named, "v").where(F.col("c") == F.col("c_v"))
    inside = written(inside.select("u", "v", "w"), "inside")
    degrees = labels.join(level.nodes, "id")
    totals = degrees.groupBy("c").agg(F.sum("k").alias("all"))
    knit = inside.groupBy(F.col("u").alias("id")).agg(F.sum("w").alias("to_all"))
    nodes = degrees.join(totals, "c").join(knit, "id", "left").withColumn("to_all", F.coalesce("to_all", F.lit(0.0)))
    well = F.col("to_all") >= F.col("k") * (F.col("all") - F.col("k")) / level.twice
    nodes = written(nodes.select("id", "c", "k", "all", well.alias("well")), "nodes")
    parts = written(nodes.select("id", F.col("id").alias("part")), "parts")
    for number in range(REFINEMENTS):
        held = nodes.join(parts, "id")
        sums = held.groupBy("part").agg(F.sum("k").alias("k_part"), F.count("*").alias("size"), F.first("all").alias("all"))
        near = inside.join(parts.select(F.col("id").alias("v"), "part"), "v").groupBy("u", "part").agg(F.sum("w").alias("w"))
        own = parts.select(F.col("id").alias("u"), F.col("part").alias("own"))
        near = near.join(own, "u").where(F.col("own") != F.col("part"))
        out = near.groupBy(F.col("own").alias("part")).agg(F.sum("w").alias("out"))
        sums = sums.join(out, "part", "left").withColumn("knit", F.coalesce("out", F.lit(0.0)) >= F.col("k_part") * (F.col("all") - F.col("k_part")) / level.twice)
        alone = sums.where("size = 1").select(F.col("part").alias("id"))
        movers = written(nodes.where("well").join(alone, "id", "left_semi").where(_turn("id", number, 2)).select(F.col("id").alias("u"), "k"), "movers")
        offers = near.join(movers, "u").join(sums.where("knit").select("part", "k_part"), "part")
        offers = offers.join(movers.select(F.col("u").alias("part")), "part", "left_anti")  # a part that moves itself
        gain = F.col("w") - F.col("k") * F.col("k_part") / level.twice
        joined = offers.withColumn("gain", gain).where(F.col("gain") > 0).groupBy("u").agg(F.min_by("part", F.struct(-F.col("gain"), F.col("part"))).alias("to"))
        before = parts
        parts = written(parts.join(joined.select(F.col("u").alias("id"), "to"), "id", "left").select("id", F.coalesce("to", "part").alias("part")), "parts")
        forget(before, movers)
    return nodes.join(parts, "id").select("id", "c", "part")


def _next_level(level: Level, parts: DataFrame) -> Level:
    """The parts as nodes."""
    u = parts.select(F.col("id").alias("u"), F.col("part").alias("pu"))
    v = parts.select(F.col("id").alias("v"), F.col("part").alias("pv"))
    merged = written(level.edges.join(u, "u").join(v, "v").groupBy("pu", "pv").agg(F.sum("w").alias("w")), "merged")
    loops = merged.where("pu = pv").select(F.col("pu").alias("id"), F.col("w").alias("more"))
    sums = level.nodes.join(parts, "id").groupBy(F.col("part").alias("id")).agg(F.sum("k").alias("k"), F.sum("loop").alias("loop"))
    nodes = written(sums.join(loops, "id", "left").select("id", "k", (F.col("loop") + F.coalesce("more", F.lit(0.0))).alias("loop")), "nodes")
    return Level(merged.where("pu <> pv").select(F.col("pu").alias("u"), F.col("pv").alias("v"), "w"), nodes, level.twice)


def connected(pairs: DataFrame) -> DataFrame:
    """``id`` and ``least``: of each node of ``pairs`` (u, v; both ways) the least id that it reaches. A round takes the least label around and then
    that label's own, so long chains shorten fast."""
    held = written(pairs.select(F.col("u").alias("id")).distinct().withColumn("least", F.col("id")), "least")
    while True:
        labels = held.select("id", "least")
        told = pairs.join(labels.select(F.col("id").alias("v"), "least"), "v").select(F.col("u").alias("id"), "least").unionByName(labels)
        lower = told.groupBy("id").agg(F.min("least").alias("low"))
        jump = labels.select(F.col("id").alias("low"), F.col("least").alias("further"))
        after = lower.join(jump, "low").select("id", F.least("low", "further").alias("least"))
        both = written(after.join(labels.withColumnRenamed("least", "was"), "id").select("id", "least", (F.col("least") < F.col("was")).alias("fell")), "least")
        done = both.where("fell").isEmpty()
        forget(held)
        held = both
        if done:
            return held.select("id", "least")


@dataclass(frozen=True)
class Near:
    """The neighbours of nodes by their places: those of place i are ``ends[start[i]:start[i + 1]]``, both ways and without loops. All weights are 1
    where there is no ``weights``. Twelve bytes an edge and direction at most, where dictionaries take a hundred."""

    start: np.ndarray
    ends: np.ndarray
    weights: np.ndarray | None

    def of(self, i: int) -> tuple[list[int], Iterable[float]]:
        a, b = self.start[i], self.start[i + 1]
        return self.ends[a:b].tolist(), repeat(1.0) if self.weights is None else self.weights[a:b].tolist()

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.start) - 1, dtype=np.int32), np.diff(self.start))

    def summed(self, to: np.ndarray, n: int) -> Near:
        """The places merged as ``to`` says, into ``n``."""
        key = to[self.rows()].astype(np.int64) * n + to[self.ends]
        if self.weights is None:
            key, w = np.unique(key, return_counts=True)
        else:
            order = np.argsort(key, kind="stable")
            key = key[order]
            first = np.flatnonzero(np.diff(key, prepend=-1))
            key, w = key[first], np.add.reduceat(self.weights[order], first) if len(first) else self.weights
        apart = key // n != key % n
        return _near_of_keys(key[apart], n, w[apart].astype(float))


def _near_of_keys(key: np.ndarray, n: int, weights: np.ndarray | None = None) -> Near:
    """Of sorted keys, place * n + place."""
    start = np.searchsorted(key, np.arange(n + 1, dtype=np.int64) * n)
    return Near(start, (key % n).astype(np.int32), weights)


def _near(u: np.ndarray, v: np.ndarray, names: np.ndarray, w: np.ndarray | None = None) -> Near:
    """Of edges, each there once, between the sorted ``names``."""
    n = len(names)
    u, v = (np.searchsorted(names, x) for x in (u, v))
    key = np.concatenate([u * n + v, v * n + u])
    del u, v
    if w is None:
        key.sort()
        return _near_of_keys(key, n)
    order = np.argsort(key, kind="stable")
    return _near_of_keys(key[order], n, np.concatenate([w, w])[order])


def _local_moves(near: Near, k: list[float], c: list[int], twice: float) -> None:
    """Nodes move one by one to the best community around, until none gains; who has a neighbour that left is asked again."""
    total = np.bincount(c, k, len(c)).tolist()
    todo, queued = list(range(len(c))), bytearray(b"\1" * len(c))
    for i in todo:
        queued[i] = 0
        ends, weights = near.of(i)
        own, mine = c[i], k[i]
        inside = {own: 0.0}
        for j, w in zip(ends, weights):
            x = c[j]
            inside[x] = inside.get(x, 0.0) + w
        share = mine / twice
        stay = inside.pop(own) - share * (total[own] - mine)
        best, most = own, stay + GAIN
        for x, w in inside.items():
            worth = w - share * total[x]
            if worth > most or (worth == most and x < best != own):
                best, most = x, worth
        if best != own:
            total[own] -= mine
            total[best] += mine
            c[i] = best
            for j in ends:
                if c[j] != best and not queued[j]:
                    queued[j] = 1
                    todo.append(j)


def _local_parts(near: Near, k: list[float], c: list[int], twice: float) -> list[int]:
    """The communities' parts: nodes that still stand alone join the best well-knit part of their community around them."""
    part, size, all_k = list(range(len(c))), [1] * len(c), np.bincount(c, k, len(c)).tolist()
    rows, label = near.rows(), np.asarray(c)
    within = label[rows] == label[near.ends]
    out = np.bincount(rows[within], None if near.weights is None else near.weights[within], len(c)).astype(float).tolist()
    del rows, within
    part_k = list(k)
    for i, x in enumerate(c):
        if size[part[i]] > 1 or out[i] < k[i] * (all_k[x] - k[i]) / twice:
            continue
        inside: dict[int, float] = {}
        for j, w in zip(*near.of(i)):
            if c[j] == x and (p := part[j]) != part[i]:
                inside[p] = inside.get(p, 0.0) + w
        best, most = -1, 0.0
        for p, w in inside.items():
            if out[p] >= part_k[p] * (all_k[x] - part_k[p]) / twice:
                gain = w - k[i] * part_k[p] / twice
                if gain > most or (gain == most and p < best):
                    best, most = p, gain
        if best >= 0:
            out[best] += out[i] - 2 * inside[best]
            size[best] += size[part[i]]
            size[part[i]] = 0
            part_k[best] += k[i]
            part[i] = best
    return part


def _local_levels(near: Near, k: list[float], c: list[int], twice: float) -> np.ndarray:
    """The community of each node, from the communities ``c`` on."""
    node = np.arange(len(c))
    while True:
        _local_moves(near, k, c, twice)
        names, to = np.unique(_local_parts(near, k, c, twice), return_inverse=True)
        if len(names) == len(c):
            return np.asarray(c)[node]
        node = to[node]
        k = np.bincount(to, k, len(names)).tolist()
        first: dict[int, int] = {}
        c = [first.setdefault(c[x], i) for i, x in enumerate(names.tolist())]  # a community is named by its first part
        near = near.summed(to.astype(np.int32), len(names))


def _parted(near: Near, c: np.ndarray) -> np.ndarray:
    """For each node the first one of its community that it reaches within it."""
    label, first = c.tolist(), [-1] * len(c)
    for i in range(len(first)):
        todo = [i] if first[i] < 0 else []
        for x in todo:
            if first[x] < 0:
                first[x] = i
                todo += [j for j in near.of(x)[0] if first[j] < 0 and label[j] == label[x]]
    return np.asarray(first, int)


def local_leiden(u: np.ndarray, v: np.ndarray, twice: float) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges (u, v; whole numbers, each pair once) and their communities, by the least node; ``twice`` is the degrees' sum of the whole graph."""
    names = np.union1d(u, v)
    near = _near(u, v, names)
    c = _local_levels(near, np.diff(near.start).astype(float).tolist(), list(range(len(names))), twice)
    return names, names[_parted(near, c)]


def _in_tasks(edges: DataFrame, twice: float) -> DataFrame:
    """``id`` and ``c``: the connected communities of whole components, packed into tasks by hash; ``c`` is the least id in it."""
    pairs = edges.where("u < v")
    bins = max(1, pairs.count() // TOGETHER)

    def run(table: pa.Table) -> pa.Table:
        names, c = local_leiden(table["u"].to_numpy(), table["v"].to_numpy(), twice)
        return pa.table({"id": names, "c": c})

    return pairs.select("u", "v", F.pmod(F.xxhash64("component"), F.lit(bins)).alias("bin")).groupBy("bin").applyInArrow(run, "id long, c long")


def _rest_in_task(level: Level, labels: DataFrame) -> DataFrame:
    """``id`` and ``c``: the communities of a level of few edges, from its labels on, by one task."""
    nodes = level.nodes.join(labels, "id").select(F.col("id").alias("u"), F.col("c").alias("v"), F.col("k").alias("w"), F.lit(True).alias("node"))
    rows = nodes.unionByName(level.edges.where("u < v").select("u", "v", "w", F.lit(False).alias("node"))).withColumn("all", F.lit(0))
    twice = level.twice

    def run(table: pa.Table) -> pa.Table:
        u, v, w, node = (table[x].to_numpy() for x in ("u", "v", "w", "node"))
        order = np.argsort(u[node])
        names, named, k = (x[node][order] for x in (u, v, w))
        near = _near(u[~node], v[~node], names, w[~node])
        first: dict[int, int] = {}
        c = [first.setdefault(x, i) for i, x in enumerate(named.tolist())]
        return pa.table({"id": names, "c": names[_parted(near, _local_levels(near, k.tolist(), c, twice))]})

    return rows.groupBy("all").applyInArrow(run, "id long, c long")


def _in_rounds(level: Level, small: int) -> DataFrame:
    """``id`` and ``c``: the communities of the level's nodes; a level of at most ``small`` edges is left to a task."""
    members = level.nodes.select("id", F.col("id").alias("node"))
    labels = level.nodes.select("id", F.col("id").alias("c"))
    while True:
        if level.edges.count() <= 2 * small:
            labels = _rest_in_task(level, labels)
            return members.join(labels.select(F.col("id").alias("node"), "c"), "node").select("id", "c")
        labels = _moved(level, labels)
        parts = written(_refined(level, labels), "refined")
        count, fewer = parts.agg(F.count("*"), F.countDistinct("part")).first()
        if fewer == count:
            return members.join(labels.select(F.col("id").alias("node"), "c"), "node").select("id", "c")
        members = written(members.join(parts.select(F.col("id").alias("node"), "part"), "node").select("id", F.col("part").alias("node")), "members")
        level = _next_level(level, parts)
        labels = written(parts.groupBy(F.col("part").alias("id")).agg(F.first("c").alias("c")), "labels")


def _numbered(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The ends of edges (src, dst) with their numbers (id, number) in the ids' order, from 0, and the edges between the numbers."""
    ends = edges.where("src <> dst").select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    placed = written(ends.orderBy("id").withColumn("at", F.monotonically_increasing_id()), "ids")
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    sizes = sorted(tuple(r) for r in placed.groupBy(part.alias("part")).agg(F.count("*")).collect())
    before = [(p, sum(n for _, n in sizes[:i])) for i, (p, _) in enumerate(sizes)]
    starts = edges.sparkSession.createDataFrame(before, "part long, start long")
    ids = written(placed.join(F.broadcast(starts), part == F.col("part")).select("id", (F.col("start") + place).alias("number")), "ids")
    u, v = (ids.select(F.col("id").alias(x), F.col("number").alias(y)) for x, y in (("src", "u"), ("dst", "v")))
    return ids, edges.select("src", "dst").join(u, "src").join(v, "dst").select(F.col("u").alias("src"), F.col("v").alias("dst"))


def leiden(edges: DataFrame, small: int = SMALL) -> DataFrame:
    """``id`` and ``community`` (the least id in it) of every node with an edge (src, dst) to another one; edges count without direction.

    Communities are connected. The result is the same for the same edges; null ends, loops and repeated edges add nothing, and an
    empty table gives an empty one. Components of at most ``small`` edges are dealt with in tasks, larger ones in rounds over tables until what
    is left of them has no more."""
    ids, edges = _numbered(edges)
    whole = first_level(edges)
    component = connected(whole.edges).select(F.col("id").alias("u"), F.col("least").alias("component"))
    placed = written(whole.edges.join(component, "u"), "placed")
    large = placed.groupBy("component").agg((F.count("*") / 2).alias("n")).where(F.col("n") > small).select("component")
    large = written(large, "large")
    found = written(_in_tasks(placed.join(large, "component", "left_anti"), whole.twice), "found").select("id", F.col("c").alias("community"))
    named = lambda df: df.join(ids.select(F.col("number").alias("id"), F.col("id").alias("name")), "id").join(ids.select(F.col("number").alias("community"), F.col("id").alias("least")), "community").select(F.col("name").alias("id"), F.col("least").alias("community"))
    if large.isEmpty():
        return named(found)
    part = written(placed.join(large, "component", "left_semi").select("u", "v", "w"), "edges")
    nodes = whole.nodes.join(part.select(F.col("u").alias("id")), "id", "left_semi")
    label = written(_in_rounds(Level(part, written(nodes, "nodes"), whole.twice), small), "found")
    u = label.select(F.col("id").alias("u"), F.col("c").alias("cu"))
    v = label.select(F.col("id").alias("v"), F.col("c").alias("cv"))
    inside = written(part.join(u, "u").join(v, "v").where("cu = cv").select("u", "v"), "inside")
    least = connected(inside)
    return named(found.unionByName(label.join(least, "id", "left").select("id", F.coalesce("least", "id").alias("community"))))
