"""Communities, walks and clusters of graphs against plain Python."""

import itertools
import random
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gaugewright.operators import communities, graph


def ring_of_cliques(cliques, size):
    inside = [(10 * c + i, 10 * c + j) for c in range(cliques) for i in range(size) for j in range(i)]
    return inside + [(10 * c, 10 * ((c + 1) % cliques) + 1) for c in range(cliques)]


def planted(seed, groups=5, size=12, inside=0.45, outside=0.03):
    rng = random.Random(seed)
    n = groups * size
    return [(a, b) for a in range(n) for b in range(a) if rng.random() < (inside if a // size == b // size else outside)]


def with_hubs(seed):
    """Stars, chains and a pair apart."""
    rng = random.Random(seed)
    stars = [(1000 + 100 * s, 1000 + 100 * s + i) for s in range(4) for i in range(1, 9)]
    return stars + [(1001, 1101), (1201, 1302)] + [(i, i + 1) for i in range(12)] + [(2000, 2001)] + [(rng.randrange(12), rng.randrange(12)) for _ in range(6)]


def modularity(edges, label):
    pairs = {frozenset(e) for e in edges if e[0] != e[1]}
    inside, total = Counter(), Counter()
    for a, b in map(tuple, pairs):
        total[label[a]] += 1
        total[label[b]] += 1
        inside[label[a]] += label[a] == label[b]
    return sum(inside[c] / len(pairs) - (total[c] / (2 * len(pairs))) ** 2 for c in total)


def plain_leiden(edges, seed):
    """Nodes move in a random order while the modularity rises; communities are split where they are not connected, and become nodes."""
    rng = random.Random(seed)
    pairs = {frozenset(e) for e in edges if e[0] != e[1]}
    m2 = 2 * len(pairs)
    weight = Counter()
    for a, b in map(tuple, pairs):
        weight[a, b] += 1
        weight[b, a] += 1
    names = sorted({x for p in pairs for x in p})
    group = {x: x for x in names}
    nodes = names
    while True:
        near, k = defaultdict(Counter), Counter()
        for (a, b), w in weight.items():
            k[a] += w
            if a != b:
                near[a][b] += w
        c = {x: x for x in nodes}
        total = Counter(k)
        moved = True
        while moved:
            moved = False
            for x in rng.sample(nodes, len(nodes)):
                to = Counter({c[x]: 0})
                for y, w in near[x].items():
                    to[c[y]] += w
                total[c[x]] -= k[x]
                best = max(to, key=lambda g: (to[g] - k[x] * total[g] / m2, g == c[x]))
                moved |= best != c[x]
                c[x] = best
                total[best] += k[x]
        if len(set(c.values())) == len(nodes):
            return group
        group = {x: c[g] for x, g in group.items()}
        folded = Counter()
        for (a, b), w in weight.items():
            folded[c[a], c[b]] += w
        weight, nodes = folded, sorted(set(c.values()))


def connected(nodes, edges):
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    reached, todo = set(), [next(iter(nodes))]
    while todo:
        x = todo.pop()
        if x not in reached:
            reached.add(x)
            todo += near[x] & nodes
    return reached == nodes


@pytest.mark.parametrize(("edges", "small"), [(ring_of_cliques(6, 5), 20_000), (planted(2), 20_000), (with_hubs(3), 20_000), (ring_of_cliques(3, 5) + [(500, 501)], 2)])
def test_leiden_against_plain_python(spark, edges, small):
    """In tasks, and in rounds over tables (where components are larger than ``small``)."""
    noisy = [*edges, *edges[:5], (7, 7), (None, 3)]
    df = spark.createDataFrame(noisy, "src long, dst long")
    got = {r["id"]: r["community"] for r in communities.leiden(df, small).collect()}
    assert set(got) == {x for e in edges if e[0] != e[1] for x in e}
    value = modularity(edges, got)
    best = max(modularity(edges, plain_leiden(edges, seed)) for seed in range(5))
    assert value >= 0.98 * best
    members = defaultdict(set)
    for x, c in got.items():
        members[c].add(x)
    assert all(c == min(xs) and connected(xs, edges) for c, xs in members.items())
    table = spark.createDataFrame(list(got.items()), "id long, community long")
    assert communities.modularity(df, table) == pytest.approx(value)
    if small > 2:
        again = communities.leiden(df.repartition(7), small).collect()
        assert {r["id"]: r["community"] for r in again} == got


def test_leiden_of_odd_graphs(spark):
    none = spark.createDataFrame([], "src string, dst string")
    assert communities.leiden(none).count() == 0 and communities.modularity(none, none.select(F.col("src").alias("id"), F.col("dst").alias("community"))) == 0
    loops = spark.createDataFrame([("a", "a"), ("b", "a"), ("a", "b"), (None, "a")], "src string, dst string")
    assert {tuple(r) for r in communities.leiden(loops).collect()} == {("a", "a"), ("b", "a")}


def test_connected(spark):
    rng = random.Random(1)
    pairs = [(i, i + 1) for i in range(40)] + [(rng.randrange(100, 140), rng.randrange(100, 140)) for _ in range(25)]
    both = spark.createDataFrame([p for a, b in pairs for p in ((a, b), (b, a)) if a != b], "u long, v long")
    got = {r["id"]: r["least"] for r in communities.connected(both).collect()}
    for x, least in got.items():
        group = {y for y, other in got.items() if other == least}
        assert least == min(group) and connected(group, pairs), x


def as_graph(spark, edges, bidirectional=True):
    ids = sorted({x for e in edges for x in e})
    nodes = spark.createDataFrame([(x, "chunk") for x in ids], "id long, type string")
    rows = [(str(i), "near", a, b, bidirectional) for i, (a, b) in enumerate(edges)]
    return graph.Graph(nodes, spark.createDataFrame(rows, "id string, type string, src long, dst long, bidirectional boolean"))


def plain_sets(edges, label, depth, bidirectional=True):
    near = defaultdict(set)
    for a, b in edges:
        if label[a] == label[b] and a != b:
            near[a].add(b)
            if bidirectional:
                near[b].add(a)
    found, level = set(), [(x,) for x in list(near)]
    for _ in range(depth):
        level = [(*p, y) for p in level for y in near[p[-1]] if y not in p]
        found |= {frozenset(p) for p in level}
    return found


@pytest.mark.parametrize("bidirectional", [True, False])
def test_indirect_clusters_against_plain_python(spark, bidirectional):
    edges = planted(5, groups=3, size=5, inside=0.7, outside=0.05) + [(900, 901), (901, 902)]
    g = as_graph(spark, edges, bidirectional)
    label = {r["id"]: r["community"] for r in communities.leiden(g.edges).collect()}
    want = plain_sets(edges, label, 3, bidirectional)
    got = graph.indirect_clusters(g, 3, most_paths=None).collect()
    assert {frozenset(r["cluster"]) for r in got} == want and len(got) == len(want)
    assert all(r["cluster"] == sorted(r["cluster"]) for r in got)
    # below the bound the same, without asking for it
    few = graph.indirect_clusters(g, 3).collect()
    size = Counter(label.values())
    if all(n * (n - 1) * (n - 2) * (n - 3) < 1000 or n < 5 for n in size.values()):
        assert {frozenset(r["cluster"]) for r in few} == want


def test_dense_communities_are_walked(spark):
    """A clique of 30 has 700 000 paths of 3 edges: 50 walks of 2 and of 3 edges are taken, all of them along edges."""
    clique = list(itertools.combinations(range(30), 2)) + [(100, 101), (101, 102), (100, 102)]
    g = as_graph(spark, clique)
    got = [frozenset(r["cluster"]) for r in graph.indirect_clusters(g, 3, most_paths=50).collect()]
    assert len(got) == len(set(got)) and {s for s in got if min(s) >= 100} == {frozenset(s) for k in (2, 3) for s in itertools.combinations((100, 101, 102), k)}
    walked = [s for s in got if max(s) < 30]
    assert 60 < len(walked) <= 100 and {len(s) for s in walked} <= {2, 3, 4}
    again = [frozenset(r["cluster"]) for r in graph.indirect_clusters(g, 3, most_paths=50).collect()]
    assert set(again) == set(got)
    other = [frozenset(r["cluster"]) for r in graph.indirect_clusters(g, 3, most_paths=50, seed=1).collect()]
    assert set(other) != set(got)


def test_random_walks(spark):
    """Each group gets the stated number of walks of each depth; starts are spread, steps are edges, and dead ends are left out."""
    edges = [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (10, 11), (11, 10)]  # 3 and 4 lead nowhere
    steps = spark.createDataFrame(edges, "src long, dst long")
    groups = spark.createDataFrame([(i, 0) for i in range(5)] + [(10, 1), (11, 1)], "id long, community long")
    paths = [tuple(r["path"]) for r in graph.random_walks(steps, groups, [2, 3], 30).collect()]
    assert all((a, b) in edges for p in paths for a, b in zip(p, p[1:]))
    assert Counter(len(p) for p in paths) == {3: 30}  # three nodes are too few for a walk of three edges, two for one of two
    assert Counter(p[0] for p in paths) == {0: 10, 1: 10, 2: 10}
    chain = spark.createDataFrame([(i, i + 1) for i in range(6)], "src long, dst long")
    assert graph.random_walks(chain, spark.createDataFrame([(i, 0) for i in range(7)], "id long, community long"), [2], 10).count() == 0


def test_maximal_sets_against_all_pairs(spark):
    rng = random.Random(2)
    sets = [rng.sample(range(12), rng.randint(1, 6)) for _ in range(150)] + [[3, 3, 5], []]
    df = spark.createDataFrame([(s,) for s in sets] + [(None,)], "cluster array<long>")
    different = {frozenset(s) for s in sets}
    want = {s for s in different if not any(s < t for t in different)}
    got = graph.maximal_sets(df).collect()
    assert {frozenset(r["cluster"]) for r in got} == want and len(got) == len(want)
    assert [r["cluster"] for r in graph.maximal_sets(df.where("size(cluster) = 0")).collect()] == [[]]
    assert graph.maximal_sets(df.limit(0)).count() == 0


@pytest.mark.parametrize(("n", "depth"), [(1, 2), (5, 3), (12, 4)])
def test_n_indirect_clusters(spark, n, depth):
    edges = planted(7, groups=3, size=6, inside=0.5, outside=0.08) + [(900, 901), (901, 902), (950, 951)]
    got = [frozenset(r["cluster"]) for r in graph.n_indirect_clusters(as_graph(spark, edges), n, depth).collect()]
    assert len(got) == n == len(set(got)) and all(2 <= len(s) <= depth and connected(s, edges) for s in got)
    assert not any(a < b for a in got for b in got)
    with pytest.raises(ValueError):
        graph.n_indirect_clusters(as_graph(spark, edges), n, depth, F.lit(False))
    with pytest.raises(ValueError):
        graph.n_indirect_clusters(as_graph(spark, edges), 0, depth)


def test_leiden_of_a_component_that_fits_takes_no_rounds(spark, monkeypatch):
    """More edges than 20 000 in one component: a task takes it, in place of some dozens of rounds over tables."""
    edges = [(100 * g + a, 100 * g + b) for g in range(21) for a in range(46) for b in range(a)] + [(100 * g, 100 * g + 101) for g in range(20)]
    assert len(edges) > 20_000
    monkeypatch.setattr(communities, "_in_rounds", lambda *_: pytest.fail("a component that fits went through rounds"))
    got = {r["id"]: r["community"] for r in communities.leiden(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {100 * g + a: 100 * g for g in range(21) for a in range(46)}


def test_levels_that_fit_are_left_to_a_task(spark, monkeypatch):
    """Rounds deal with the first level alone, where the next one is small."""
    levels, keep = [], communities._moved
    monkeypatch.setattr(communities, "_moved", lambda level, labels: levels.append(level) or keep(level, labels))
    edges = ring_of_cliques(4, 5)
    got = {r["id"]: r["community"] for r in communities.leiden(spark.createDataFrame(edges, "src long, dst long"), 10).collect()}
    assert len(levels) == 1 and got == {10 * c + i: 10 * c for c in range(4) for i in range(5)}


def test_paths_are_made_in_many_tasks(spark):
    """A small table of steps makes many paths, so its bytes alone must not decide on the tasks."""
    edges = as_graph(spark, list(itertools.combinations(range(60), 2))).edges
    found = graph.simple_paths(edges, 2)
    assert found.count() == 60 * 59 + 60 * 59 * 58
    files = {r["f"] for r in found.where("size(path) = 3").select(F.input_file_name().alias("f")).distinct().collect()}
    assert len(files) > 8


@pytest.mark.parametrize("bidirectional", [True, False])
def test_sets_of_two_steps_come_up_once(spark, monkeypatch, bidirectional):
    """Each set is told apart where it is made: no set is shuffled."""
    monkeypatch.setattr(graph, "PACKED", 40)
    edges = planted(5, groups=3, size=9, inside=0.7, outside=0.05) + [(900, 901), (901, 902), (901, 900)] + [(500, i) for i in range(501, 520)]
    g = as_graph(spark, edges, bidirectional)
    label = {r["id"]: r["community"] for r in communities.leiden(g.edges).collect()}
    found = graph.indirect_clusters(g, 2, most_paths=None)
    got, want = found.collect(), plain_sets(edges, label, 2, bidirectional)
    assert {frozenset(r["cluster"]) for r in got} == want and len(got) == len(want)
    assert all(r["cluster"] == sorted(r["cluster"]) for r in got)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "MapInArrow" in plan
    monkeypatch.setattr(graph, "SMALL", 20)  # larger communities by joins
    again = graph.indirect_clusters(g, 2, most_paths=None).collect()
    assert {frozenset(r["cluster"]) for r in again} == want and len(again) == len(want)


def test_a_component_of_a_million_edges_fits_a_task():
    """Arrays hold it, in place of dictionaries, which took some 100 bytes an edge and direction."""
    rng = np.random.default_rng(0)
    u, v = rng.integers(0, 100_000, (2, 1_000_000))
    u, v = np.divmod(np.unique(np.minimum(u, v) * 100_000 + np.maximum(u, v)), 100_000)
    u, v = u[u < v], v[u < v]
    tracemalloc.start()
    near = communities._near(u, v, np.union1d(u, v))
    held, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert len(near.ends) == 2 * len(u) and held < 12e6 and most < 100e6


@pytest.mark.parametrize("bidirectional", [True, False])
def test_sets_of_a_hub_are_listed_in_pieces(monkeypatch, bidirectional):
    monkeypatch.setattr(graph, "CELLS", 16)
    monkeypatch.setattr(graph, "BATCH", 5)
    edges = planted(6, groups=2, size=9, inside=0.7, outside=0.05) + [(500, i) for i in range(5, 30)] + [(i, 500) for i in range(5, 9)]
    steps = sorted({s for a, b in edges for s in [(a, b), (b, a)][: 1 + bidirectional] if a != b})
    row = graph._packed(pa.table({"src": [a for a, _ in steps], "dst": [b for _, b in steps]})).to_pylist()[0]
    out, into = ((np.frombuffer(row[f"{w}_start"], np.int64), np.frombuffer(row[f"{w}_ends"], np.int32)) for w in ("out", "into"))
    assert (len(into[0]) == 0) == bidirectional
    batches = [b for share in range(3) for b in graph._listed(pa.array(row["names"]), share, 3, out, out if bidirectional else into)]
    assert max(b.num_rows for b in batches) <= 5
    got = [frozenset(x) for b in batches for x in b.column("cluster").to_pylist()]
    assert set(got) == plain_sets(edges, defaultdict(int), 2, bidirectional) and len(got) == len(set(got))
