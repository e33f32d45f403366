"""Scene-graph edges and triplets: radii are never joined to pairs."""

import math
import random

from scenelake.operators import graph

from test_registration import plan


def scene(spark, n):
    rnd = random.Random(8)
    rows = [(k, rnd.choice(["wall", "floor", "chair"]), *[rnd.uniform(0, 4) for _ in range(3)], 0.5 + k % 4) for k in range(n)]
    rows += [(3, "chair", 1.0, 1.0, 1.0, 2.5), (None, "chair", 1.0, 1.0, 1.0, 2.5)]  # an id twice, none
    return rows, spark.createDataFrame(rows, "node_id int, semantic string, x double, y double, z double, radius double")


def reach(a, b):
    return max(1.0, min(2.0, 0.6 * max(1.0 if r[1] == "wall" else r[5] for r in (a, b))))


def wanted(rows):
    use = [r for r in rows if r[1] != "floor" and r[0] is not None]
    return [(a[0], b[0]) for a in use for b in use if a[0] < b[0] and math.dist(a[2:5], b[2:5]) < reach(a, b)]


def test_edges_and_triplets_are_whole(spark):
    rows, nodes = scene(spark, 120)
    edges = graph.graph_edges(nodes, 0.6, 1.0, 2.0)
    want = wanted(rows)
    assert sorted((r.i, r.j) for r in edges.collect()) == sorted(want) and len(want) > 300
    ends = want + [(b, a) for a, b in want]
    both = sorted((c, a, b) for c, a in ends for d, b in ends if c == d and a < b)
    assert sorted(map(tuple, graph.triplets(edges).collect())) == both


def test_radii_travel_with_the_nodes(spark):
    _, nodes = scene(spark, 10)
    assert plan(graph.graph_edges(nodes, 0.6, 1.0, 2.0)).count("Join ") == 1
