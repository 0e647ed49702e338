"""Trees, cycles and dirt, against a walk in plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from docketspark.operators import hierarchy
from docketspark.operators.hierarchy import build_hierarchy, latest_links, resolve_aliases

LINKS = "node_id string, parent_id string"


def brute(links: dict) -> dict:
    out = {}
    for n in links:
        path, seen, x = [n], {n}, n
        while True:
            p = links[x]
            if p is None or p not in links:
                out[n] = (x, len(path) - 1, path[::-1], False)
                break
            if p in seen:
                ring = path[path.index(p) :]
                out[n] = (min(ring), -1, None, n in ring)
                break
            path.append(p)
            seen.add(p)
            x = p
    return out


def rows(h):
    return {r.node_id: (r.root_id, r.depth, r.path, r.on_cycle) for r in h.nodes.collect()}


@pytest.mark.parametrize("seed,hops,rounds", [(1, 3, 8), (2, 0, 1), (3, 1, 2), (4, 2, 1)])
def test_random_forests(spark, seed, hops, rounds):
    r = random.Random(seed)
    names = [f"n{i:03d}" for i in range(60)]
    links = {n: r.choice([None, "gone", n, *names, *names]) for n in names}
    for i in range(1, 25):  # a deep chain
        links[names[i]] = names[i - 1]
    h = build_hierarchy(spark.createDataFrame(list(links.items()), LINKS), hops, rounds)
    want = brute(links)
    assert rows(h) == want
    ring = {n for n, v in want.items() if v[3]}

    def branch(n):
        return [n] if n in ring else [*branch(links[n]), n]

    pairs = {(a, n, d) for n, (_, depth, path, _) in want.items() for d, a in enumerate((path or branch(n))[::-1]) if d}
    got = [tuple(x) for x in h.descendants().select("ancestor_id", "node_id", "distance").collect()]
    assert set(got) == pairs and len(got) == len(pairs)
    assert {x.node_id for x in h.cycles().collect()} == {n for n, v in want.items() if v[1] == -1}


def test_two_long_cycles_with_tails(spark):
    links = {f"a{i:02d}": f"a{(i + 1) % 16:02d}" for i in range(16)} | {f"b{i}": f"b{(i + 1) % 5}" for i in range(5)}
    links |= {"t0": "a03", "t1": "t0", "t2": "t1", "u0": "b4", "self": "self"}
    assert rows(build_hierarchy(spark.createDataFrame(list(links.items()), LINKS))) == brute(links)


def test_cycles_longer_than_segments(spark, monkeypatch):
    monkeypatch.setattr(hierarchy, "REPEAT", 8)
    links = {f"a{i:02d}": f"a{(i + 1) % 40:02d}" for i in range(40)} | {f"b{i}": f"b{(i + 1) % 3}" for i in range(3)}
    links |= {"t0": "a03"} | {f"t{i}": f"t{i - 1}" for i in range(1, 20)}
    h = build_hierarchy(spark.createDataFrame(list(links.items()), LINKS), 1, 2)
    assert rows(h) == brute(links)
    assert {r.node_id: r.branch for r in h.nodes.collect()}["t2"] == ["a03", "t0", "t1", "t2"]


def test_empty_and_single(spark):
    assert build_hierarchy(spark.createDataFrame([], LINKS)).nodes.count() == 0
    assert rows(build_hierarchy(spark.createDataFrame([("x", None)], LINKS))) == {"x": ("x", 0, ["x"], False)}


def test_latest_links_cleans_and_folds(spark):
    data = [(" A\t", "B ", 1, "extra"), ("a", " ", 2, None), ("a", " ", 2, None), (None, "b", 1, None), ("  ", "b", 1, None), ("B", None, None, None), ("b", "a", None, None)]
    df = spark.createDataFrame(data, "id string, up string, v int, node_id string")
    got = {r.node_id: r.parent_id for r in latest_links(df, "id", "up", "v").collect()}
    assert got == {"a": None, "b": "a"}


def test_aliases(spark):
    links = spark.createDataFrame([("a", "so x"), ("b", "a"), ("c", "nobody"), ("d", "b")], LINKS)
    aliases = spark.createDataFrame([("so x", "c"), ("so x", "b"), ("b", "c")], "alias string, node_id string")
    got = {r.node_id: r.parent_id for r in resolve_aliases(links, aliases).collect()}
    assert got == {"a": "b", "b": "a", "c": "nobody", "d": "b"}


def test_hot_parent(spark):
    df = spark.range(3000).select(F.col("id").cast("string").alias("node_id"), F.when(F.col("id") > 0, "0").alias("parent_id"))
    assert build_hierarchy(df).nodes.where("depth = 1").count() == 2999
