"""Flat tables of nested JSON against a recursive walk, and the round trip from objects and links."""

import json
import random

from docketspark.functions.jsontext import read_json
from docketspark.operators.nested import Shape, Walker, nested_tables

LISTS = frozenset(["spans", "steps"])


def brute(v, shape, path=""):
    """Paths of objects that are list elements."""
    out = []
    if isinstance(v, dict):
        for k, x in v.items():
            p = f"{path}.{k}" if path else k
            if isinstance(x, dict) and k in shape.list_names:
                x = [x]
            out += brute(x, shape, p)
    elif isinstance(v, list):
        for i, x in enumerate(v):
            if isinstance(x, dict):
                out.append(f"{path}[{i}]")
            out += brute(x, shape, f"{path}[{i}]")
    return out


CASES = [
    {"a": [{"b": [None, {"c": 1}]}, 2, {"b": []}]},
    [{"x": {"spans": {"s": 1}}}, None, [{"y": 1}, [{"z": {}}]]],
    {"spans": {"spans": {"spans": [{}]}}},
    {},
    [],
    {"t": "[{}]", "n": 1.5, "u": True, "s": None},
]


def test_paths():
    for v in CASES:
        for root in (False, True):
            shape = Shape(root, LISTS)
            want = brute([v] if root and isinstance(v, dict) else v, shape)
            got = [w.path for w in Walker(shape).walk(v) if w.in_list]
            assert sorted(got) == sorted(want)


def test_equal_subtrees_share_an_identity():
    w = {x.path: x.object_id for x in Walker(Shape()).walk({"p": {"a": 1, "b": [{"c": 2}]}, "q": {"b": [{"c": 2}], "a": 1}, "r": {"a": 1, "b": [{"c": 3}]}})}
    assert w["p"] == w["q"] != w["r"] and w["p.b[0]"] == w["q.b[0]"]


def rebuild(root, bodies, links):
    """The value of an object from its scalar fields and the links to its children, references left aside."""

    def put(into, at, value):
        for i in at[:-1]:
            into = into[i]
        assert set(into[at[-1]]) == {"$ref"}
        into[at[-1]] = value

    v = json.loads(bodies[root])
    for parent, child, name, at in links:
        if parent == root:
            put(v, (name, *at), rebuild(child, bodies, links))
    return v


def test_values_come_back_from_links():
    r = random.Random(3)

    def value(depth):
        k = r.randrange(6 if depth else 3)
        if k < 3:
            return r.choice([1, "x", None, True])
        if k == 3:
            return [value(depth - 1) for _ in range(r.randrange(4))]
        return {r.choice(["a", "b", "a.b", "m", "x]", "n[0]"]): value(depth - 1) for _ in range(r.randrange(4))}

    for v in [{"m": [[{"q": 1}], [{"q": 1}]]}, {"a.b": {"c": {}}, "a": {"b": {"c": {"d": {}}}}}, {"x]": {"y": 1}}, *({"top": value(5)} for _ in range(400))]:
        found = Walker(Shape()).walk(v)
        ids = {p.occ_no: p.object_id for p in found}
        assert len(ids) == len(found)
        links = {(ids[p.parent_no], p.object_id, p.name, p.ordinals) for p in found if p.parent_no is not None}
        assert rebuild(ids[0], {p.object_id: p.body for p in found}, links) == v
        assert all(p.in_list == bool(p.ordinals) for p in found)


def test_read_json():
    assert read_json('"{\\"a\\": 1}"') == (True, {"a": 1})
    for bad in (None, "", "  ", "{", '{"a":1', '"[{\\"a\\""', "plain", "NaN", "[NaN]", '"x"', "12"):
        assert read_json(bad) == (False, None)
    assert read_json("[" * 100000)[0] is False


def test_tables(spark):
    texts = [json.dumps(v) for v in CASES]
    data = [(f" R{i} ", t, "clash") for i, t in enumerate(texts)] + [("r0", texts[0], None), ("x", None, None), ("y", '{"a":[{', None), (None, texts[0], None), ("z", json.dumps(texts[1]), None)]
    df = spark.createDataFrame(data, "id string, doc string, path string")
    t = nested_tables(df, "s", "id", "doc", Shape(False, LISTS))
    occ = t.occurrences().collect()
    for i, v in enumerate(CASES):
        assert {o.path for o in occ if o.row_id == f"r{i}" and o.in_list} == set(brute(v, Shape(False, LISTS)))
    assert {o.path for o in occ if o.row_id == "z" and o.in_list} == set(brute(CASES[1], Shape(False, LISTS)))
    objects = {o.object_id: json.loads(o.body) for o in t.objects().collect()}
    assert len(objects) == t.objects().count() and {o.object_id for o in occ} == set(objects)

    def restore(v):
        if isinstance(v, dict):
            return restore(objects[v["$ref"]]) if set(v) == {"$ref"} else {k: restore(x) for k, x in v.items()}
        return [restore(x) for x in v] if isinstance(v, list) else v

    for i, v in enumerate(CASES):
        roots = [o.object_id for o in occ if o.row_id == f"r{i}" and o.path == ""]
        if isinstance(v, dict) and v != CASES[2]:
            assert restore(objects[roots[0]]) == v
    links = t.links().collect()
    keys = [(x.parent_id, x.child_id, x.name, tuple(x.ordinals)) for x in links]
    assert len(keys) == len(set(keys)) and all(x.parent_id in objects and x.child_id in objects for x in links)


def test_empty(spark):
    t = nested_tables(spark.createDataFrame([], "id long, j string"), "s", "id", "j")
    assert t.occurrences().count() == t.objects().count() == t.links().count() == 0


def test_deep_and_surrogate(spark):
    deep = '{"a":' * 500 + "1" + "}" * 500
    df = spark.createDataFrame([(1, deep), (2, '[{"k":"\\ud800"}]')], "id long, j string")
    t = nested_tables(df, "s", "id", "j")
    assert t.occurrences().where("row_id = '1'").count() == 500
    assert t.objects().count() == 501
