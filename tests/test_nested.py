"""Keys at any depth against plain recursion."""

import json

from geostrata.operators import nested


def plain(key, node, path="$"):
    out = []
    if isinstance(node, dict):
        for k, v in node.items():
            if k == key:
                out.append((f"{path}.{k}", v))
            elif k.startswith("vlr_") and isinstance(v, dict) and v.get("description") == key:
                if "data" in v:
                    out.append((f"{path}.{k}", v["data"]))
            else:
                out += plain(key, v, f"{path}.{k}")
    elif isinstance(node, list):
        for i, v in enumerate(node):
            out += plain(key, v, f"{path}[{i}]")
    return out


def test_search(spark):
    deep = {"x": 1}
    for k in range(9):
        deep = {"a": [deep, k], "b": {"x": {"x": k}}}
    docs = [deep, {"x": None}, {"y": {"vlr_1": {"description": "x", "data": {"x": [1, {"x": 2}]}}, "vlr_2": {"description": "y", "x": 3}, "vlr_3": 7, "vlr_4": {"description": "x"}}}, [[{"x": [1]}], "x"], "x", 5, {}, []]
    rows = [(i, json.dumps(v)) for i, v in enumerate(docs)] + [(100, None), (101, "{broken"), (0, json.dumps({"x": "twice"}))]
    got = sorted((r.id, r.path, json.loads(r.value)) for r in nested.search(spark.createDataFrame(rows, "id long, json string"), "x").collect() if r.value is not None)
    want = sorted([(i, p, v) for i, d in enumerate(docs) for p, v in plain("x", d)] + [(0, "$.x", "twice")], key=str)
    assert sorted(got, key=str) == want
    assert nested.search(spark.createDataFrame([], "id long, json string"), "x").count() == 0
