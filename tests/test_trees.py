"""JSON trees of any depth against plain loops."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from pricetide.functions.trees import nesting
from pricetide.operators import finance, replies


def flat_paths(tree):
    """dot path -> value of the objects of ``tree``, by a stack of what is still to open."""
    out, todo = {}, [(k, v) for k, v in tree.items() if isinstance(v, dict)]
    while todo:
        path, v = todo.pop()
        if v is None:
            continue
        if isinstance(v, dict) and v and set(v) <= {"raw", "fmt", "longFmt"} and ("raw" in v or "fmt" in v):
            out[path] = v["raw"] if "raw" in v else v["fmt"]
        elif isinstance(v, dict):
            todo += [(f"{path}.{k}", x) for k, x in v.items()]
        elif isinstance(v, list) and v and all(isinstance(x, dict) for x in v):
            out[path] = [flat_paths(x) if any(isinstance(y, dict) for y in x.values()) else x for x in v]
        else:
            out[path] = v
    return out


def grown(rng, depth, wide=3):
    """A tree with objects, lists of objects, wrapped values, nulls and empties."""
    if depth == 0 or rng.random() < 0.1:
        return rng.choice([1, 2.5, "a\"b{[", True, None, [], {}, [1, "x"], {"raw": 3}, {"fmt": "4%"}, {"raw": 5, "fmt": "5", "longFmt": "five"}])
    if rng.random() < 0.35:
        return [grown(rng, depth - 1, 2) if rng.random() < 0.2 else {f"k{i}": grown(rng, depth - 1, 2) for i in range(rng.randint(1, 2))} for _ in range(rng.randint(1, 2))]
    return {rng.choice("abcdef") + str(i): grown(rng, depth - 1, 2) for i in range(rng.randint(1, wide))}


def chain(depth, leaf, name="d"):
    for i in range(depth):
        leaf = {f"{name}{i % 7}": leaf}
    return leaf


def listed(depth, leaf):
    """A list of objects in a list of objects ... ``depth`` deep, an object beside each."""
    for i in range(depth):
        leaf = {"l": [{"o": {"x": i, "in": leaf}, "lost": 1}, {"plain": i}, {"e": {}}]}
    return leaf


def test_nesting(spark):
    texts = ['{"a": [[{"b": "{[\\"[[["}]], "c": {}}', "[]", "1", "", None, '{"a": "\\\\"}']
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", nesting(F.col("t")), nesting(F.col("t"), "{"), nesting(F.col("t"), "["))
    assert [tuple(r)[1:] for r in rows.orderBy("i").collect()] == [(4, 2, 2), (1, 0, 1), (0, 0, 0), (0, 0, 0), (0, 0, 0), (1, 1, 0)]


def test_modules_at_any_depth(spark):
    rng = random.Random(5)
    trees = [{"m": chain(40, {"raw": 1})}, {"m": chain(40, {"x": [{"y": chain(20, 3)}]})}, {"m": listed(1, {"a": 1})}, {"m": listed(3, {"a": 1})}, {"m": listed(7, {"a": {"b": 2}})}, {"m": {"l": []}, "n": 3}, {}]
    trees += [{f"m{i}": grown(rng, rng.randint(1, 7)) for i in range(3)} for _ in range(40)]
    rows = [(str(i), json.dumps(t)) for i, t in enumerate(trees)] + [("x", None), ("y", "broken {[[[["), ("z", "[1]")]
    found = {}
    for r in finance.flatten_modules(spark.createDataFrame(rows, "ticker string, modules string")).collect():
        found.setdefault(r["ticker"], {})[r["key"]] = json.loads(r["value_json"])
    assert found == {str(i): flat for i, t in enumerate(trees) if (flat := flat_paths(t))}


def merged(parts):
    """One object of many, by a stack of (where to put it, the objects that stand there)."""
    out, todo = {}, []
    todo.append((out, parts))
    while todo:
        into, told = todo.pop()
        for part in told:
            if isinstance(part, dict) and part.get("_error") in (None, "", 0, False):
                for k, v in part.items():
                    if v is not None and not k.startswith("_"):
                        into.setdefault(k, []).append(v)
        for k, values in into.items():
            first = values[0]
            same = [v for v in values if isinstance(v, type(first))]
            if isinstance(first, list) and len(same) > 1:
                seen, one = set(), []
                for item in (x for v in same for x in v):
                    sign = json.dumps(item, sort_keys=True) if isinstance(item, (dict, list)) else str(item)
                    if sign not in seen:
                        seen.add(sign)
                        one.append(item)
                into[k] = one
            elif isinstance(first, dict) and len(same) > 1:
                into[k] = {}
                todo.append((into[k], same))
            else:
                into[k] = first
    return out


def reply(rng, depth):
    if depth == 0:
        return rng.choice([1, "t", None, [1, 2], [{"a": 1}], {}, 2.5])
    return {rng.choice(["a", "b", "c", "_m", 'q"u'] + ["_error"] * (rng.random() < 0.05)): reply(rng, depth - 1) if rng.random() < 0.7 else rng.choice([1, None, ["x", rng.randint(0, 2)], {}]) for _ in range(3)}


@pytest.mark.parametrize("depth", [3, 30])
def test_replies_merge_at_any_depth(spark, depth):
    rng = random.Random(depth)
    pages = {i: [reply(rng, 4) for _ in range(rng.randint(1, 5))] for i in range(30)}
    pages[90] = [chain(depth, {"x": [1], "n": 1}), chain(depth, {"x": [2, 1], "n": 2, "z": 3}), 7, chain(depth, [5])]
    pages[91] = [chain(depth, {"x": 1}), chain(depth - 1, 5), chain(depth, {"_x": 1, "y": None})]
    pages[92], pages[93] = [{"a": {"_y": 1}}, {"a": {"_z": 2}}], [{"_error": "x", "a": 1}]
    rows = [(page, i, json.dumps(p)) for page, parts in pages.items() for i, p in enumerate(parts)]
    found = {r["page_id"]: json.loads(r["merged"]) for r in replies.merge_partials(spark.createDataFrame(rows, "page_id int, panel int, parsed string").repartition(3)).collect()}
    assert found == {page: merged(parts) for page, parts in pages.items()}


def test_steps_of_a_merge_do_not_grow_with_depth(spark):
    def exchanges(depth):
        rows = spark.createDataFrame([(1, i, json.dumps(chain(depth, i))) for i in range(3)], "page_id int, panel int, parsed string")
        return replies.merge_partials(rows)._jdf.queryExecution().executedPlan().toString().count("Exchange")

    assert exchanges(2) == exchanges(25)
