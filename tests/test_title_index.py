"""Substring search by grams against ILIKE on every pair."""

from __future__ import annotations

import random
import re

from pricetide.operators.title_index import _asked, build_title_index, extend_title_index, first_products, open_title_index, search_titles

SCHEMA = "product_id long, canonical_title string"


def plain(products, searches):
    found = set()
    for q in searches:
        if q is None:
            continue
        pattern = re.compile("".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in f"%{q.lower()}%"), re.S)
        found |= {(q, i) for i, t in products if t is not None and pattern.fullmatch(t.lower())}
    return found


def found(index, spark, searches):
    hits = search_titles(index, spark.createDataFrame([(q,) for q in searches], "query string"))
    rows = [tuple(r) for r in hits.collect()]
    assert len(rows) == len(set(rows))
    return set(rows), hits


def test_index_finds_what_a_scan_finds(spark, tmp_path):
    rng = random.Random(2)
    words = ["red", "Blue", "gadget", "ÉTÉ", "pro_max", "50%", "a", "xy", "😀 lamp", "osmo"]
    titles = [rng.choice(["", " ", "-"]).join(rng.choice(words) for _ in range(rng.randint(1, 4))) for _ in range(300)]
    products = [*enumerate(titles), (900, None), (901, ""), (902, titles[0]), (903, "line\nbreak")]
    searches = ["red", "RED", "r", "xy", "", "%", "_", "___", "e_b", "d%a", "été", "😀", "gadgetgadget", "nothing at all", None, "o%o%o", "line_break", "a" * 40, "pro_max", "50%", titles[5], titles[6][1:4]]
    searches += [t[rng.randint(0, 2) :][: rng.randint(1, 6)] for t in titles[:60]]
    table = spark.createDataFrame(products, SCHEMA)
    index = build_title_index(table, str(tmp_path / "i"))
    got, hits = found(index, spark, searches)
    assert got == plain(products, set(searches)) and len(got) > 500
    plan = hits._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_index_grows_and_a_batch_may_come_twice(spark, tmp_path):
    first, later = [(1, "Red lamp"), (2, "Blue lamp")], [(2, "Blue lamp"), (3, "red LAMP"), (4, "Green desk")]
    path = str(tmp_path / "i")
    build_title_index(spark.createDataFrame(first, SCHEMA), path)
    for _ in range(2):
        index = extend_title_index(spark.createDataFrame(later, SCHEMA), path)
        assert found(index, spark, ["lamp", "e"])[0] == plain(set(first + later), ["lamp", "e"])
        assert index.titles.count() == 4
    assert index.postings.count() == index.postings.distinct().count()
    assert index.counts.where("gram = ''").first()["n"] == 3  # different titles
    assert found(open_title_index(spark, path), spark, ["desk"])[0] == {("desk", 4)}


def test_index_of_nothing(spark, tmp_path):
    index = build_title_index(spark.createDataFrame([], SCHEMA), str(tmp_path / "i"))
    assert found(index, spark, ["", "x"])[0] == set()
    index = build_title_index(spark.createDataFrame([(1, "x")], SCHEMA), str(tmp_path / "j"))
    assert found(index, spark, [])[0] == set()


def test_searches_are_looked_up_by_their_rarest_longest_grams(spark, tmp_path):
    index = build_title_index(spark.createDataFrame([(i, f"Lamp {i:03d}") for i in range(100)], SCHEMA), str(tmp_path / "i"))
    searches = ["LAMP 042", "mp", "x_lamp%am", "a%b", "%_", ""]
    asked = _asked(spark.createDataFrame([(q,) for q in searches], "query string"), index.counts).collect()
    grams = {q: {r["gram"] for r in asked if r["query"] == q} for q in searches}
    assert grams == {"LAMP 042": {"042", " 04", "amp"}, "mp": {"mp"}, "x_lamp%am": {"lam", "amp"}, "a%b": {"a", "b"}, "%_": {""}, "": {""}}
    assert all(r["asked"] == len(grams[r["query"]]) for r in asked)


def test_first_products_of_many_with_one_title(spark, tmp_path):
    rng = random.Random(3)
    products = [(i, rng.choice(["red lamp", "Red LAMP", "red desk", "Blue lamp", f"lamp {i}"])) for i in rng.sample(range(1000), 200)]
    searches = ["lamp", "RED", "d%l", "nothing", "", "lamp 7"]
    index = build_title_index(spark.createDataFrame(products, SCHEMA), str(tmp_path / "i"))
    rows = first_products(index, spark.createDataFrame([(q,) for q in searches], "query string"), 7).collect()
    every = {q: sorted(i for s, i in plain(products, searches) if s == q) for q in searches}
    assert sorted((r["query"], r["rank"], r["product_id"]) for r in rows) == sorted((q, n, i) for q in searches for n, i in enumerate(every[q][:7], 1))
