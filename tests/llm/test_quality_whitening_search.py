"""Quality ranking, whitening and ranked search against plain versions, and on nulls, ties, repeats, empty tables and clashing columns."""

from __future__ import annotations

import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

SF = "/root/testdata/sf0.001"
EXTRA = "score double, rank int, uid long, component int, quantile double, _bin int, number long, panel int"


def stored(spark, path, rows, schema, parts=3):
    spark.createDataFrame([(*r, 0.5, 1, 7, 2, 0.1, 3, 4, 5) for r in rows], f"{schema}, {EXTRA}").repartition(parts).write.parquet(str(path))
    return spark.read.parquet(str(path))


# ---- 11 quality


@pytest.fixture(scope="module")
def judged(spark, tmp_path_factory):
    good = "The meadow was quiet in the morning, and a few birds crossed the river. Later it rained {i} times."
    bad = ["BUY!! NOW!! CHEAP!! {i}!! " * 6, "word{i} word{i} word{i} word{i} again again again", "a$$$ b%%% c&&& {i}### d***"]
    rows = [(i, good.format(i=i) if i % 4 else bad[i % 3].format(i=i)) for i in range(240)]
    rows += [(900, None), (901, ""), (902, " \n "), (None, good.format(i=5)), (3, good.format(i=3)), (903, good.format(i=9) * 4000)]
    docs = stored(spark, tmp_path_factory.mktemp("judged") / "documents.parquet", rows, "doc_id long, text string")
    marks = [(i, int(i % 4 != 0)) for i in range(0, 240, 2)] + [(None, 1), (3, None), (900, 0)]
    marks += [(i, 1) for i in range(1, 240, 6)]
    return docs, spark.createDataFrame(marks, "doc_id long, quality int")


def test_quality_follows_the_labels(judged):
    from pricetide.llm import quality

    docs, labels = judged
    model = quality.fit(docs, labels)
    rows = quality.score_documents(docs, model, ["doc_id", "score"][:1]).collect()
    assert len(rows) == 246
    for r in rows:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["quantile"] <= 1
        if r["doc_id"] is not None and r["doc_id"] < 240:
            assert r["predicted"] == int(r["doc_id"] % 4 != 0), r
    by = {r["doc_id"]: r for r in rows}
    assert by[900]["score"] == by[901]["score"] == by[902]["score"]
    assert [r["score"] for r in rows if r["doc_id"] == 3] == [by[3]["score"]] * 2
    ranked = sorted(rows, key=lambda r: r["score"])
    assert all(a["quantile"] <= b["quantile"] for a, b in zip(ranked, ranked[1:], strict=False))
    best = quality.keep_best(quality.score_documents(docs, model), 0.25)
    assert abs(best.count() - 246 * 0.25) <= 3 + max(Counter(r["quantile"] for r in rows).values())


def test_pairwise_loss_is_least_and_cut_makes_fewest_mistakes():
    from pricetide.llm import quality

    rng = np.random.default_rng(1)
    better, worse = rng.normal(0.5, 1, (300, 4)), rng.normal(0, 1, (300, 4))
    w = quality.bradley_terry(better, worse)
    loss = lambda v: np.log1p(np.exp(-(better - worse) @ v)).mean() + quality.PENALTY / 2 * v @ v
    assert all(loss(w) <= loss(w + 1e-3 * d) for d in [*np.eye(4), *-np.eye(4)])
    s, y = rng.normal(0, 1, 200), rng.integers(0, 2, 200)
    mistakes = lambda c: ((s >= c) != (y == 1)).sum()
    edges = np.sort(s)
    assert mistakes(quality.quantile_cut(s, y)) == min(mistakes(c) for c in [edges[0] - 1, *((edges[1:] + edges[:-1]) / 2), edges[-1] + 1])
    i, j = quality.preferences(3, 50)
    assert set(i) == {0, 1, 2} and set(j) == set(range(50)) and len(i) == len(j) == 50 * quality.PARTNERS


def test_quality_without_preferences_and_rows(spark, judged):
    from pricetide.llm import quality

    docs, labels = judged
    none = labels.where("false")
    assert {r["score"] for r in quality.score_documents(docs, quality.fit(docs, none)).collect()} == {0.5}
    only = quality.score_documents(docs, quality.fit(docs, labels.where("quality = 1"))).collect()
    assert {(r["score"], r["predicted"]) for r in only} == {(1.0, 1)}
    assert quality.score_documents(docs.where("false"), quality.fit(docs.where("false"), labels)).count() == 0


def test_quality_of_unseen_documents(spark):
    from pricetide.llm import quality

    sf = "/root/testdata/sf0.01"
    held = {r["doc_id"]: r["predicted"] for r in quality.op11_quality(spark, sf).collect() if r["held_out"]}
    marks = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r["doc_id"] in held}
    assert len(marks) > 50 and sum(held[i] == y for i, y in marks.items()) / len(marks) >= 0.97


# ---- 12 whitening


def plain_whitening(rows, k=8):
    """vec_id -> (deviation, {component: |whitened|}), and what components explain, for vectors of one length."""
    x = np.array([[math.floor(1024 * c) + 100_000 for c in v] for _, v in rows], object)
    n, s = len(x), x.sum(0)
    centred = np.array([[float(n * c - t) / n for c, t in zip(r, s, strict=True)] for r in x])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    return [sum((n * c - t) ** 2 for c, t in zip(r, s, strict=True)) for r in x], centred @ vectors / np.sqrt(values), values / np.trace(centred.T @ centred / n)


def check_whitening(found, rows, k):
    deviation, white, explained = plain_whitening(rows, k)
    by = {}
    for r in found:
        by.setdefault(r["vec_id"], {}).setdefault(r["component"], []).append(r)
    assert len(found) == len(rows) * k and {r["n"] for r in found} == {len(rows)}
    assert len({r["identity_error"] for r in found}) == 1 and found[0]["identity_error"] < 1e-9
    signs = np.ones(k)
    for j in range(k):
        i = np.abs(white[:, j]).argmax()
        signs[j] = np.sign(by[rows[i][0]][j + 1][0]["whitened"] * white[i, j])
    for (i, _), d, w in zip(rows, deviation, white, strict=True):
        for j in range(k):
            one = by[i][j + 1]
            assert all(r["deviation"] == d and abs(r["whitened"] * signs[j] - w[j]) < 1e-9 and abs(r["explained"] - explained[j]) < 1e-9 for r in one)


def test_whitening_equals_a_plain_version(spark, monkeypatch):
    from pricetide.llm import whitening

    monkeypatch.setattr(whitening, "BLOCK", 640)  # 10 rows a block
    monkeypatch.setattr(whitening, "PANEL", 4)
    monkeypatch.setattr(whitening, "SPLIT", 2)
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r["vec_id"], list(r["embedding"])) for r in table.collect()]
    check_whitening(whitening.whiten(table.repartition(3)).collect(), rows, 8)


def test_whitening_of_odd_vectors(spark, tmp_path):
    from pricetide.llm import whitening

    rng = np.random.default_rng(3)
    fine = [(i, [float(c) for c in rng.normal(0, 1, 5)]) for i in range(40)]
    short = [(100 + i, [float(c) for c in rng.normal(0, 1, 2)]) for i in range(9)]
    bad = [(200, None), (201, [1.0, None, 1.0, 1.0, 1.0]), (202, [float("nan")] * 5), (203, [float("inf")] * 5), (204, []), (205, [1e300] * 5)]
    table = stored(spark, tmp_path / "v", [*fine, *short, *bad, fine[7]], "vec_id long, embedding array<double>")
    found = whitening.whiten(table).collect()
    assert {r["vec_id"] for r in found} == {*range(40), *range(100, 109)}
    check_whitening([r for r in found if r["vec_id"] < 100], [*fine, fine[7]], 5)
    check_whitening([r for r in found if r["vec_id"] >= 100], short, 2)
    flat = stored(spark, tmp_path / "flat", [(i, [1.0, float(i % 2)]) for i in range(6)], "vec_id long, embedding array<double>")
    rows = whitening.whiten(flat).collect()
    assert {round(abs(r["whitened"]), 12) for r in rows} == {0.0, 1.0} and {r["identity_error"] for r in rows} == {1.0}
    one = whitening.whiten(flat.where("vec_id = 1")).collect()
    assert [(r["component"], r["n"], r["deviation"], r["whitened"], r["explained"]) for r in sorted(one, key=lambda r: r["component"])] == [(1, 1, 0, 0.0, 0.0), (2, 1, 0, 0.0, 0.0)]
    assert whitening.whiten(table.where("false")).count() == 0


def test_deviations_are_exact():
    from pricetide.llm import whitening

    x = np.array([[1 << 40, 3], [5, -(1 << 40)]], np.int64)
    sums = x.astype(object).sum(0).tolist()
    assert whitening.deviations(x, 2, sums) == [None, None]
    small = np.array([[10, 3], [5, 8]], np.int64)
    assert whitening.deviations(small, 2, [15, 11]) == [25 + 25, 25 + 25]
    wide = np.array([[1 << 31, 0], [0, 0]], np.int64)
    assert whitening.deviations(wide, 2, [1 << 31, 0]) == [1 << 62, 1 << 62]


# ---- 13 ranked search

WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain_search(docs, items, k=50):
    """For each item (item_id, [(doc_id, score)])."""
    split = [(i, Counter(WORD.findall(t.translate(LOWER)))) for i, t in docs if t]
    split = [(i, c) for i, c in split if c]
    n, total = len(split), sum(c.total() for _, c in split)
    df = Counter(w for _, c in split for w in c)
    weight = {w: math.floor(1000 * math.log((2 * n + 2) / (2 * x + 1))) for w, x in df.items()}
    out = []
    for item, text in items:
        scored = []
        for i, c in split:
            m = 50 + (50 * c.total() * n) // total
            score = sum(weight[w] * ((1_000_000_000 * c[w]) // (1000 * c[w] + 20 * m)) for w in set(WORD.findall((text or "").translate(LOWER))) if w in c)
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out.append((item, [(i, -s) for s, _, _, i in sorted(scored, key=lambda x: x[:3])[:k]]))
    return out


def listed(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: (str(r["item_id"]), r["rank"])):
        out.setdefault(r["item_id"], []).append((r["rank"], r["doc_id"], r["score"]))
    return out


def as_listed(plain):
    return {item: [(r + 1, *x) for r, x in enumerate(rows)] for item, rows in plain if rows}


@pytest.mark.parametrize(("block", "partners", "k"), [(16_384, 4, 50), (37, 4, 50), (20, 0, 5), (64, 9, 3)])
def test_search_equals_a_plain_version(spark, monkeypatch, block, partners, k):
    from pricetide.llm import lexical

    monkeypatch.setattr(lexical, "BLOCK", block)
    monkeypatch.setattr(lexical, "PARTNERS", partners)
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    plain = plain_search([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()], k)
    assert listed(lexical.ranked_search(docs, items, k)) == as_listed(plain)


def test_search_on_odd_rows_and_in_rounds(spark, tmp_path, monkeypatch):
    from pricetide.llm import lexical

    texts = [(1, "Red fox, red dog"), (2, "red FOX"), (2, "red FOX"), (None, "red fox"), (None, "red fox"), (3, None), (4, ""), (5, " .,!\t"), (6, "été ÉTÉ 42 naïve_x"), (7, "fox " * 30_000 + "end")]
    texts += [(100 + i, f"filler{i % 7} stone") for i in range(60)]
    docs = stored(spark, tmp_path / "d", texts, "doc_id long, text string")
    asked = [(1, "fox RED"), (2, "stone filler3"), (3, None), (4, "?!"), (5, "ÉTÉ 42 x"), (6, "unknown words"), (7, "end fox fox"), (8, "stone " * 5000)]
    items = stored(spark, tmp_path / "i", asked, "item_id long, text string")
    want = as_listed(plain_search(texts, asked))
    assert listed(lexical.ranked_search(docs, items)) == want and set(want) == {1, 2, 5, 7, 8}
    monkeypatch.setattr(lexical, "ROUND_BYTES", 9_000)
    monkeypatch.setattr(lexical, "OCCURRENCES", 50)
    assert listed(lexical.ranked_search(docs, items)) == want
    twice = stored(spark, tmp_path / "t", [(1, "fox red"), (1, "fox red"), (None, "stone")], "item_id long, text string")
    rows = lexical.ranked_search(docs, twice, 4).collect()
    assert sorted((r["item_id"] or 0, r["rank"]) for r in rows) == sorted([(1, r) for r in (1, 1, 2, 2, 3, 3, 4, 4)] + [(0, r) for r in (1, 2, 3, 4)])
    assert lexical.ranked_search(docs.where("false"), items).count() == 0
    assert lexical.ranked_search(docs, items.where("false")).count() == 0


def test_stored_rows_are_small_also_where_terms_stand_together(spark, tmp_path, monkeypatch):
    """Rows of 12 bytes a posting and with the whole lists of pairs took an executor past its memory: a posting takes 3, a pair that saves nothing no list."""
    from pricetide.llm import lexical

    kept = {}
    monkeypatch.setattr(lexical, "materialize", lambda df, name, write=lexical.materialize: kept.setdefault(name, write(df, name)))
    texts = [(i, " ".join([f"all{j}" for j in range(30)] + ["all1"] * (i % 300) + [f"few{i % 40}", f"few{i % 37}"])) for i in range(800)]
    asked = [(1, " ".join(f"all{j}" for j in range(30))), (2, "few1 few2 few3 all1"), (3, "few0 few1 all3")]
    docs, items = stored(spark, tmp_path / "d", texts, "doc_id long, text string").coalesce(1), stored(spark, tmp_path / "i", asked, "item_id long, text string")
    assert listed(lexical.ranked_search(docs, items)) == as_listed(plain_search(texts, asked))
    index = kept["index"]
    size = lambda c: f"cast(sum(octet_length({c})) as long)"
    postings, at, tf, both = index.selectExpr("sum(aggregate(counts, 0, (a, x) -> a + x))", size("at"), size("tf"), size("both")).first()
    assert postings > 24_000 and at == 2 * postings and tf <= 2 * postings  # one text has a term 300 times
    assert 0 < both < 0.1 * postings
    everything = index.selectExpr(*[size(f.name) for f in index.schema if f.dataType.simpleString() == "binary"]).first()
    assert sum(everything) < 6 * postings


def test_pair_bounds_skip_more_than_single_bounds(monkeypatch):
    """Frequent words that stand together in long documents only: their joint maximum is far under the sum of their maxima."""
    from pricetide.llm import lexical

    rng = np.random.default_rng(5)
    n, terms, lists = 4000, 8, []
    for t in range(terms):
        at = np.flatnonzero(rng.random(n) < (0.4 if t < 4 else 0.03)).astype(np.int32)
        impact = np.where(rng.random(len(at)) < 0.02, 900, rng.integers(50, 300, len(at))) * (1 if t < 4 else 4)
        lists.append((at, impact.astype(np.int64)))
    counts = np.array([len(a) for a, _ in lists])
    make = lambda: lexical.Block(np.arange(terms), counts, np.concatenate([a for a, _ in lists]), np.concatenate([x for _, x in lists]), np.arange(n), np.zeros(n, bool))
    full = np.zeros(n, np.int64)
    for at, x in lists:
        full[at] += x
    read = {}
    for name, pairs in (("single", []), ("pairs", lexical.partners(list(range(terms))))):
        block = make()
        block.add_pairs(pairs)
        least = int(np.sort(full)[-20])
        scores, places = block.search(list(range(terms)), pairs, least, 20)
        best = np.lexsort((places, -scores))[:20]
        assert scores[best].tolist() == sorted(full.tolist(), reverse=True)[:20] and (full[places] == scores).all()
        assert not block.sums.any()
        read[name] = block.read
    assert read["pairs"] < 0.8 * read["single"] < 0.8 * counts.sum()


def test_search_equals_its_sql(spark):
    from pricetide.llm import lexical

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(lexical.ORACLE["op13_ranked_search"]).fetchall()
    assert sorted(map(tuple, lexical.op13_ranked_search(spark, SF).select("item_id", "rank", "doc_id", "score").collect())) == sorted(want)
