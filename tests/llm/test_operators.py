"""Each operator against a brute-force version, and on nulls, empty and long texts, ties, empty tables and clashing columns."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import pytest

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Nulls in every column, empty and long texts, repeated rows, an id that repeats, and columns with clashing names."""
    long = " ".join(f"word{i % 977}" for i in range(40_000))
    rows = [
        (1, "the quick brown fox jumps over the lazy dog", "en", "a", 1), (2, "the quick brown fox jumps over the lazy dog", "en", "a", 1),
        (2, "the quick brown fox jumps over the lazy dog", "en", "a", 1), (3, None, "en", None, None), (4, "", None, "b", 0),
        (None, "some text without id", "en", "b", 5), (5, long, "en", "b", 9), (6, long + " tail", None, None, 9),
        (7, "  \t\n ", "en", "a", 4), (8, "mail joe@example.com or +1 (974) 555-3436", "en", "a", 7), (9, "12345 !!", "xx", "c", 3),
        (10, "Le chat 😀 est là", "fr", "c", 3), (11, "le CHAT 😀 est là", "fr", "c", 3),
    ]
    extra = "uid long, score double, slot long, spans string, digit string, lang_pred string"
    path = str(tmp_path_factory.mktemp("odd") / "documents.parquet")
    spark.createDataFrame([(*r, 7, 0.5, 3, "x", "y", "z") for r in rows], f"{SCHEMA}, {extra}").repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def none(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("none") / "documents.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def crc(i) -> int:
    return zlib.crc32(str("" if i is None else i).encode())


# ---- 1 personal data

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text):
    def fine(kind, hit):
        digits = re.sub("[^0-9]", "", hit)
        if kind == "ip":
            return all(int(p) <= 255 for p in hit.split("."))
        if kind == "card":
            total = sum(x if k % 2 == 0 else x * 2 - 9 * (x > 4) for k, x in enumerate(map(int, reversed(digits))))
            return 13 <= len(digits) <= 19 and total % 10 == 0
        return kind != "phone" or 9 <= len(digits) <= 15

    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if fine(k, m.group())]


def test_personal_data(spark, docs, odd, none):
    from pricetide.llm import pii

    for table in (docs, odd):
        found = sorted((r["doc_id"] or -1, r["base_sha256"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) for r in pii.personal_data(table).collect())
        want = []
        for r in table.select("doc_id", "text").collect():
            spans = base_spans(r["text"])
            digest = hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
            want.append((r["doc_id"] or -1, digest, *[sum(s[0] == k for s in spans) for k in PATTERNS]))
        assert found == sorted(want)
    assert pii.personal_data(none).count() == 0


def found_spans(spark, path, rows):
    from pricetide.llm import pii

    spark.createDataFrame(rows, "text string, doc_id long").write.parquet(path)
    return {r["doc_id"]: r for r in pii.personal_data(spark.read.parquet(path)).collect()}


def test_added_cards_depend_on_their_surroundings(spark, tmp_path):
    """Where numbers in such a place mostly pass, two cards in one run are added; where most fail, passing is chance."""
    cards = [(f"pay by card {4111111111111111} now", i) for i in range(60)]
    run = [("so pay by card 4111111111111111 4012888888881881", 500), ("the code 4111111111111111 4012888888881881", 501)]
    codes = [(f"the code {4111111111111112 + i} x", 100 + i) for i in range(100)]
    rows = found_spans(spark, str(tmp_path / "d"), [*cards, *codes, *run])
    assert rows[500]["spans"] == "card:15:31,card:32:48" and rows[500]["n_card"] == 0 and rows[500]["n_spans"] == 2
    assert rows[501]["spans"] == ""
    assert all((r["spans"] != "") == bool(base_spans(t)) for t, i in codes for r in [rows[i]])


def test_secrets_are_added_and_slugs_are_not(spark, tmp_path):
    secrets = [(f'set token = "{hashlib.sha1(str(i).encode()).hexdigest()}" here', i) for i in range(60)]
    words = [(f"see some-long-page-name-{chr(97 + i % 26)} there", 100 + i) for i in range(60)]
    rows = found_spans(spark, str(tmp_path / "d"), [*secrets, *words, ("plain words", 300), (None, 301)])
    assert all(rows[i]["spans"] == "secret:13:53" and rows[i]["n_secret"] == 1 for i in range(60))
    assert all(rows[i]["spans"] == "" for i in rows if i >= 100)


def test_labels_are_no_features_and_thresholds_are_calibrated():
    from pricetide.llm import pii

    assert not {"passes", "given", "wide", "valid", "sign"} & set(pii.FEATURES)
    assert pii.calibrate([(0.9, 90, 0), (0.8, 10, 90), (0.1, 0, 50)], 0.1) == 0.8  # 100 pass, 10 of them by chance
    assert pii.calibrate([(0.9, 90, 0), (0.8, 10, 95), (0.1, 0, 50)], 0.1) == 0.9
    assert pii.calibrate([(0.5, 5, 5)], 0.5) == pii.calibrate([], 0.5) == 2.0
    x = [(k, a, 1, 0, 1, b, 0, 1, 2) for k in range(2) for a in range(2) for b in range(2)]
    right, wrong = [9.0 if v[5] else 1.0 for v in x], [1.0 if v[5] else 9.0 for v in x]
    prior, trees = pii.boost(x, right, wrong)
    odds = [prior + sum(pii._value(t, v) for t in trees) for v in x]
    assert all((o > 1.5) == bool(v[5]) and (o < -1.5) == (not v[5]) for o, v in zip(odds, x, strict=True))


def test_redact(spark, odd):
    from pricetide.llm import pii

    out = pii.redact(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    assert out.where("doc_id = 8").first()["text"] == "mail [EMAIL] or [PHONE]"


# ---- 2 mixing


def test_period_keeps_less_than_one_block_off():
    from pricetide.llm.mixing import period

    for weights in ({"a": 1, "b": 1}, {"a": 5, "b": 3, "c": 1}, {"a": 10, **{f"s{i}": 1 for i in range(10)}}, {None: 7, "x": 2, "y": 2}):
        slots, total = period(weights), sum(weights.values())
        assert sorted(t for s in slots.values() for t in s) == list(range(total))
        for s, w in weights.items():
            for t in range(total + 1):
                assert abs(sum(x < t for x in slots[s]) - w * t / total) < 1


def test_mixing(spark, docs, odd, none):
    from pricetide.llm.mixing import mix

    rows = mix(docs, block_bytes=2000).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in docs.select("doc_id").collect())
    assert all(r["release"] <= r["slot"] < r["deadline"] for r in rows)
    slots = defaultdict(set)
    for r in rows:
        slots[r["slot"]].add((r["source"], r["block"]))
    assert all(len(s) == 1 for s in slots.values())
    assert mix(odd).count() == odd.count()
    assert mix(odd, {"a": 3, "b": 1}, 8).where("source is null").count() == 2
    assert mix(none).count() == 0


def test_mixing_follows_given_weights(spark):
    from pricetide.llm.mixing import mix

    rows = spark.range(3000).selectExpr("id as doc_id", "repeat('x', 100) as text", "if(id % 3 = 0, 'a', 'b') as source")
    placed = mix(rows, {"a": 1, "b": 3}, block_bytes=1000).groupBy("source", "block").agg({"slot": "max"}).collect()
    first = [r["source"] for r in sorted(placed, key=lambda r: r[2])]
    assert len(first) == 300
    for t in range(1, 200):
        assert abs(first[:t].count("a") - t / 4) < 1


def test_weights_may_be_any_numbers_over_0(spark):
    from pricetide.llm.mixing import mix, scheduled

    assert scheduled({"a": 0.3, "b": 0.7}) == {"a": 3, "b": 7} and scheduled({"a": 2_000_000_000, "b": 1_000_000_000}) == {"a": 2, "b": 1}
    assert scheduled({"a": 6, "b": 4}) == {"a": 3, "b": 2} and sum(scheduled({"a": 100_000, "b": 100_001}).values()) == 100_000
    third = scheduled({"a": 1 / 3, "b": 1.0})
    assert third["b"] / third["a"] == pytest.approx(3, rel=1e-4)
    rows = spark.range(300).selectExpr("null as doc_id", "repeat('x', 100) as text", "if(id % 3 = 0, 'a', 'b') as source")
    placed = mix(rows, {"a": 0.3, "b": 0.7}, block_bytes=1000).collect()
    first = [s for s, _ in sorted({(r["source"], r["slot"]) for r in placed}, key=lambda r: r[1])]
    assert len(first) == 30 and len(placed) == 300
    for t in range(1, 28):
        assert abs(first[:t].count("a") - 0.3 * t) < 1
    for bad in ({"a": 0}, {"a": -1, "b": 2}, {"a": float("nan")}, {}):
        with pytest.raises(ValueError):
            mix(rows, bad)


def test_any_number_of_sources(spark):
    from pricetide.llm.mixing import mix

    docs = spark.range(1800).selectExpr("id as doc_id", "repeat('x', 100) as text", "if(id % 2 = 0, 'hot', if(id % 299 = 1, null, concat('s', id % 299))) as source")
    for weights in (None, {"hot": 300}):
        rows = mix(docs, weights, block_bytes=200).collect()
        assert sorted(r["doc_id"] for r in rows) == list(range(1800))
        slots = defaultdict(set)
        for r in rows:
            assert r["release"] <= r["slot"] < r["deadline"]
            slots[r["slot"]].add((r["source"], r["block"]))
        assert all(len(s) == 1 for s in slots.values()) and set(slots) == set(range(len(slots)))
        assert len({r["source"] for r in rows}) == 300


def off_by(order, weights):
    """For each source the most that its blocks are off its share of the slots, at any slot."""
    total, most = sum(weights.values()), {}
    names = {s: k for k, s in enumerate(weights)}
    w = np.array(list(weights.values()), float)
    ran = np.zeros(len(w))
    worst = np.zeros(len(w))
    for t, s in enumerate(order, 1):
        ran[names[s]] += 1
        worst = np.maximum(worst, np.abs(ran - w * t / total))
    most.update(zip(weights, worst.tolist(), strict=True))
    return most


@pytest.mark.parametrize("kind", ["tail", "power", "equal"])
def test_a_thousand_sources_are_each_under_one_block_off(kind):
    """As a plain scheduler that takes sources one by one, and within every window."""
    import heapq

    from pricetide.llm.mixing import period

    weights = {"tail": {**{f"h{i}": 100 for i in range(255)}, "mid": 10, **{f"t{i}": 1 for i in range(744)}}, "power": {f"s{i}": max(1, int(3000 / (i + 1) ** 0.8)) for i in range(1000)}, "equal": {f"s{i}": 3 for i in range(1000)}}[kind]
    found, total = period(weights), sum(weights.values())
    order = [None] * total
    for s, slots in found.items():
        assert len(slots) == weights[s] == len(set(slots)) and all(q * total // weights[s] <= t < -(-(q + 1) * total // weights[s]) for q, t in enumerate(slots))
        for t in slots:
            order[t] = s
    assert None not in order and max(off_by(order, weights).values()) < 1
    jobs = sorted((q * total // w, -(-(q + 1) * total // w), w, s) for s, w in weights.items() for q in range(w))
    ready, plain, at = [], [], 0
    for t in range(total):
        while at < len(jobs) and jobs[at][0] <= t:
            heapq.heappush(ready, jobs[at][1:])
            at += 1
        plain.append(heapq.heappop(ready)[0])
    due = {t: -(-(q + 1) * total // weights[s]) for s, slots in found.items() for q, t in enumerate(slots)}
    assert [due[t] for t in range(total)] == plain  # blocks of one deadline change places only


def test_phases_are_bounded_and_go_on_in_proportion(spark, monkeypatch):
    from pricetide.llm import mixing

    rng = np.random.default_rng(8)
    w, b = rng.integers(1, 60, 3000), rng.integers(1, 5000, 3000)
    plan = mixing.phases(w, b, np.ones(3000, np.int64))
    assert sum(p.slots for p in plan) <= 1.1 * mixing.STEPS and any(p.shared for p in plan) and plan[-1].end == max(-(-b // w)) and all(x.end == y.first and y.start == x.start + (x.end - x.first) * x.slots for x, y in zip(plan, plan[1:]))
    docs = spark.range(4000).selectExpr("id as doc_id", "repeat('x', 100) as text", "concat('s', cast(pow(id % 1000, 2) / 9000 as int)) as source")
    for steps, most in ((mixing.STEPS, 1), (3000, 8)):
        monkeypatch.setattr(mixing, "STEPS", steps)
        rows = mixing.mix(docs, block_bytes=200).collect()
        at = {(r["source"], r["block"]): (r["release"], r["slot"], r["deadline"]) for r in rows}
        order = [s for s, _ in sorted(at, key=lambda k: at[k][1])]
        assert sorted(x[1] for x in at.values()) == list(range(len(at))) and all(a <= b < c for a, b, c in at.values())
        size = Counter(order)
        shares = {s: (n * 100.0) ** mixing.POWER for s, n in Counter(r["source"] for r in rows).items()}
        values, at_value, n = np.unique(list(shares.values()), return_inverse=True, return_counts=True)
        whole = dict(zip(shares, mixing.whole_numbers(values, n, max(1000, 4 * len(shares)))[at_value].tolist()))
        last = {s: max(t for t, x in enumerate(order) if x == s) for s in size}
        first_end = min(last.values())
        assert max(off_by(order[:first_end], whole).values()) < 1
        names = list(size)  # at every slot, also when sources have ended: against all sources' steady work in proportion
        w, b = np.array([whole[s] for s in names], float), np.array([size[s] for s in names], float)
        ends = np.sort(b / w)
        work = np.array([np.minimum(b, w * v).sum() for v in ends])
        ran, worst = dict.fromkeys(names, 0), 0.0
        for t, s in enumerate(order, 1):
            ran[s] += 1
            v = np.interp(t, np.concatenate([[0.0], work]), np.concatenate([[0.0], ends]))
            worst = max(worst, np.abs(np.array(list(ran.values())) - np.minimum(b, w * v)).max())
        assert worst < most + 1e-9


def test_mixed_order_keeps_rows(spark, odd):
    from pricetide.llm.mixing import mixed_order

    out = mixed_order(odd)
    assert out.columns == odd.columns
    assert out.exceptAll(odd).count() == 0 and odd.exceptAll(out).count() == 0


# ---- 3 language


def test_language(spark, docs, odd, none):
    from pricetide.llm import language_id as li

    found = {r["doc_id"]: r for r in li.with_language(docs).collect()}
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    assert all(found[i]["held_out"] == (crc(i) % 4 == 2) for i in truth)
    held = [i for i in truth if found[i]["held_out"]]
    assert sum(found[i]["lang_pred"] == truth[i] for i in held) >= 0.95 * len(held)
    strange = {(r["doc_id"], r["lang_pred"], r["score"] > 0) for r in li.with_language(odd).collect()}
    assert {(3, "und", False), (4, "und", False), (7, "und", False), (9, "und", False)} <= strange
    assert li.with_language(none).count() == 0
    kept = li.reject_unidentified(odd)
    assert kept.columns == odd.columns and not {3, 4, 7, 9} & {r["doc_id"] for r in kept.collect()}


def test_language_scores_are_those_of_one_pass(monkeypatch):
    """Stretches of a long text add up to the sum over all its n-grams."""
    from pricetide.llm import language_id as li

    rng = np.random.default_rng(1)
    table = np.log(rng.dirichlet(np.ones(li.BUCKETS), 2))
    texts = ["".join(rng.choice(list("abc é"), 5000)), "", None, "xy", "Straße"]
    whole = li.score(texts, ["p", "q"], table)
    monkeypatch.setattr(li, "STRETCH", 37)
    parts = li.score(texts, ["p", "q"], table)
    assert whole[0] == parts[0] and np.allclose(whole[1], parts[1])


def plain_bayes(rows):
    """doc -> (language, score): n-grams counted one by one, with the bucket of each worked out in whole numbers."""
    from pricetide.llm.language_id import ALPHA, BUCKETS, ENOUGH

    def buckets(text):
        points = [ord(c) if c.isalpha() else 32 for c in text.lower()] + [32, 32]
        for i in range(len(points) - 2):
            h = points[i] * 0x9E3779B1 % 2**32
            for n in (2, 3):
                h = (h ^ h >> 15 ^ points[i + n - 1]) * (0x85EBCA77 + 2 * n) % 2**32
                yield h >> 17 & BUCKETS - 1

    counts = defaultdict(Counter)
    for i, text, lang in rows:
        if lang is not None and text and crc(i) % 4 != 2:
            counts[lang].update(buckets(text))
    sums = {lang: sum(c.values()) + ALPHA * BUCKETS for lang, c in counts.items()}
    out = {}
    for i, text, _ in rows:
        found = list(buckets(text)) if text else []
        if not any(c.isalpha() for c in text or "") or not counts:
            out[i] = ("und", 0.0)
            continue
        odds = {lang: sum(math.log((c[h] + ALPHA) / sums[lang]) for h in found) * min(1, ENOUGH / len(found)) for lang, c in counts.items()}
        best = min(odds, key=lambda lang: (-odds[lang], lang))
        out[i] = (best, 1 / sum(math.exp(o - odds[best]) for o in odds.values()))
    return out


def test_language_query_against_plain_bayes(spark, tmp_path):
    from pricetide.llm.language_id import op3_language_id

    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 1500").limit(70)
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]
    rows += [(9001, None, "en"), (9002, "", "en"), (9003, "12 !?", None), (9004, "Ünïcode ß text", None), (9005, "a", "xx")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    want = plain_bayes(rows)
    found = op3_language_id(spark, str(tmp_path)).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r["held_out"] == (crc(r["doc_id"]) % 4 == 2) and r["lang_pred"] == want[r["doc_id"]][0] and r["score"] == pytest.approx(want[r["doc_id"]][1], abs=1e-9)


def test_more_languages_than_a_group(spark):
    from pricetide.llm import language_id as li

    def text(k):
        a, b = divmod(k, 10)
        return " ".join(f"{chr(0x61 + a)}{chr(0x430 + b)}{chr(0x3B1 + a)}" for _ in range(30))

    table = spark.createDataFrame([(i, text(i % 70), f"l{i % 70:02}") for i in range(700)], "doc_id long, text string, lang string")
    found = {r["doc_id"]: r["lang_pred"] for r in li.with_language(table).collect()}
    assert all(found[i] == f"l{i % 70:02}" for i in range(700))


def test_without_languages_texts_with_letters_stay(spark):
    from pricetide.llm import language_id as li

    table = spark.createDataFrame([(1, "some words", None), (2, "12 !!", None), (3, None, None), (4, "été", None)], "doc_id long, text string, lang string")
    assert sorted(r["doc_id"] for r in li.reject_unidentified(table).collect()) == [1, 4]


# ---- 4 toxicity


def tfidf(counts, idf):
    """Unit vectors as rows of a dense matrix."""
    w = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0.0) * idf
    return w / np.maximum(np.sqrt((w * w).sum(1, keepdims=True)), 1e-300)


@pytest.mark.parametrize("power, words", [(1, 9), (4, 30), (9, 60)])
def test_block_max_search_is_exact(power, words, monkeypatch):
    from pricetide.llm import toxicity as tx

    monkeypatch.setattr(tx, "FIRST", 1)
    monkeypatch.setattr(tx, "FREQUENT", 40)
    rng = np.random.default_rng(5)
    idf, counts = rng.random(400) ** power * 9 + 0.1, np.zeros((900, 400), np.int64)
    often = rng.permutation(400) ** 2.0 + 1
    for row in counts:
        np.add.at(row, rng.choice(400, rng.integers(1, words), p=often / often.sum()), 1)
    counts[700:720] = counts[3]  # ties
    rows = [(np.flatnonzero(c), c[c > 0]) for c in counts]
    index = tx.Index(idf, rows, rng.permutation(900), rng.integers(0, 2, 900), 0.1)
    assert 0 < len(index.whole) < 400
    dense = tfidf(counts, idf)
    for but in (None, list(range(64))):
        for i, (found, cosine) in enumerate(index.nearest(rows[:64], but=but)):
            cosines = dense @ dense[i]
            if but:
                cosines[i] = 0
            want = np.lexsort((index.ids, -np.round(cosines, 12)))[:15]
            want = want[cosines[want] > 0]
            assert index.named[found].tolist() == index.ids[want].tolist() and np.allclose(cosine, cosines[want])


def test_search_holds_the_lists_of_one_text_at_a_time():
    """What 64 texts' lists add up to is gone through text by text, not as arrays of all of them (which ran out of the cache and cost most of the scoring)."""
    import tracemalloc

    from pricetide.llm import toxicity as tx

    rng = np.random.default_rng(3)
    rows = [(np.sort(rng.choice(3000, 150, replace=False)), np.ones(150, np.int64)) for _ in range(1500)]
    index = tx.Index(rng.random(3000) + 0.1, rows, np.arange(1500), np.zeros(1500), 0.1)
    assert not len(index.whole)
    entries = 64 * 150 * 75  # of the lists of all texts, about
    tracemalloc.start()
    found = index.nearest(rows[:64])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert all(places[0] == index.place[i] for i, (places, _) in enumerate(found))
    assert peak < entries * 8


def test_votes_of_one_mind_are_one_vote():
    """However near the neighbours are, all of one label vote the same to the last bit."""
    from pricetide.llm import toxicity as tx

    index = tx.Index(np.ones(20), [(np.array([i]), np.array([1])) for i in range(20)], np.arange(20), np.ones(20), 0.1)
    rng = np.random.default_rng(2)
    assert {index.vote(np.arange(tx.NEIGHBOURS), rng.random(tx.NEIGHBOURS)) for _ in range(500)} == {1.0}


def test_words_lead_to_their_beginnings_by_number():
    from pricetide.llm import toxicity as tx

    vocabulary = {t: i for i, t in enumerate(["wunderbar", "wunde*", "wunder", "kurz", "haus", "hausb*", "allein_stehend", "élève*"])}
    begins = tx.beginnings(vocabulary)
    for text in ("Wunderbar wunder WUNDE kurz kurz hausbau hausboot haus", "allein_stehend élèvent élève unbekannt", "wunderlich " * 5, "!!", "", None):
        at, counts = tx.vector(text, vocabulary, begins)
        want = Counter(i for i in map(vocabulary.get, tx.terms(text)) if i is not None)
        assert list(zip(at.tolist(), counts.tolist(), strict=True)) == sorted(want.items())


def test_whole_toxicity_query_against_brute_force(spark, tmp_path):
    """Fold, space, weights, neighbours, leave-one-out votes, calibration and score, each worked out plainly; labels repeat or are null."""
    from pricetide.llm import toxicity as tx

    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in range(40)] + ["idiot", "scheusal"]
    texts = {i: " ".join(rng.choice(words[:40], 12)) + (f" {rng.choice(words[40:])}" if i % 4 == 0 else "") for i in range(160)}
    texts |= {160: "", 161: None, 162: "unseen nothing"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, int(i % 4 == 0)) for i in range(100)] + [(8, 0), (None, 1), (9, None)]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    learned = {i: y for i, y in labels[:100] if crc(i) % 5 != 0 and texts[i]}
    seen = {i: set(tx.terms(texts[i])) for i in learned}
    space = sorted({t for ts in seen.values() for t in ts if sum(t in o for o in seen.values()) > 1})
    half = {r[0]: r[1] for r in spark.range(200).selectExpr("id", "pmod(xxhash64(id, 11), 2)").collect()}

    def weights(of):
        """Of each term, from the labels of some documents."""
        n, n1, out = len(of), sum(learned[i] for i in of), []
        for t in space:
            a, b = (sum(t in seen[i] for i in of if learned[i] == y) for y in (0, 1))
            some = max(a + b, 1)
            chi2 = n * (b * (n - n1 - a) - a * (n1 - b)) ** 2 / ((n - n1) * n1 * some * max(n - some, 1))
            out.append(math.log((1 + n) / some) * max(math.sqrt(chi2), tx.LEAST_TIE))
        return np.array(out)

    counts = {i: np.array([tx.terms(t).count(w) for w in space]) for i, t in texts.items()}
    ids = sorted(learned)
    spaces = {h: weights([i for i in ids if h is None or half[i] != h]) for h in (0, 1, None)}
    examples = {h: tfidf(np.array([counts[i] for i in ids]), w) for h, w in spaces.items()}

    def vote(i, h=None):
        cosines = examples[h] @ tfidf(counts[i][None], spaces[h])[0]
        near = [(-round(c, 12), j, c) for j, c in zip(ids, cosines, strict=True) if c > 0]
        return sorted(near)

    def voted(near):
        near = near[: tx.NEIGHBOURS]
        w = [1 / (1.05 - min(c, 1)) for _, _, c in near]
        none = (tx.NEIGHBOURS - len(near)) / 1.05
        return (sum(x * learned[j] for x, (_, j, _) in zip(w, near, strict=True)) + none * 0.02) / (sum(w) + none)

    alone = [voted([r for r in vote(i, half[i]) if r[1] != i]) for i in ids]  # weights of the other half
    steps = tx.isotonic(np.array([*alone, 0.02]), np.array([*[learned[i] for i in ids], 0.02]), np.ones(len(ids) + 1))
    rows = {r["doc_id"]: r for r in tx.op4_toxicity(spark, str(tmp_path)).collect()}
    assert set(rows) == set(texts)
    for i, r in rows.items():
        near = vote(i)
        assert r["held_out"] == (crc(i) % 5 == 0) and r["evidence"] == [j for _, j, _ in near[: tx.NEIGHBOURS]]
        assert r["score"] == pytest.approx(float(np.interp(voted(near), *steps)), abs=1e-9) and r["predicted"] == int(r["score"] >= 0.5)
    held = [i for i in range(160) if crc(i) % 5 == 0]
    assert sum(rows[i]["predicted"] == int(i % 4 == 0) for i in held) >= 0.9 * len(held)


def test_toxicity(spark, docs, odd, none):
    from pricetide.llm import toxicity as tx

    texts = [(i, f"das ist {'ein idiot' if i % 5 == 0 else 'gut'} wort{i % 7}", ) for i in range(300)]
    table = spark.createDataFrame(texts, "doc_id long, text string")
    labels = table.selectExpr("doc_id", "cast(doc_id % 5 = 0 as int) as toxic")
    model = tx.fit(table, labels.where("doc_id < 200"))
    rows = tx.score_documents(table, model).collect()
    assert all(r["predicted"] == int(r["doc_id"] % 5 == 0) and 0 <= r["score"] <= 1 for r in rows)
    assert all(r["evidence"] for r in rows if r["predicted"])
    assert tx.score_documents(odd, model).count() == odd.count()
    assert {r["predicted"] for r in tx.score_documents(odd, model).where("doc_id in (3, 4)").collect()} == {0}
    empty = tx.fit(none, labels.where("false"))
    assert tx.score_documents(odd, empty).count() == odd.count()
    assert tx.score_documents(none, model).count() == 0


def test_toxicity_of_words_that_clean_texts_have_too(spark):
    """Neither word passes for toxic (40 of 100 texts that have it are), both together are; no labelled text is left out."""
    from pricetide.llm import toxicity as tx

    def text(i):
        said = "mist kerl" if i % 25 == 0 else "mist" if i % 25 in (1, 2) else "kerl" if i % 25 in (3, 4) else ""
        return f"das {said} wort{i % 7} satz{i % 11} ende{i % 13}"

    table = spark.createDataFrame([(i, text(i)) for i in range(1500)], "doc_id long, text string")
    labels = table.selectExpr("doc_id", "cast(doc_id % 25 = 0 as int) as toxic")
    vocabulary, index = tx.fit(table, labels.where("doc_id < 1000"))
    assert {"mist", "kerl", "das", "wort1"} <= vocabulary.keys() and sorted(index.ids) == list(range(1000))
    rows = tx.score_documents(table.where("doc_id >= 1000"), (vocabulary, index)).collect()
    assert all(r["predicted"] == int(r["doc_id"] % 25 == 0) for r in rows)


# ---- 5 exact copies


def test_exact_groups(spark, docs, odd, none):
    from pricetide.llm.exact_dedup import drop_copies, exact_groups

    for table in (docs, odd):
        rows = table.select("doc_id", "text").collect()
        groups = defaultdict(list)
        for r in rows:
            groups[r["text"] or ""].append(-1 if r["doc_id"] is None else r["doc_id"])
        want = sorted((i, max(g), len(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g)
        found = exact_groups(table).collect()
        assert sorted((-1 if r["doc_id"] is None else r["doc_id"], -1 if r["keep_id"] is None else r["keep_id"], r["group_size"], r["text_sha256"]) for r in found) == want
        assert sum(r["kept"] for r in found) == len(groups)
        left = drop_copies(table)
        assert left.columns == table.columns and left.count() == len(groups)
    assert exact_groups(none).count() == 0


def test_exact_groups_split_on_late_bytes(spark, tmp_path):
    from pricetide.llm.exact_dedup import exact_groups

    start = "y" * 70_000
    texts = [start, start + "a", start + "b", start + "a", start[:64], start[:64], start[:63], start[:1088], start[:1087]]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    found = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_groups(spark.read.parquet(str(tmp_path / "d"))).collect()}
    assert found == {0: (0, 1), 1: (3, 2), 3: (3, 2), 2: (2, 1), 4: (5, 2), 5: (5, 2), 6: (6, 1), 7: (7, 1), 8: (8, 1)}


# ---- 6 near copies

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    if len(words) < width:
        return {tuple(words)} if words else set()
    return set(zip(*[words[k:] for k in range(width)], strict=False))


def near(rows, width):
    sets = [shingles(t, width) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in product(range(len(rows)), repeat=2):
        if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    least = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        least[find(i)].append(doc)
    return sorted((doc if doc is not None else -1, len(sets[i]), min((d for d in least[find(i)] if d is not None), default=-1)) for i, (doc, _) in enumerate(rows))


def test_near_groups(spark, docs, odd, none, tmp_path):
    from pricetide.llm.near_dedup import drop_near_copies, near_groups

    words = np.random.default_rng(2).choice([f"w{i}" for i in range(3000)], 120).tolist()
    rows = []
    for i in range(60):
        own = words.copy()
        own[(i * 2) % 120] = f"x{i}"
        rows.append((i, " ".join(own)))
    rows += [(100 + i, " ".join(words[:40] + [f"z{i}_{k}" for k in range(40)])) for i in range(30)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "d"))
    for table in (docs, odd, spark.read.parquet(str(tmp_path / "d"))):
        plain = [(r["doc_id"], r["text"]) for r in table.select("doc_id", "text").collect()]
        found = near_groups(table, width=4).collect()
        assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_shingles"], r["component_id"] if r["component_id"] is not None else -1) for r in found) == near(plain, 4)
    left = drop_near_copies(odd)
    assert left.columns == odd.columns and left.count() == sum(r["kept"] for r in near_groups(odd).collect())
    assert near_groups(none).count() == 0


def test_collisions_skip_only_what_cannot_reach():
    from pricetide.llm.near_dedup import COORDINATES, collisions

    rng = np.random.default_rng(7)
    left, right = rng.integers(0, 3, (500, COORDINATES)), rng.integers(0, 3, (500, COORDINATES))
    right[::5] = left[::5]
    right[::5, 20:40] = -1
    count = (left == right).sum(1)
    assert collisions(left, right, 24).tolist() == np.where(count >= 24, count, -1).tolist()


def test_tiny_sets_are_linked(spark, tmp_path):
    """Texts of 1 to 20 shingles, each with a copy that lacks or adds up to a fifth of them: none of the links is lost."""
    from pricetide.llm.near_dedup import near_groups

    rng, rows = np.random.default_rng(12), []
    for i in range(1200):
        n = int(rng.integers(1, 21))
        words = [f"w{i}_{k}" for k in range(n + 3)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join([*words, *[f"x{i}_{k}" for k in range(int(rng.integers(0, n // 4 + 2)))]]))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    found = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_groups(spark.read.parquet(str(tmp_path / "d")), width=4).collect())
    want = []
    for (i, x), (j, y) in zip(rows[::2], rows[1::2], strict=True):
        sets = shingles(x, 4), shingles(y, 4)
        alike = 100 * len(sets[0] & sets[1]) >= 80 * len(sets[0] | sets[1])
        want += [(i, len(sets[0]), i), (j, len(sets[1]), i if alike else j)]
    assert found == want and sum(c != d for d, _, c in want) > 500


def test_components(spark):
    from pricetide.llm.near_dedup import components

    path = [(i, i + 1) for i in range(100, 140)] + [(7, 3), (7, 9), (3, 9), (1000, 5)]
    found = {r["uid"]: r["root"] for r in components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert found == {**dict.fromkeys(range(100, 141), 100), 3: 3, 7: 3, 9: 3, 5: 5, 1000: 5}


def test_long_documents_have_the_same_shingles(monkeypatch):
    import pyarrow as pa

    from pricetide.llm import shingles as sh

    texts = pa.array(["A b\tc d  e f", None, "", "one", " ".join(f"w{i % 50}" for i in range(500)), "x " * 30])
    whole = [(sh.distinct(w, c, 4)) for _, w, c in sh.groups(texts)]
    monkeypatch.setattr(sh, "SLICE", 16)
    parts = [(sh.distinct(w, c, 4)) for _, w, c in sh.groups(texts)]
    assert np.array_equal(np.concatenate([h for h, _ in whole]), np.concatenate([h for h, _ in parts]))
    assert np.concatenate([n for _, n in parts]).tolist() == [len(shingles(t, 4)) for t in texts.to_pylist()]


# ---- 7 packing


def test_bounds_are_optimal():
    from itertools import combinations

    from pricetide.llm.packing import best_bounds

    def waste(bounds, largest, count):
        return int(((np.array(sorted(bounds))[np.searchsorted(sorted(bounds), largest)] - largest) * count).sum())

    rng = np.random.default_rng(3)
    for n, buckets in ((1, 3), (5, 2), (9, 3), (8, 8), (12, 4)):
        largest, count = np.sort(rng.choice(100, n, replace=False)), rng.integers(1, 9, n)
        ways = (waste({*some, largest[-1]}, largest, count) for k in range(min(buckets, n)) for some in combinations(largest.tolist(), k))
        bounds = best_bounds(largest, count, buckets)
        assert len(bounds) <= buckets and waste(bounds, largest, count) == min(ways)
    largest, count = np.sort(rng.choice(10**6, 700, replace=False)), rng.integers(1, 1000, 700)
    cost = largest * np.cumsum(count) - np.cumsum(largest * count)  # the plain programme: every cut of every stretch
    docs, total = np.concatenate([[0], np.cumsum(count)]), np.concatenate([[0], np.cumsum(largest * count)])
    for _ in range(7):
        cost = np.array([min([cost[j], *(cost[:j] + largest[j] * (docs[j + 1] - docs[1 : j + 1]) - (total[j + 1] - total[1 : j + 1]))]) for j in range(700)])
    assert waste(best_bounds(largest, count, 8), largest, count) == cost[-1]


def test_packing(spark, docs, odd, none):
    from pricetide.llm.packing import pack

    for table, stored in ((docs, False), (docs, True), (odd, False), (odd, True), (odd.withColumn("k", odd.doc_id), True)):
        rows = pack(table, budget=20_000, stored_order=stored).collect()
        assert len(rows) == table.count()
        batches = defaultdict(list)
        for r in rows:
            assert 0 <= r["padding"] == r["bound"] - r["n_tokens"]
            batches[r["bucket"], r["batch"]].append(r)
        for b in batches.values():
            assert sorted(r["place"] for r in b) == list(range(len(b)))
            assert len(b) == 1 or sum(r["bound"] for r in b) <= 20_000
    assert pack(none).count() == 0


# ---- 8 sharding


def same_rows(a, b):
    return a.columns == b.columns and a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_compaction(spark, docs, odd, none, tmp_path):
    from pricetide.llm.sharding import CommitConflict, ShardStore, shard_documents

    store = ShardStore(spark, str(tmp_path / "s"), docs.schema, target_bytes=200_000)
    for k in range(6):
        store.append(docs.where(f"doc_id % 6 = {k}").coalesce(2))
    n = store.manifest().count()
    newest = store.compact()
    assert store.manifest().count() < n and newest == store.version() > 6
    assert same_rows(store.read(3), docs.where("doc_id % 6 < 3"))
    assert store.vacuum() == 0 and store.vacuum(0) > 0
    assert same_rows(store.read(), docs)
    with pytest.raises(CommitConflict):
        store._commit(store.manifest(), store.version())
    for r in store.manifest().collect():  # what the manifest says is what stands in the files, and no tier is due
        file = tmp_path / "s" / r["shard"]
        assert file.stat().st_size == r["bytes"] and spark.read.parquet(str(file)).count() == r["rows"]
    small = Counter(r["tier"] for r in store.manifest().where("bytes < 100000").collect())
    assert all(c < store.fanout for c in small.values())
    for table in (odd, none):
        kept, rows = shard_documents(table)
        assert rows.count() == table.count() and same_rows(kept.read(), table)


def test_shards_keep_any_column_and_value(spark, tmp_path):
    from pricetide.llm.sharding import ShardStore

    values = ["a b", "c%d", "e/f=g", "", None, "h#é"]
    rows = [(i, values[i % 6], f"s{i}", i, i, f"m{i}") for i in range(60)]
    table = spark.createDataFrame(rows, "doc_id long, source string, shard string, merge long, arrival long, _metadata string")
    store = ShardStore(spark, str(tmp_path / "a b"), table.schema)
    store.append(table.where("doc_id < 30"), by="source")
    assert store.manifest().count() >= 6 and same_rows(store.read(), table.where("doc_id < 30"))
    store.append(table.where("doc_id >= 30"), by="source")
    store.compact()
    assert store.manifest().count() == 1 and same_rows(store.read(), table)


def test_writers_that_race_lose_nothing(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    from pricetide.llm.sharding import CommitConflict, ShardStore

    store = ShardStore(spark, str(tmp_path / "s"), spark.range(1).schema)
    store.append(spark.range(5))

    def claim(name):
        try:
            store._claim(9, name)
        except CommitConflict:
            return 0
        return 1

    with ThreadPoolExecutor(6) as pool:
        assert sum(pool.map(claim, [c * 32 for c in "abcdef"])) == 1
        (tmp_path / "s/versions/v000000009").unlink()
        list(pool.map(lambda k: store.append(spark.range(5 * k, 5 * k + 5)), range(1, 5)))
    assert store.version() == 5 and sorted(r[0] for r in store.read().collect()) == list(range(25))


@pytest.mark.parametrize("content", ["", "0123"])
def test_dead_writers_stop_nobody(spark, tmp_path, monkeypatch, content):
    """A pointer that a writer left empty, or in part, holds the others up until it is stale, and is passed over then."""
    import os

    from pricetide.llm import sharding

    store = sharding.ShardStore(spark, str(tmp_path / "s"), spark.range(1).schema)
    store.append(spark.range(5))
    dead = tmp_path / "s/versions/v000000002"
    dead.write_text(content)
    monkeypatch.setattr(sharding, "ATTEMPTS", 2)
    before = sorted(p.name for p in (tmp_path / "s/shards").iterdir())
    with pytest.raises(sharding.CommitConflict):
        store.append(spark.range(5, 10))
    assert sorted(p.name for p in (tmp_path / "s/shards").iterdir()) == before and store.version() == 1
    os.utime(dead, (0, 0))
    assert store.append(spark.range(5, 10).coalesce(1)) == 3
    for k in range(2, 6):
        store.append(spark.range(5 * k, 5 * k + 5).coalesce(1))
    assert store.compact() == store.version() == 8 and sorted(r[0] for r in store.read().collect()) == list(range(30))
    assert sorted(r[0] for r in store.read(3).collect()) == list(range(10))


def test_killed_writer_leaves_shards_that_vacuum_removes(spark, tmp_path, monkeypatch):
    from pricetide.llm.sharding import ShardStore

    store = ShardStore(spark, str(tmp_path / "s"), spark.range(1).schema)
    store.append(spark.range(5))

    def die(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(ShardStore, "_claim", die)
        with pytest.raises(KeyboardInterrupt):
            store.append(spark.range(5, 10))
    assert len(list((tmp_path / "s/shards").iterdir())) == 2
    assert store.vacuum() == 0 and store.vacuum(0) > 0
    assert len(list((tmp_path / "s/shards").iterdir())) == 1
    store.append(spark.range(5, 10))
    assert sorted(r[0] for r in store.read().collect()) == list(range(10))


def test_pointers_by_rename(spark, tmp_path):
    """The way of file systems other than local disks: whole at once, never over another, nothing left beside it."""
    from concurrent.futures import ThreadPoolExecutor

    from pricetide.llm.sharding import CommitConflict, ShardStore

    store = ShardStore(spark, str(tmp_path / "s"), spark.range(1).schema)
    fs, at = store._fs(f"{store.path}/versions/v000000001")

    def claim(name):
        try:
            store._rename(fs, at, name)
        except CommitConflict:
            return None
        return name

    assert claim("a" * 32) and not claim("b" * 32) and store.version() == 1
    assert (tmp_path / "s/versions/v000000001").read_text() == "a" * 32
    with ThreadPoolExecutor(4) as pool:
        assert not any(pool.map(claim, [c * 32 for c in "cdef"]))
    assert [p.name for p in (tmp_path / "s/versions").iterdir() if not p.name.endswith(".crc")] == ["v000000001"]


# ---- 9 tokens


def test_tokens_are_those_of_the_library(spark, docs, odd, none):
    import public_tokenizers
    import sentencepiece

    from pricetide.llm.token_counts import Counter as Tokens
    from pricetide.llm.token_counts import count_tokens, load_ranks

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    for table in (docs, odd):
        texts = {(r["doc_id"], len((r["text"] or "").encode()), len(library.encode(r["text"] or ""))) for r in table.select("doc_id", "text").collect()}
        assert {(r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in count_tokens(table).collect()} == texts
    assert count_tokens(none).count() == 0
    tokens, rng = Tokens(load_ranks(path)), np.random.default_rng(4)
    letters = list("ab é▁  \n\t<s>.,0123²the in​①𝔘")
    for _ in range(3000):
        text = "".join(rng.choice(letters, rng.integers(0, 40)))
        assert tokens.count(text) == len(library.encode(text)), repr(text)


# ---- 10 neighbours


def test_nearest(spark):
    from pricetide.llm.nearest import nearest

    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=16).astype(float).tolist()) for i in range(600)]
    rows += [(600 + i, rows[50][1]) for i in range(40)]
    rows += [(700, None), (701, [0.0] * 16), (702, [float("nan")] * 16), (703, [None, *[1.0] * 15]), (704, [float("inf")] * 16), (705, [1.0] * 3), (None, [1.0] * 16), (750, rows[3][1])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = defaultdict(list)
    for r in nearest(table).orderBy("query_id", "rank").collect():
        found[r["query_id"]].append((r["vec_id"], r["score"]))
    fine = {i: np.array(v) for i, v in rows if i is not None and (i < 700 or i == 750)}
    hits = total = 0
    for q in (i for i in fine if i % 50 == 0):
        cosines = sorted((-(fine[q] @ v) / np.linalg.norm(v) / np.linalg.norm(fine[q]), i) for i, v in fine.items() if i != q)
        hits += len({i for i, _ in found[q]} & {i for _, i in cosines[:5]})
        total += 5
        assert len(found[q]) == 5 and all(s == pytest.approx(fine[q] @ fine[i] / np.linalg.norm(fine[i]) / np.linalg.norm(fine[q])) for i, s in found[q])
    assert hits >= 0.9 * total
    assert [i for i, _ in found[50]] == [600, 601, 602, 603, 604]
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<double>")
    assert nearest(few).count() == 2
    assert nearest(few.where("false")).count() == 0


def test_nearest_keeps_every_row(spark, tmp_path):
    """Vectors of other lengths search among their own, rows that repeat a vec_id are candidates, and huge and tiny components are exact."""
    from pricetide.llm.nearest import op10_nearest

    rng = np.random.default_rng(11)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(120)] + [(1000 + i, rng.normal(size=3).tolist()) for i in range(60)]
    rows += [(7, rows[50][1]), (50, rows[9][1]), (2000, [2.0**-660 * x for x in rows[0][1]]), (2001, [2.0**660 * x for x in rows[0][1]]), (2002, [5e-324] + [0.0] * 7), (2003, [1.7e308] * 8)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))

    def unit(v):
        v = np.array(v) / np.abs(v).max()
        return v / np.sqrt(v @ v)

    want = []
    for a, (q, v) in enumerate(rows):
        if q % 50 == 0:
            near = sorted((-round(float(unit(v) @ unit(w)), 12), i, b) for b, (i, w) in enumerate(rows) if b != a and len(w) == len(v))[:5]
            want += [(q, r + 1, i, -s) for r, (s, i, _) in enumerate(near)]
    found = sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in op10_nearest(spark, str(tmp_path)).collect())
    assert found == sorted((q, r, i, round(s, 9)) for q, r, i, s in want)


def test_recall_on_vectors_without_clusters(spark):
    """The hardest case: random directions of 48 dimensions, where the nearest of 4,000 are hardly nearer than the rest."""
    from pricetide.llm.nearest import nearest

    x = np.random.default_rng(14).normal(size=(4000, 48))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    unit, hits = x / np.linalg.norm(x, axis=1, keepdims=True), 0
    for r in nearest(table, again=40).groupBy("query_id").agg({"vec_id": "collect_list"}).collect():  # a hundredth of the rows
        cosines = unit @ unit[r[0]]
        cosines[r[0]] = -2
        hits += len(set(r[1]) & set(np.argsort(-cosines)[:5].tolist()))
    assert hits >= 0.9 * 400


def test_beam_search_does_not_lose_to_greedy():
    from pricetide.llm.nearest import encode, learn

    x = np.random.default_rng(8).normal(size=(400, 8))
    books = learn(x, books=3, entries=16)
    off = [((x - sum(b[encode(x, books, beam)[:, m]] for m, b in enumerate(books))) ** 2).sum() for beam in (1, 8)]
    assert off[1] <= off[0]


# ---- pipeline


def test_pipeline_by_stage(spark, tmp_path):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = [r for r in docs.select("doc_id", "text").collect()]
    for k, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(k)))
        if k < len(cp.STAGES) - 1:
            assert out.columns == docs.columns
        docs = spark.read.parquet(str(tmp_path / str(k)))
        ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
        if name == "language ID":
            want = {r["doc_id"] for r in kept if any(c.isalpha() for c in r["text"] or "")}
            assert ids == want
        elif name == "exact dedup":
            want = set({r["text"]: r["doc_id"] for r in sorted(kept, key=lambda r: r["doc_id"])}.values())
            assert ids == want
        elif name == "near dedup":
            assert ids == {c for _, _, c in near([(r["doc_id"], r["text"]) for r in kept], 5)}
        else:
            assert ids == {r["doc_id"] for r in kept}
        kept = [r for r in kept if r["doc_id"] in ids]


def test_pipeline_on_odd_and_empty_tables(spark, odd, none, tmp_path):
    """Nulls, empty, long and repeated texts, ids that repeat or are null, no rows at all, through all stages together."""
    import corpus_pipeline as cp

    for name, table in (("odd", odd), ("none", none)):
        table.write.parquet(str(tmp_path / name / "documents.parquet"))
        rows = cp.run(spark, str(tmp_path / name)).collect()
        assert len({(r["bucket"], r["batch"], r["place"]) for r in rows}) == len(rows)
        lettered = [(r["doc_id"], r["text"]) for r in table.select("doc_id", "text").collect() if any(c.isalpha() for c in r["text"] or "")]
        last = {}
        for i, t in sorted(lettered, key=lambda r: -1 if r[0] is None else r[0]):
            last[t] = i
        groups = near([(i, t) for t, i in last.items()], 5)
        alone = {r[0] for r in groups if r[0] == r[2]}
        assert {-1 if r["doc_id"] is None else r["doc_id"] for r in rows} == alone and len(rows) == len(alone)


def test_blocks_find_what_stars_find(spark, docs, monkeypatch):
    """Without stars, all links come from the lists, block against block, one for two components first: the same components."""
    from pricetide.llm import near_dedup as nd

    monkeypatch.setattr(nd, "BLOCK", 4)
    monkeypatch.setattr(nd, "AT_ONCE", 5)
    monkeypatch.setattr(nd, "collided", lambda pairs, reps, matches: pairs.where("false").select("a", "b"))
    plain = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in nd.near_groups(docs, width=4).collect()) == near(plain, 4)


def test_scratch_is_deleted(spark):
    from pricetide.llm import common

    path = common.scratch(spark, "x")
    kept = common.materialize(spark.range(3), "y")
    assert kept.count() == 3 and path.startswith(spark.conf.get('spark.checkpoint.dir'))
    common.clean_scratch(spark)
    assert common.materialize(spark.range(3), "y").count() == 3
