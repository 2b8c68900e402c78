"""Added personal-data spans on planted, labelled texts: precision and recall by kind."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from tests.llm.test_operators import base_spans


def luhn(digits):
    return digits + str(-sum(x if k % 2 else x * 2 - 9 * (x > 4) for k, x in enumerate(map(int, reversed(digits)))) % 10)


def planted(seed=9, each=250):
    """(text, kind, the span that should be found or None) for texts of many forms; strict forms are left to the base."""
    rng = random.Random(seed)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda n=6: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    token = lambda n: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n - 4)) + "a7Z9"
    forms = {
        "email": [lambda: ("write to ", f"{word()} (at) {word()} (dot) com", " please"), lambda: ("mail me: ", f"{word()}[at]{word()}.org", "")],
        "phone": [lambda: ("call ", f"0{digits(3)} {digits(3)} {digits(4)}", " today"), lambda: ("tel. ", f"({digits(3)}) {digits(3)}-{digits(4)}", " office")],
        "secret": [lambda: ('api_key = "', token(rng.choice([20, 40, 64])), '" here'), lambda: ("token: ", token(rng.choice([270, 400, 1000])), " end")],
        "card": [lambda: ("card ", (lambda c: f"{c[:4]}.{c[4:8]}.{c[8:12]}.{c[12:]}")(luhn("4" + digits(14))), " visa")],
        "ip": [lambda: ("server ip ", f"{rng.randint(1, 255)} . {rng.randint(0, 255)} . {rng.randint(0, 255)} . {rng.randint(0, 255)}", " up")],
    }
    clean = [
        lambda: f"version {rng.randint(1, 9)}.{digits(2)}.{digits(3)}.{digits(2)} released",
        lambda: f"build {digits(2)}.{digits(3)}.{digits(3)}.{digits(4)} is out",
        lambda: f"released as v{digits(2)}.{digits(4)}.{digits(3)}",
        lambda: f"order {digits(3)}-{digits(4)}-{digits(4)} shipped",
        lambda: f"on {rng.randint(1990, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)} 12.30 it rained",
        lambda: f"see {word()}-{word()}-{word()}-{word()} there",
        lambda: f"the code {digits(16)} was printed" if rng.random() < 0.5 else f"the code {digits(4)}.{digits(4)}.{digits(4)}.{digits(4)} was printed",
        lambda: f"about {digits(1)},{digits(3)},{digits(3)} people",
        lambda: f"ISBN {digits(3)}-{digits(2)}-{digits(3)}-{digits(4)} in print",
        lambda: f"{word()} {word(20)} {word()}.",
    ]
    strict = [lambda: f"mail {word()}@{word()}.com now", lambda: f"call +{digits(2)} {digits(3)} {digits(4)} {digits(3)} now", lambda: f"from host 10.{rng.randint(0, 255)}.{rng.randint(0, 255)}.{rng.randint(0, 255)}", lambda: f"card {luhn('5' + digits(14))} charged"]
    rows = []
    for kind, makers in forms.items():
        for make in makers:
            for _ in range(each // 2):
                before, hit, after = make()
                rows.append((before + hit + after, kind, (len(before), len(before) + len(hit))))
    rows += [(make(), None, None) for make in clean for _ in range(each // 2)] + [(make(), "base", None) for make in strict for _ in range(each // 2)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def measured(spark, tmp_path_factory):
    from pricetide.llm import pii

    rows, path = planted(), str(tmp_path_factory.mktemp("planted") / "d")
    spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "doc_id long, text string").repartition(3).write.parquet(path)
    found = {r["doc_id"]: [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in r["spans"].split(",") if s)] for r in pii.personal_data(spark.read.parquet(path)).collect()}
    return rows, found


def test_precision_and_recall_of_added_spans(measured):
    rows, found = measured
    want, right, added, wrong = Counter(), Counter(), Counter(), []
    for i, (text, kind, span) in enumerate(rows):
        if kind == "base":
            continue
        want[kind] += span is not None
        given = set(base_spans(text))
        for k, a, b in found[i]:
            if (k, a, b) in given:  # fixed by contract
                continue
            added[k] += 1
            good = span is not None and k == kind and a <= span[0] + 1 and b >= span[1] - 1 and b - a <= span[1] - span[0] + 2
            right[k] += good
            if not good:
                wrong.append((text[:60], k, text[a:b][:40]))
    precision, recall = {k: right[k] / added[k] for k in added}, {k: right[k] / want[k] for k in want if k}
    print(precision, recall, Counter(w[1] for w in wrong), wrong[:8])
    assert all(p >= 0.9 for p in precision.values()), (precision, wrong[:10])
    assert recall["secret"] >= 0.9 and recall["phone"] >= 0.9 and recall["email"] >= 0.9, recall


def test_version_numbers_are_no_phones(measured):
    rows, found = measured
    lines = [i for i, r in enumerate(rows) if r[0].startswith(("version", "build", "released as v", "ISBN"))]
    assert len(lines) > 300 and not any(k == "phone" for i in lines for k, _, _ in found[i])


def test_secrets_of_any_length(measured):
    rows, found = measured
    long = [i for i, (text, kind, span) in enumerate(rows) if kind == "secret" and span[1] - span[0] > 256]
    assert len(long) > 100 and all(found[i] == [("secret", *rows[i][2])] for i in long)
