"""Personal data and secrets by candidate gradient boosting, in DataFrame functions only.

Patterns propose spans with high recall: the strict ones of the base, which always stay, and wider ones that overlap them. A
candidate passes or fails a check of its content (checksum, octets, ending, number of digits, mixed characters). What the
trees see is all else: its outer format and the text round it, as small whole numbers. Candidates are counted by feature vector
(a table whose size the features bound), boosted trees are fitted on those counts to tell surroundings of candidates that pass
from surroundings of candidates that fail, and become one SQL expression.

A random string passes a check now and then, so passing alone says little where many candidates fail. Thresholds are set on
documents that the trees have not seen: of ``r`` candidates from a score on that pass and ``w`` that fail, about
w * CHANCE / (1 - CHANCE) pass by chance; a threshold is the least score from which at most 1 - PRECISION of those that pass do so
by chance. Candidates that pass and reach the threshold of their kind are added to the base.
"""

from __future__ import annotations

import math
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pricetide.llm.common import ROW, fold, materialize, row_id

KINDS = ("email", "ip", "card", "phone", "secret")
#: Kinds with a strict pattern.
BASIC = KINDS[:4]
#: The base, one match after the other. Each begins where a run of its characters begins or the match before it ended, and
#: runs are never given back: the same matches as the plain patterns, without trying each place of a long run.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Wider forms: spelt-out signs, other separators, numbers without the plus.
WIDE = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++\x20?(?:@|\(at\)|\[at\])\x20?[\p{L}\p{N}-]++(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[\p{L}\p{N}-]++)++",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\x20?[.,]\x20?[0-9]{1,3}){3}(?![0-9])",
    "card": r"(?<![0-9])[0-9]{4}[\x20./_-]?[0-9]{4}[\x20./_-]?[0-9]{4}[\x20./_-]?[0-9]{1,7}(?![0-9])",
    "phone": r"(?<![\p{L}\p{N}]|[0-9][.,/:-])(?:\+|00)?\(?[0-9]{2,4}\)?[\x20./-][0-9]{2,4}(?:[\x20./-][0-9]{2,4}){1,3}(?![0-9]|[.,/:-][0-9])",
    "secret": r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{16,}+={0,2}(?![A-Za-z0-9_=-])",
}
#: What a text must hold before a pattern is tried: one of some strings, or what a quicker pattern finds.
NEEDS = {"email": ("@", "(at)", "[at]"), "ip": r"[0-9]\x20?[.,]\x20?[0-9]", "card": "[0-9]{4}", "phone": r"[0-9]\)?[\x20./-]\(?[0-9]", "secret": None}
BASE_NEEDS = {"email": ("@",), "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": ("+",)}
CONTEXT = {
    "email": r"(?i)mail|contact|write|kontakt|correo|courriel",
    "ip": r"(?i)\bip\b|host|server|addr|login",
    "card": r"(?i)card|visa|credit|payment|karte|carte|tarjeta",
    "phone": r"(?i)phone|tel|call|fax|mobil|whatsapp|sms",
    "secret": r"(?i)token|secret|passw|pwd|bearer|auth|credential|(?:api|access|private)[_ -]?key",
}
#: What stands before a number that counts, dates or names a thing: no phone has it.
NUMBERING = r"(?i)(?:\b(?:v|ver|version|versions|build|release|revision|rev|no|nr|number|order|invoice|isbn|issn|iban|article|item|sku|serial|part|page|pages|chapter|date|born|since|until)[.:#]?|[#§$€£])\s{0,2}$"
#: Groups of digits that make a date or a time, and parts of a whole, not a phone.
DATED = r"^(?:[0-9]{4}([./-])[01]?[0-9]\1[0-3]?[0-9]|[0-3]?[0-9]([./-])[01]?[0-9]\2[0-9]{4})(?![0-9])"
#: What stands before a value that is given to a name.
GIVEN = r"""[\p{L}\p{N}_-]['"]?\s{0,2}[:=]\s{0,2}['"]?$"""
FEATURES = ("kind", "left", "right", "quoted", "separators", "context", "foreign", "parts", "size")
ROUNDS, DEPTH, RATE, LEAST_WEIGHT = 20, 2, 0.4, 5.0
#: How often a random string of a kind passes its check (about); the share of added spans that is to be right.
CHANCE = {"email": 0.5, "ip": 0.02, "card": 0.1, "phone": 0.5, "secret": 0.2}
PRECISION = 0.9


#: Marks round the matches of a pattern; where a text has such characters itself, another control character stands for them.
OPEN, SHUT, OTHER = "\u0001", "\u0002", "\u0003"


def _parts(text: Column, pattern: str, needs: str | tuple[str, ...] | None) -> Column:
    """The text before the first match, then each match, a SHUT and the text after it: one pass of the pattern."""
    some = reduce(Column.__or__, [text.contains(n) for n in needs]) if isinstance(needs, tuple) else text.rlike(needs) if needs else text.isNotNull()
    return F.when(some, F.split(F.regexp_replace(text, pattern, f"{OPEN}$0{SHUT}"), OPEN))


def candidates(docs: DataFrame) -> DataFrame:
    """uid, learn (for fitting, not held out), wide, kind, start, end, hit, before, after for every match of every pattern."""
    text = F.coalesce(F.col("text"), F.lit(""))
    text = F.when(text.contains(OPEN) | text.contains(SHUT), F.translate(text, OPEN + SHUT, OTHER + OTHER)).otherwise(text)
    rows = docs.select(row_id(docs).alias("uid"), (fold(5) != 0).alias("learn"), text.alias("text"))
    sets, names = [], []
    for wide, patterns, needs in ((False, BASE, BASE_NEEDS), (True, WIDE, NEEDS)):
        for k, kind in enumerate(patterns):
            i = len(sets)
            names.append(_parts(F.col("text"), patterns[kind], needs[kind]).alias(f"p{i}"))
            hit, gap = f"substring_index(m, '{SHUT}', 1)", lambda p: f"substring_index({p}, '{SHUT}', -1)"
            before = f"right(if(j = 0, p{i}[0], concat({gap(f'p{i}[greatest(j - 1, 0)]')}, if(j = 0, '', substring_index(p{i}[j], '{SHUT}', 1)), {gap(f'p{i}[j]')})), 32)"
            sets.append(f"transform(slice(p{i}, 2, size(p{i})), (m, j) -> struct({str(wide).lower()} as wide, {k} as kind, j as j, length({gap(f'p{i}[j]')}) as gap, {hit} as hit, {before} as before, left({gap('m')}, 8) as after))")
    rows = rows.select("uid", "learn", *names)
    empty = "cast(array() as array<struct<wide: boolean, kind: int, j: int, gap: int, hit: string, before: string, after: string>>)"
    every = F.expr("concat(" + ", ".join(f"coalesce({s}, {empty})" for s in sets) + ")")
    rows = rows.select("uid", "learn", F.explode(every).alias("c")).select("uid", "learn", "c.*")
    order = Window.partitionBy("uid", "wide", "kind").orderBy("j")
    end = F.sum(F.col("gap") + F.length("hit")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("end", end).withColumn("start", F.col("end") - F.length("hit")).drop("gap", "j")


def _features(rows: DataFrame) -> DataFrame:
    """uid, learn, wide, kind, start, end; passes (the check) and given (to a name), which the labels are made of; FEATURES, which are made of neither."""
    digits = F.regexp_replace("hit", "[^0-9]", "")
    rows = rows.withColumn("d", digits).withColumn("n", F.length("d"))
    luhn = F.expr("aggregate(sequence(1, n), 0, (acc, k) -> acc + if(k % 2 = 1, int(substr(d, n - k + 1, 1)), 2 * int(substr(d, n - k + 1, 1)) - if(int(substr(d, n - k + 1, 1)) > 4, 9, 0))) % 10 = 0")
    octet = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
    kind, before, hit = F.col("kind"), F.col("before"), F.col("hit")
    mixed = (F.col("n") >= 3) & (F.length("hit") - F.col("n") >= 3) & (F.size(F.array_distinct(F.split("hit", ""))) >= 8)
    passes = (
        F.when(kind == 0, hit.rlike(r"(?i)[.\])]\s?[a-z]{2,24}$"))
        .when(kind == 1, hit.rlike(rf"^{octet}(?:\s?[.,]\s?{octet}){{3}}$"))
        .when(kind == 2, F.when(F.col("n").between(13, 19), luhn).otherwise(F.lit(False)))
        .when(kind == 3, F.col("n").between(9, 15) & (hit.startswith("+") | ~(before.rlike(NUMBERING) | hit.rlike(DATED))))
        .otherwise(mixed)
    )
    own, foreign = F, F.lit(False)
    for k, name in enumerate(KINDS):
        said = before.rlike(CONTEXT[name])
        own, foreign = own.when(kind == k, said), foreign | ((kind != k) & said)
    bit = lambda c: c.cast("int")
    return rows.select(
        "uid", "learn", "wide", "kind", "start", "end", passes.alias("passes"), before.rlike(GIVEN).alias("given"),
        bit(before.rlike(r"(?:^|[^\p{L}\p{N}])$")).alias("left"),
        bit(F.col("after").rlike(r"^(?:$|[^\p{L}\p{N}])")).alias("right"),
        F.when(kind == 4, 0).otherwise(bit(before.rlike(r"""['"=]$"""))).alias("quoted"),
        F.least(F.size(F.array_distinct(F.split(F.regexp_replace("hit", r"[\p{L}\p{N}+@]", ""), ""))), F.lit(3)).alias("separators"),
        bit(own).alias("context"), bit(foreign).alias("foreign"),
        F.least(F.size(F.split(F.trim("hit"), r"[^\p{L}\p{N}]+")), F.lit(6)).alias("parts"),
        F.when(kind.isin(0, 2, 4), F.least(F.floor(F.length("hit") / 8), F.lit(6)).cast("int")).otherwise(0).alias("size"),
    )


def _grow(rows: list, x: list, grad: list, hess: list, depth: int):
    """A leaf value, or (feature, bound, tree up to the bound, tree above)."""
    g_all, h_all, best = sum(grad[i] for i in rows), sum(hess[i] for i in rows), None
    gain_of = lambda g, h: g * g / (h + 1.0)
    for f in range(len(FEATURES)) if depth else ():
        sums: dict = {}
        for i in rows:
            at = sums.setdefault(x[i][f], [0.0, 0.0])
            at[0] += grad[i]
            at[1] += hess[i]
        g = h = 0.0
        for bound in sorted(sums)[:-1]:
            g, h = g + sums[bound][0], h + sums[bound][1]
            gain = gain_of(g, h) + gain_of(g_all - g, h_all - h) - gain_of(g_all, h_all)
            if gain > 1e-6 and (best is None or gain > best[0] + 1e-12):
                best = (gain, f, bound)
    if best is None:
        return RATE * g_all / (h_all + 1.0)
    _, f, bound = best
    low, high = [i for i in rows if x[i][f] <= bound], [i for i in rows if x[i][f] > bound]
    return (f, bound, _grow(low, x, grad, hess, depth - 1), _grow(high, x, grad, hess, depth - 1))


def _value(tree, x) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree


def boost(x: list[tuple], right: list[float], wrong: list[float]) -> tuple[float, list]:
    """Prior log-odds and trees, fitted to weighted counts of right and wrong candidates by feature vector."""
    n1, n0 = sum(right), sum(wrong)
    prior = math.log((n1 + 1.0) / (n0 + 1.0))
    odds, trees = [prior] * len(x), []
    for _ in range(ROUNDS if n1 >= LEAST_WEIGHT and n0 >= LEAST_WEIGHT else 0):
        p = [1 / (1 + math.exp(-o)) for o in odds]
        grad = [r * (1 - q) - w * q for r, w, q in zip(right, wrong, p, strict=True)]
        hess = [(r + w) * q * (1 - q) for r, w, q in zip(right, wrong, p, strict=True)]
        tree = _grow(list(range(len(x))), x, grad, hess, DEPTH)
        trees.append(tree)
        odds = [max(-30.0, min(30.0, o + _value(tree, v))) for o, v in zip(odds, x, strict=True)]
    return prior, trees


def _sql(tree) -> str:
    if not isinstance(tree, tuple):
        return f"{tree!r}D"
    return f"if({FEATURES[tree[0]]} <= {tree[1]}, {_sql(tree[2])}, {_sql(tree[3])})"


def calibrate(scored: list[tuple[float, int, int]], chance: float) -> float:
    """The least score from which those that pass by chance are few among those that pass; 2 if there is none.

    ``scored``: score, how many candidates of it pass, how many fail.
    """
    good = bad = 0
    threshold = 2.0
    for score in sorted({s for s, _, _ in scored}, reverse=True):
        good += sum(r for s, r, _ in scored if s == score)
        bad += sum(w for s, _, w in scored if s == score)
        if good and bad * chance / (1 - chance) <= (1 - PRECISION) * good + 1e-9:
            threshold = score
    return threshold


class Model(NamedTuple):
    """The score of a candidate as an expression, the threshold of each kind, and how it did on documents not learned from."""

    score: Column
    thresholds: dict[str, float]
    report: dict[str, dict[str, float]]


def fit(found: DataFrame) -> Model:
    """Learned from candidates that pass or fail their check. A secret counts as right only where it is given to a name, else as unknown.

    A kind of which no held-out candidate passes (tables of a few documents) has its threshold from those learned from.
    """
    right = F.col("passes") & ((F.col("kind") != 4) | F.col("given"))
    wrong = ~F.col("passes")
    counted = found.where(right | wrong).groupBy(*FEATURES).agg(*[F.count_if(part & when).alias(name) for name, part, when in (("r", right, F.col("learn")), ("w", wrong, F.col("learn")), ("hr", right, ~F.col("learn")), ("hw", wrong, ~F.col("learn")))])
    rows = sorted(counted.collect())  # at most 5 * 2^5 * 4 * 7 * 7 feature vectors
    x = [tuple(r[f] for f in FEATURES) for r in rows]
    prior, trees = boost(x, [float(r["r"]) for r in rows], [float(r["w"]) for r in rows])
    thresholds, report = {}, {}
    for k, kind in enumerate(KINDS):
        unseen = any(r["hr"] for v, r in zip(x, rows, strict=True) if v[0] == k)
        own = [(round(1 / (1 + math.exp(-max(-30.0, min(30.0, prior + sum(_value(t, v) for t in trees))))), 9), *((r["hr"], r["hw"]) if unseen else (r["r"], r["w"]))) for v, r in zip(x, rows, strict=True) if v[0] == k]
        thresholds[kind] = calibrate(own, CHANCE[kind])
        taken = [(hr, hw) for s, hr, hw in own if s >= thresholds[kind]]
        good, bad, every = sum(hr for hr, _ in taken), sum(hw for _, hw in taken), sum(hr for _, hr, _ in own)
        by_chance = min(good, bad * CHANCE[kind] / (1 - CHANCE[kind]))
        report[kind] = {"passing": every, "failing": sum(hw for _, _, hw in own), "precision": 1 - by_chance / good if good else 1.0, "recall": good / every if every else 1.0}
    odds = " + ".join([f"{prior!r}D", *map(_sql, trees)])
    return Model(F.expr(f"round(1 / (1 + exp(-greatest(-30D, least(30D, {odds})))), 9)"), thresholds, report)


def find_spans(docs: DataFrame) -> DataFrame:
    """uid, kind (number in KINDS), start, end, base, score: the base spans and those the trees add.

    An added span overlaps no base span and no added one that begins before it.
    """
    found = materialize(_features(candidates(docs)), "candidates")
    model = fit(found)
    least = F.element_at(F.array(*[F.lit(model.thresholds[k]) for k in KINDS]), F.col("kind") + 1)
    base = (~F.col("wide") & (F.col("passes") | (F.col("kind") == 0))).alias("base")  # the base takes an email as it is
    chosen = found.withColumn("score", model.score).select("uid", "kind", "start", "end", base, "score", "passes").where(F.col("base") | (F.col("passes") & (F.col("score") >= least))).drop("passes")
    order = Window.partitionBy("uid").orderBy("start", F.desc("base"), F.desc("score"), "end", "kind")
    before = F.max(F.when(F.col("base"), F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(F.when(F.col("base"), F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    free = F.col("base") | ((F.coalesce(before, F.lit(0)) <= F.col("start")) & (after.isNull() | (after >= F.col("end"))))
    chosen = chosen.withColumn("free", free).where("free").drop("free")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return chosen.withColumn("reach", reach).where(F.col("base") | F.col("reach").isNull() | (F.col("reach") <= F.col("start"))).drop("reach")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with each found span of its text replaced by ``[KIND]``; other columns as they are."""
    spans = find_spans(docs).groupBy(F.col("uid").alias(ROW)).agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind"))).alias("_spans"))
    own = [F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(docs.columns)]
    rows = docs.select(*own, row_id(docs).alias(ROW)).join(spans, ROW, "left")
    marks = ", ".join(f"'[{k.upper()}]'" for k in KINDS)
    text = f"_c{docs.columns.index('text')}"
    cut = F.expr(
        "aggregate(_spans, struct(cast('' as string) as out, cast(0 as bigint) as at), (a, s) -> struct(if(s.start < a.at, a.out, concat(a.out, "
        f"substring({text}, cast(a.at as int) + 1, cast(s.start - a.at as int)), array({marks})[s.kind])) as out, greatest(a.at, cast(s.end as bigint)) as at), "
        f"a -> concat(a.out, substring({text}, cast(a.at as int) + 1)))"
    )
    rows = rows.withColumn(text, F.when(F.col("_spans").isNull(), F.col(text)).otherwise(cut))
    return rows.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns)])


def personal_data(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, counts of base spans by kind, base_sha256, spans, n_added, n_secret, n_spans (of all kinds).

    A null text counts as empty and has no span; empty tables give empty results; repeated rows each have a row. Only doc_id
    and text are read. ``docs`` is a stored table: it is read twice.
    """
    spans = find_spans(docs)
    name = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("kind") + 1)
    entry = F.struct("kind", "start", "end", F.concat_ws(":", name, F.col("start").cast("string"), F.col("end").cast("string")).alias("said"))
    per = spans.groupBy("uid").agg(
        *[F.count_if(F.col("base") & (F.col("kind") == k)).alias(f"n_{kind}") for k, kind in enumerate(BASIC)],
        F.count_if(~F.col("base")).alias("n_added"), F.count_if(F.col("kind") == 4).alias("n_secret"), F.count(F.lit(1)).alias("n_spans"),
        F.array_sort(F.collect_list(F.when(F.col("base"), entry))).alias("own"), F.array_sort(F.collect_list(entry)).alias("whole"),
    )
    said = lambda c: F.coalesce(F.concat_ws(",", F.transform(c, lambda s: s["said"])), F.lit(""))
    rows = docs.select(row_id(docs).alias("uid"), "doc_id").join(per, "uid", "left")
    return rows.select("doc_id", *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in BASIC], F.sha2(said("own"), 256).alias("base_sha256"), said("whole").alias("spans"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_added", "n_secret", "n_spans")])


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
