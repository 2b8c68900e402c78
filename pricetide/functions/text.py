"""Page text as column expressions: noise, tags, titles, lines, keys and word scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.strip and \\s see it.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
#: Cuts of the three text flavours.
TEXT_LIMITS = {"plain": 200_000, "folded": 350_000, "filing": 12_000}
#: Seconds a fetch stays fresh, by the first of these found in its url.
FRESH_SECONDS = (
    ("sec.gov", 86400), ("earningswhispers", 3600), ("finance.yahoo", 300), ("marketwatch", 300),
    ("seekingalpha", 1800), ("wsj.com", 600), ("reuters.com", 600),
)
FRESH_DEFAULT = 600
#: Characters of a chunk and of the overlap with the chunk before.
CHUNK, OVERLAP = 12_000, 800
#: Words that mark a price window as worth keeping.
EXCERPT_WORDS = ("walmart", "amazon", "ebay", "best buy", "target", "osmo", "pocket", "dji")


def let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), 0)


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def strip(c: Column) -> Column:
    """Trim every kind of white space, not blanks alone."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def strip_noise(html: Column) -> Column:
    """Script, style and noscript blocks become one blank."""
    return F.regexp_replace(text_or_empty(html), r"(?is)<(script|style|noscript)[^>]*>.*?</\1>", " ")


def html_to_text(html: Column, mode: str = "plain") -> Column:
    """Tags become blanks; all modes but ``plain`` fold white space and trim; then the mode's cut."""
    bare = F.regexp_replace(text_or_empty(html), "<[^>]+>", " ")
    if mode != "plain":
        bare = F.trim(F.regexp_replace(bare, f"{SPACE}+", " "))
    return F.left(bare, F.lit(TEXT_LIMITS[mode]))


def page_title(html: Column) -> Column:
    return strip(F.regexp_extract(text_or_empty(html), r"(?i)<title[^>]*>([^<]{1,500})</title>", 1))


def lines(text: Column) -> Column:
    """Lines as str.splitlines gives them: no last empty one."""
    broken = F.regexp_replace(text_or_empty(text), r"\r\n|[\r\x0b\x0c\x1c-\x1e\x85  ]", "\n")
    body = F.regexp_replace(broken, r"\n\z", "")
    return F.when(broken == "", F.array().cast("array<string>")).otherwise(F.split(body, "\n", -1))


def clean_text(text: Column, limit: int = 200_000) -> Column:
    """Every line trimmed, runs of blank lines folded to one."""
    joined = F.array_join(F.transform(lines(text), strip), "\n")
    return F.left(F.regexp_replace(F.regexp_replace(joined, r"\n{3,}", "\n\n"), r"\A\n\n+", "\n"), F.lit(limit))


def sanitize_text(text: Column) -> Column:
    """Text that begins like a style sheet keeps only lines that look like content; all else is unchanged."""
    kept = F.filter(
        F.transform(lines(text), strip),
        lambda s: (F.length(s) > 3) & ~s.rlike(r"\A(?:[:@{}]|--)") & ~s.rlike(r"\A[\s\x1c-\x1f\x85\p{Z}{};:@#.\-0-9%]+\z"),
    )
    styled = strip(text_or_empty(text)).rlike(r"\A(?::root|@charset|\{)")
    return F.when(styled, F.left(F.array_join(kept, "\n"), F.lit(350_000))).otherwise(text_or_empty(text))


def chunks(text: Column) -> Column:
    """Overlapping chunks of a text, an array: a short text whole; else blocks between blank lines, put together up to CHUNK.

    A chunk that is full closes, and its last OVERLAP characters begin the next one; blocks over CHUNK are cut in windows.
    """
    whole = text_or_empty(text)
    filled = lambda chunk: F.filter(F.array(strip(chunk)), lambda c: c != "")
    state = lambda closed, growing: F.struct(closed.alias("closed"), growing.alias("growing"))

    def windows(block: Column) -> Column:
        starts = F.sequence(F.lit(1), F.length(block), F.lit(CHUNK - OVERLAP))
        return F.transform(starts, lambda i: F.substring(block, i, F.lit(CHUNK)))

    def take(s: Column, block: Column) -> Column:
        growing, closed = s["growing"], F.concat(s["closed"], filled(s["growing"]))
        with_it = F.concat(growing, F.lit("\n\n"), block)
        blank = F.when(strip(growing) == "", growing).otherwise(F.lit(""))
        return (
            F.when(F.length(block) > CHUNK, state(F.concat(closed, windows(block)), blank))
            .when(growing == "", state(s["closed"], block))
            .when(F.length(with_it) <= CHUNK, state(s["closed"], with_it))
            .otherwise(state(closed, F.concat(F.right(growing, F.lit(OVERLAP)), F.lit("\n\n"), block)))
        )

    none = state(F.array().cast("array<string>"), F.lit(""))
    folded = F.aggregate(F.split(whole, r"\n{2,}", -1), none, take, lambda s: F.concat(s["closed"], filled(s["growing"])))
    return F.when(F.length(whole) <= CHUNK, F.array(whole)).otherwise(folded)


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text_or_empty(text)), F.lit(r"(?U)\w+"), F.lit(0))


def score_words(chunk: Column, query: Column) -> Column:
    """Words of the chunk that the query has, over the root of the number of words; 0 without words."""
    asked = words(query)
    own = words(chunk)
    hits = F.size(F.filter(own, lambda w: F.array_contains(asked, w)))
    return F.when(F.size(own) == 0, F.lit(0.0)).otherwise(hits / F.sqrt(F.size(own).cast("double")))


def fetch_key(url: Column) -> Column:
    return F.md5(url.cast("binary"))


def extract_key(url: Column, prompt: Column) -> Column:
    return F.concat(F.lit("extract:"), F.md5(F.concat(url, F.lit("||"), F.lower(strip(text_or_empty(prompt)))).cast("binary")))


def fresh_seconds(url: Column) -> Column:
    chain = F
    for part, seconds in FRESH_SECONDS:
        chain = chain.when(url.contains(part), F.lit(seconds))
    return chain.otherwise(F.lit(FRESH_DEFAULT))


def price_excerpt(page_text: Column, html: Column, limit: int = 24_000) -> Column:
    """Windows round prices that name a known word; without any, windows round the words; repeats dropped."""
    plain = F.regexp_replace(F.concat(text_or_empty(page_text), F.lit("\n"), text_or_empty(html)), "<[^>]+>", " ")
    return let(F.regexp_replace(plain, f"{SPACE}+", " "), lambda p: _excerpt(p, text_or_empty(page_text), limit))


def _excerpt(plain: Column, page_text: Column, limit: int) -> Column:
    known = "|".join(EXCERPT_WORDS)
    priced = F.regexp_extract_all(plain, F.lit(r".{0,120}\$\d[\d,]*(?:\.\d{2})?.{0,120}"), F.lit(0))
    named = F.filter(priced, lambda s: F.lower(s).rlike(known))
    round_words = F.flatten(F.array(*[F.when(F.lower(plain).contains(w), F.regexp_extract_all(plain, F.lit(rf"(?i).{{0,80}}{w}.{{0,200}}"), F.lit(0))).otherwise(F.array().cast("array<string>")) for w in EXCERPT_WORDS]))
    found = let(named, lambda n: F.when(F.size(n) > 0, n).otherwise(round_words))
    said = F.array_join(F.array_distinct(F.transform(found, strip)), "\n")
    return F.left(let(said, lambda s: F.when(s != "", s).otherwise(page_text)), F.lit(limit))
