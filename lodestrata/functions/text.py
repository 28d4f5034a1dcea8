"""Text functions as column expressions; all stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Endings and words that say little in names of nodes.
NAME_ENDINGS = ["板块", "概念", "行业", "赛道", "产业链", "领域", "产业"]
NOISE_WORDS = ["股份", "控股", "公司", "集团", "有限", "科技", "中国", "国际", "行业", "赛道", "概念", "板块", "产业", "领域", "产业链", "有限公", "有限公司", "股份有限", "股份有限公司"]
#: The form of a ticker, words that negate what follows.
TICKER = r"^(\d{6}(\.[A-Z]{2})?|[A-Z]{1,5}(\.[A-Z]{1,2})?)$"
NEGATIONS = ["不要", "没有", "不是", "不会", "无需", "不"]


def normalize_text(c: Column) -> Column:
    """Lower case, trimmed, runs of white space as one blank; null counts as empty."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\s+", " "))


def content_hash(title: Column, body: Column) -> Column:
    """SHA-256 of normal title, one blank and normal body."""
    return F.sha2(F.concat_ws(" ", normalize_text(title), normalize_text(body)), 256)


def truncate(c: Column, n: int) -> Column:
    """At most ``n`` characters, with dots after a cut."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def contains_ignoring_case(c: Column, text: str) -> Column:
    """Substring test without wildcards, so that no character has to be escaped."""
    return F.lower(c).contains(text.lower())


def word_match(c: Column, term: str) -> Column:
    """ASCII terms match at word borders only, others as substrings; case does not matter."""
    low = term.lower()
    if not low.isascii():
        return F.lower(c).contains(low)
    return F.lower(c).rlike(rf"(?<![a-zA-Z0-9])\Q{low}\E(?![a-zA-Z0-9])")


def term_position(c: Column, term: str) -> Column:
    """First position of a term (see :func:`word_match`), from 0; -1 if it is absent or the text is null."""
    low = term.lower()
    if not low.isascii():
        return F.coalesce(F.instr(F.lower(c), low), F.lit(0)) - 1
    border = rf"(?<![a-zA-Z0-9])\Q{low}\E(?![a-zA-Z0-9])"
    # the length of what lies before counts characters; positions of regular expressions count UTF-16 units
    before = F.length(F.regexp_extract(F.lower(c), rf"(?s)^(.*?){border}", 1))
    return F.when(F.lower(c).rlike(border), before).otherwise(-1)


def is_ticker(c: Column) -> Column:
    return F.upper(F.trim(c)).rlike(TICKER)


def affirmed(c: Column, signal: str) -> Column:
    """Whether a signal occurs and its first occurrence is not negated."""
    at = F.instr(c, signal)
    before = F.substring(c, F.greatest(at - 2, F.lit(1)), F.least(at - 1, F.lit(2)))
    negated = reduce(lambda a, b: a | b, [before.endswith(n) for n in NEGATIONS])
    return (at > 0) & ~negated


def clean_name(c: Column) -> Column:
    """Without the first listed ending it has, if more than one character is left."""
    t = F.trim(c)
    out = t
    for ending in reversed(NAME_ENDINGS):
        out = F.when(t.endswith(ending) & (F.length(t) > len(ending) + 1), F.trim(F.substring(t, F.lit(1), F.length(t) - len(ending)))).otherwise(out)
    return out


def strip_noise(c: Column) -> Column:
    """Listed words removed anywhere, in the order of the list."""
    return F.trim(reduce(lambda x, w: F.replace(x, F.lit(w), F.lit("")), NOISE_WORDS, c))


def normalized_name(c: Column) -> Column:
    return F.lower(clean_name(strip_noise(c)))


def strip_connectors(c: Column) -> Column:
    return F.regexp_replace(c, "[与及和、]", "")


def character_pairs(c: Column) -> Column:
    """The distinct pairs of neighbouring characters; a shorter text is its own only element."""
    # no lambda may hold c: it would be computed again for every pair
    signs = F.regexp_extract_all(c, F.lit("(?s)."), 0)
    pairs = F.zip_with(F.slice(signs, 1, F.greatest(F.size(signs) - 1, F.lit(0))), F.slice(signs, 2, F.greatest(F.size(signs) - 1, F.lit(0))), lambda x, y: F.concat(x, y))
    return F.when(F.length(c) < 2, F.array(c)).otherwise(F.array_distinct(pairs))


def jaccard(a: Column, b: Column) -> Column:
    """Share of common elements of two arrays; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def levenshtein_ratio(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def keyword_overlap(a: Column, b: Column) -> Column:
    """Share of the words of ``a`` that ``b`` has too; 0 if ``a`` has none."""
    words = lambda c: F.array_distinct(F.filter(F.split(c, r"\s+"), lambda w: w != ""))
    return F.when(F.size(words(a)) == 0, 0.0).otherwise(F.size(F.array_intersect(words(a), words(b))) / F.size(words(a)))


def has_cjk(c: Column) -> Column:
    return c.rlike("[\\u4e00-\\u9fff]")


def analyze(c: Column) -> Column:
    """Index terms in order: lower-case ASCII words, then the character pairs of each Chinese run.

    A run of one character is a term itself.  Null gives an empty array.
    """
    low = F.lower(F.coalesce(c, F.lit("")))
    words = F.regexp_extract_all(low, F.lit("[a-z0-9]+"), 0)
    runs = F.regexp_extract_all(low, F.lit("[\\u4e00-\\u9fff]+"), 0)
    pairs = F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: F.substring(r, i, F.lit(2))))
    return F.concat(words, F.flatten(pairs))


def drop_stopwords(c: Column, stopwords: list[str]) -> Column:
    """Words separated by white space without those of a set; unchanged if none would be left."""
    left = F.filter(F.split(F.trim(c), r"\s+"), lambda w: ~w.isin(*stopwords))
    return F.when(F.size(left) == 0, c).otherwise(F.array_join(left, " "))


def struct_texts(c: Column, *fields: str) -> Column:
    """All texts of the named fields of an array of structs, joined by blanks."""
    return F.array_join(F.flatten(F.transform(c, lambda s: F.filter(F.array(*[s[f].cast("string") for f in fields]), lambda x: x.isNotNull()))), " ")


def embedded_json(c: Column) -> Column:
    """The outermost braces of a text, for ``from_json``; null without braces."""
    found = F.regexp_extract(c, r"(?s)\{.*\}", 0)
    return F.when(found != "", found)
