"""Text as columns: cleaning of wiki markup, validity of words, and measures of their letters.

All are Spark expressions that stay inside code generation. Java's `$` and `^` differ from what is meant here in two ways, so
anchors are \\A and \\z, and (?d) keeps only \\n as a line end.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import Script

#: What wiki markup is, in order of removal. The third item is what stays of a match.
WIKI_BEFORE = [
    (r"(?s)<!--.*?-->", ""),
    (r"(?s)\{\|.*?\|\}", ""),
    (r"(?s)<ref[^>]*>.*?</ref>|<ref[^/>]*/>", ""),
    (r"\[\[(?:หมวดหมู่|Category):[^\]]+\]\]", ""),
    (r"\[\[(?:ไฟล์|File|Image):[^\]]+\]\]", ""),
]
WIKI_TEMPLATE = r"\{\{[^{}]*\}\}"
WIKI_AFTER = [
    (r"\[\[[^\]]*?\|([^\]]+)\]\]", "$1"),
    (r"\[\[([^\]|]+)\]\]", "$1"),
    (r"\[https?://[^\]]*\]", ""),
    (r"<[^>]+>", ""),
    (r"'{2,5}", ""),
    (r"(?md)^=+.*?=+$", ""),
    (r"(?md)^[*#:;]+\s*", ""),
]
TEMPLATE_DEPTH = 5


def clean_wikitext(text: Column) -> Column:
    """Text without wiki markup; templates are taken away from the inside out, TEMPLATE_DEPTH deep."""
    rules = [*WIKI_BEFORE, *[(WIKI_TEMPLATE, "")] * TEMPLATE_DEPTH, *WIKI_AFTER]
    return reduce(lambda c, r: F.regexp_replace(c, *r), rules, text)


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, r"<[^>]+>", "")


def strip_space(text: Column) -> Column:
    """Text without white space of any kind at its ends."""
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def query_text(text: Column) -> Column:
    """A query as the search takes it: lower case, no spaces."""
    return F.lower(F.replace(text, F.lit(" "), F.lit("")))


def distinct_letters(word: Column) -> Column:
    return F.size(F.array_distinct(F.split(word, "")))


def validity(word: Column, script: Script) -> dict[str, Column]:
    """The rules of a valid word, by name, cheapest first."""
    rules = {"length_ok": F.length(word).between(script.shortest, script.longest), "script_ok": word.rlike(rf"\A[{script.letters}]+\z")}
    if script.repeater:
        rules["not_repeater_only"] = ~word.rlike(rf"\A{script.repeater}+\z")
        rules["not_repeater_first"] = ~word.startswith(script.repeater)
    rules["no_run"] = ~word.rlike(r"(?s)(.)\1{3,}")
    if script.consonants:
        rules["has_consonant"] = word.rlike(f"[{script.consonants}]")
    rules["not_one_letter"] = distinct_letters(word) > 1
    return rules


def is_valid(word: Column, script: Script) -> Column:
    return reduce(lambda a, b: a & b, validity(word, script).values())


def base_length(word: Column, script: Script) -> Column:
    return F.length(F.regexp_replace(word, f"[^{script.base or script.letters}]", ""))


def nuclei(word: Column, script: Script) -> Column:
    """Vowel nuclei, one at least; pairs that are one nucleus count once."""
    count = F.regexp_count(word, F.lit(f"[{script.nuclei}]"))
    for p in script.nucleus_pairs:
        count = count - F.regexp_count(word, F.lit(p))
    return F.greatest(F.lit(1), count)


def vowel_clusters(latin: Column) -> Column:
    return F.greatest(F.lit(1), F.regexp_count(latin, F.lit("(?i)[aeiouy]+")))


def longest(words: Column) -> Column:
    """The first of the longest, '' of none."""
    return F.aggregate(words, F.lit(""), lambda a, x: F.when(F.length(x) > F.length(a), x).otherwise(a))


def shortest(words: Column) -> Column:
    """The first of the shortest, '' of none."""
    return F.coalesce(F.aggregate(words, F.lit(None).cast("string"), lambda a, x: F.when(a.isNull() | (F.length(x) < F.length(a)), x).otherwise(a)), F.lit(""))


#: Beginnings of two letters that are consonant clusters.
CLUSTERS = ["kh", "th", "ph", "ch", "kr", "tr", "pr", "kl", "pl", "bl", "fr", "fl"]


def has_cluster(latin: Column) -> Column:
    return F.lower(latin).rlike("^(?:" + "|".join(CLUSTERS) + ")")
