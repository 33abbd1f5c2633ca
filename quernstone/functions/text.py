"""Text expressions: markup, entities, names, counts, topics."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Character references that are decoded.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ", "&amp;": "&"}


def strip_tags(html: Column) -> Column:
    """Without tags; runs of white space become one space."""
    return F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]*>", " "), "[ \\t\\r\\n]+", " "))


def strip_markup(html: Column) -> Column:
    """Without scripts, styles and comments, then without tags."""
    bare = F.regexp_replace(html, "(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->", " ")
    return strip_tags(bare)


def strip_cdata(text: Column) -> Column:
    return F.regexp_replace(text, "(?s)^\\s*<!\\[CDATA\\[(.*?)\\]\\]>\\s*$", "$1")


def decode_entities(text: Column) -> Column:
    for name, char in ENTITIES.items():
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def tag_content(html: Column, tag: str) -> Column:
    """Text of the first such element, NULL if there is none."""
    return F.nullif(F.trim(F.regexp_extract(html, f"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1)), F.lit(""))


def snippet(text: Column, size: int = 200) -> Column:
    """Without tags, cut at the last space before ``size`` characters with an ellipsis."""
    bare = strip_tags(text)
    cut = F.regexp_replace(F.substring(bare, 1, size), " [^ ]*$", "")
    return F.when(F.length(bare) <= size, bare).otherwise(F.concat(cut, F.lit("...")))


def numbers_before(text: Column, words: str) -> Column:
    """All numbers, thousands commas removed, that stand before one of ``words``."""
    found = F.regexp_extract_all(F.lower(text), F.lit(f"([0-9][0-9,]*) (?:{words})"), F.lit(1))
    return F.transform(found, lambda x: F.replace(x, F.lit(","), F.lit("")).cast("bigint"))


def found_in(text: Column, needles: list[str]) -> Column:
    """The needles that occur in the text, in their order."""
    return F.filter(F.array(*map(F.lit, needles)), lambda n: F.contains(text, n))


def contains_any(text: Column, words: list[str]) -> Column:
    low = F.lower(text)
    hit = F.lit(False)
    for word in words:
        hit = hit | low.contains(word.lower())
    return F.coalesce(hit, F.lit(False))


def urgency(text: Column, high: list[str], medium: list[str]) -> Column:
    return F.when(contains_any(text, high), "high").when(contains_any(text, medium), "medium").otherwise("low")


def topics(text: Column, rules: dict[str, str], default: str = "general") -> Column:
    """All topics whose pattern is found, in the order of the rules."""
    low = F.lower(F.coalesce(text, F.lit("")))
    found = F.filter(F.array(*(F.when(low.rlike(p), name) for name, p in rules.items())), lambda x: x.isNotNull())
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(default)))


def signal_density(text: Column, pattern: str) -> Column:
    """Matches over the square root of the number of words, at most 1."""
    words = F.greatest(F.size(F.split(F.trim(text), "[ \\t\\r\\n]+")), F.lit(1))
    return F.least(F.lit(1.0), F.regexp_count(F.lower(text), F.lit(pattern)) / F.sqrt(words))


def temporal_certainty(text: Column, past: list[str], now: list[str]) -> Column:
    return F.when(contains_any(text, past), "past").when(contains_any(text, now), "now")


def western_digits(text: Column) -> Column:
    return F.translate(text, "٠١٢٣٤٥٦٧٨٩", "0123456789")


def plausible_count(text: Column, words: str, most: int = 500) -> Column:
    """Largest number of 1 to ``most`` before one of ``words``, else NULL."""
    return F.array_max(F.filter(numbers_before(western_digits(text), words), lambda x: x.between(1, most)))


def csv_line(*fields: Column) -> Column:
    """A line of quoted fields: quotes doubled, line feeds as blanks, NULL as the empty text."""
    plain = (F.replace(F.replace(F.coalesce(f.cast("string"), F.lit("")), F.lit("\n"), F.lit(" ")), F.lit('"'), F.lit('""')) for f in fields)
    return F.concat(F.lit('"'), F.concat_ws('","', *plain), F.lit('"'))


def fold_arabic(text: Column) -> Column:
    """Without diacritics and tatweel; variants of alef, ta marbuta and alef maqsura folded."""
    bare = F.regexp_replace(text, "[\\x{064B}-\\x{0652}\\x{0670}\\x{0640}]", "")
    return F.translate(bare, "أإآٱىة", "اااايه")


@F.pandas_udf(T.StringType())
def without_marks(text: pd.Series) -> pd.Series:
    """Compatibility decomposition without combining marks; Spark has no such function."""

    def strip(value: str | None) -> str | None:
        if value is None:
            return None
        return "".join(c for c in unicodedata.normalize("NFKD", value) if not 0x300 <= ord(c) <= 0x36F)

    return text.map(strip)


def normalised_name(text: Column, decompose: bool = True) -> Column:
    """Comparable form of a place or person name."""
    base = without_marks(text) if decompose else text
    folded = fold_arabic(F.lower(base))
    bare = F.regexp_replace(folded, "['’‘`]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, "[-_/.,()]", " "), "\\s+", " "))


def name_candidates(name: Column) -> Column:
    """Variants of a normalised name, the most exact first."""
    variants = [
        name,
        F.regexp_replace(name, " (governorate|district|city|town|village|camp|refugee camp)$", ""),
        F.regexp_replace(name, "^(governorate|district|city|town|village|camp) (of )?", ""),
        F.regexp_replace(name, "^(al|el|ad|ar|as|at|an|az|ash) ", ""),
        F.concat(F.lit("al "), name),
        F.regexp_replace(name, "ah$", "a"),
        F.regexp_replace(name, "a$", "ah"),
    ]
    return F.filter(F.array_distinct(F.array(*variants)), lambda v: F.length(v) > 0)


def canonical_key(name: Column) -> Column:
    return F.regexp_replace(F.trim(F.lower(name)), "\\s+", "_")


def message_fingerprint(text: Column) -> Column:
    """Without pictographs and links, white space collapsed."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x{1F000}-\\x{1FAFF}\\x{2600}-\\x{27BF}]|https?://[^ \\n]+", "")
    return F.trim(F.regexp_replace(bare, "[ \\t\\r\\n]+", " "))


def word_set(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), " +"), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays without repeats; 0 for two empty ones."""
    both = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(both, F.size(a) + F.size(b) - both), F.lit(0.0))
