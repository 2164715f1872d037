"""Scalar text functions, all inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters of the five languages, and with digits for queries.
WORD = "[a-záéíóúüñçàèìòùâêîôû]+"
QUERY_WORD = "[a-záéíóúüñçàèìòùâêîôû0-9]+"
#: Stop words per language, in the order in which ties are resolved.
STOPWORDS = {
    "es": "el la los las de del y en un una que es por para con se su al lo".split(),
    "en": "the and of to in is are for with on that this it as at a an by from".split(),
    "pt": "o a os as de do da e em um uma que é por para com no na dos das".split(),
    "de": "der die das und von zu in ist sind für mit auf den dem ein eine im nicht".split(),
    "fr": "le la les de du des et en un une que est pour avec sur dans au aux pas".split(),
}
#: Leading articles that names lose.
ARTICLES = ("el", "la", "los", "las", "un", "una", "the", "a", "an", "le", "les")


def token_estimate(text: Column) -> Column:
    """About four characters a token."""
    return F.floor(F.length(text) / 4)


def normalise_name(name: Column) -> Column:
    """Lower case, white space collapsed and trimmed."""
    return F.trim(F.regexp_replace(F.lower(name), r"\s+", " "))


def strip_controls(text: Column) -> Column:
    """Without code points below 32 but for line feed, carriage return and tab."""
    return F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")


def words(text: Column, pattern: str = WORD) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))


def detect_language(text: Column) -> Column:
    """The language with most distinct stop words in the text; the earlier on ties; 'es' for none.

    The text's words meet all stop words at once, and only what is found is counted by language.
    """
    every = F.array(*map(F.lit, dict.fromkeys(w for stops in STOPWORDS.values() for w in stops)))

    def ranked(found: Column) -> Column:
        counted = (F.struct(F.size(F.array_intersect(found, F.array(*map(F.lit, stops)))).alias("n"), F.lit(-i).alias("place"), F.lit(lang).alias("lang")) for i, (lang, stops) in enumerate(STOPWORDS.items()))
        return F.transform(F.array(F.array_max(F.array(*counted))), lambda top: F.when(top["n"] > 0, top["lang"]).otherwise("es"))[0]

    return F.transform(F.array(F.array_intersect(words(text), every)), ranked)[0]


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def short_id(name: Column, longest: int = 200) -> Column:
    """Ids past the limit end in _ and eight hex digits of their SHA-256."""
    return F.when(F.length(name) > longest, F.concat(F.substring(name, 1, longest - 9), F.lit("_"), F.substring(F.sha2(name, 256), 1, 8))).otherwise(name)


def title_of(text: Column, stem: Column, longest: int = 300) -> Column:
    """The first '# ' heading, else the file's stem."""
    return F.substring(F.coalesce(F.nullif(F.trim(F.regexp_extract(text, r"(?m)^#\s+(.+)$", 1)), F.lit("")), stem), 1, longest)


def strip_article(name: Column) -> Column:
    """Without one leading article."""
    return F.regexp_replace(name, "^(" + "|".join(ARTICLES) + ") +", "")


def exact_terms(text: Column, most: int = 5) -> Column:
    """Capitalised runs of words and codes such as AB-12, the first few."""
    found = F.regexp_extract_all(text, F.lit(r"[A-Z][a-z]+(?: [A-Z][a-z]+)+|[A-Z0-9]+[-_][A-Z0-9]+"), F.lit(0))
    return F.slice(F.array_distinct(found), 1, most)


def clean_terms(terms: Column, stops: Sequence[str], most: int = 15) -> Column:
    """Terms longer than two characters that are no stop words, the first few."""
    return F.slice(F.filter(terms, lambda t: (F.length(t) > 2) & ~t.isin(*stops)), 1, most)


def has_keyword(text: Column, keywords: Sequence[str]) -> Column:
    """Any keyword as a substring of the lower-cased text (not word by word)."""
    low = F.lower(text)
    out = F.lit(False)
    for k in keywords:
        out = out | low.contains(k)
    return out


def word_counts(words: Column) -> Column:
    """map<word, long> of an array of words: sorted, a word's count is the distance between the places where it begins and the next does."""
    sorted_ = F.array_sort(words)

    def counted(a: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(a) - 1), lambda i: (i == 0) | (F.get(a, i) != F.get(a, i - 1)))
        return F.transform(F.array(starts), lambda s: F.map_from_entries(F.transform(s, lambda i, k: F.struct(F.get(a, i), (F.coalesce(F.get(s, k + 1), F.size(a)) - i).cast("long")))))[0]

    return F.when(F.size(words) > 0, F.transform(F.array(sorted_), counted)[0]).otherwise(F.create_map().cast("map<string,bigint>"))


def is_noise(name: Column) -> Column:
    """Shorter than three characters, or digits, signs and underscores alone; letters of any script are no signs."""
    return (F.length(name) < 3) | name.rlike(r"^([\p{Nd}_]|[^\p{L}\p{N}_])+$")


def mask_key(key: Column) -> Column:
    return F.concat(F.substring(key, 1, 4), F.lit("****"), F.substring(key, -4, 4))


def to_flag(value: Column) -> Column:
    """Boolean synonyms; anything else is ignored (null)."""
    low = F.lower(F.trim(value))
    return F.when(low.isin("1", "true", "yes", "on", "si"), True).when(low.isin("0", "false", "no", "off"), False)


def to_enum(value: Column, allowed: list[str]) -> Column:
    """The lower-case value if it is allowed; anything else is ignored (null)."""
    low = F.lower(F.trim(value))
    return F.when(low.isin(*allowed), low)


def to_int(value: Column) -> Column:
    """A whole number; anything else is ignored (null)."""
    return F.when(F.trim(value).rlike(r"^[+-]?[0-9]+$"), F.trim(value).try_cast("long"))


def estimated_parallelism(cores: Column, memory_gb: Column, kind: str) -> Column:
    """Calls at once that a machine bears: for work that waits ('io') or that computes ('cpu')."""
    if kind == "io":
        return F.least(F.greatest(F.lit(2), cores * 2), F.lit(8), F.greatest(F.lit(2), F.floor(memory_gb / 2).cast("int")))
    return F.least(F.greatest(F.lit(1), cores - 1), F.lit(4))


def repaired_json(text: Column) -> Column:
    """Model output as JSON text: fences off, outer braces kept, trailing commas out."""
    bare = F.regexp_replace(text, r"(?s)^.*?```(?:json)?\s*|\s*```.*$", "")
    inner = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    return F.nullif(F.regexp_replace(inner, r",\s*([}\]])", "$1"), F.lit(""))


def clean_text(text: Column) -> Column:
    """Quotes folded, zero-width characters out, white space collapsed."""
    folded = F.translate(text, "“”«»‘’", "\"\"\"\"''")
    return F.trim(F.regexp_replace(F.regexp_replace(folded, "[​‌‍﻿]", ""), r"\s+", " "))


def minutes_between(start: Column, end: Column) -> Column:
    """Whole minutes, rounded up."""
    return F.ceil((F.unix_timestamp(end.cast("timestamp")) - F.unix_timestamp(start.cast("timestamp"))) / 60)


def html_images(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'<img[^>]*\bsrc="([^"]+)"'), F.lit(1))


def markdown_images(line: Column) -> Column:
    return F.regexp_extract_all(line, F.lit(r"!\[[^\]]*\]\(([^)\s]+)[^)]*\)"), F.lit(1))
