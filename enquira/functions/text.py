"""Column expressions for cleaning text, prices and synonyms."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Synonyms of qualification levels.
LEVELS = {
    "foundation": ["foundation", "foundation degree"],
    "undergraduate": ["undergraduate"],
    "bachelor": ["bachelor", "bsc", "ba", "beng", "bachelor of science", "bachelor of arts"],
    "master": ["master", "msc", "ma", "meng", "mba", "master of science", "master of arts"],
    "postgraduate": ["postgraduate", "pg", "postgrad"],
    "phd": ["phd", "dphil", "doctorate", "doctor of philosophy"],
    "diploma": ["diploma"],
    "certificate": ["certificate", "cert"],
}
# Synonyms of study modes.
MODES = {
    "full_time": ["full time", "full-time", "fulltime", "ft", "full_time"],
    "part_time": ["part time", "part-time", "parttime", "pt", "part_time"],
    "distance_learning": ["distance", "distance learning", "distance_learning"],
    "online": ["online", "e-learning"],
    "sandwich": ["sandwich", "sandwich course", "sandwich_course"],
    "other": ["other"],
}
# Words that carry no search weight.
STOPWORDS = [
    "the", "a", "an", "and", "or", "of", "to", "in", "for", "is", "are", "do", "does", "what", "how",
    "can", "i", "my",
]


#: All space characters (Zs of Unicode), which trim of the check SQL takes off; Spark's takes off the first alone.
SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def _lookup(key: Column, groups: dict[str, list[str]]) -> Column:
    pairs = ((F.lit(s), F.lit(name)) for name, synonyms in groups.items() for s in synonyms)
    return F.create_map(*chain.from_iterable(pairs))[key]


def trimmed(c: Column) -> Column:
    """Without space characters at both ends.  One argument: F.transform would give F.trim an element's place as characters to trim."""
    return F.trim(c, F.lit(SPACES))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def clean_text(c: Column) -> Column:
    """White space runs become one space; nothing left becomes NULL."""
    return blank_to_null(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")))


def clean_fees(c: Column) -> Column:
    return blank_to_null(F.regexp_replace(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")), r"([£$€])\s*([0-9])", "$1$2"))


def parse_price(c: Column) -> Column:
    """The first number with optional thousands commas; NULL if there is none."""
    return F.replace(blank_to_null(F.regexp_extract(c, r"[\d,]+(?:\.\d+)?", 0)), F.lit(",")).try_cast("double")


def known_level(c: Column) -> Column:
    """A level by its synonyms, also after leaving out what follows "in", "of" or "honours"."""
    v = F.lower(F.trim(c))
    short = F.trim(F.regexp_replace(v, r"(?s)\b(in|of|with honours|honours)\b.*$", ""))
    return F.coalesce(_lookup(v, LEVELS), _lookup(short, LEVELS))


def normalize_level(c: Column) -> Column:
    return F.when(c != "", F.coalesce(known_level(c), clean_text(c)))


def normalize_study_mode(c: Column) -> Column:
    return F.when(c != "", F.coalesce(_lookup(F.lower(F.trim(c)), MODES), clean_text(c)))


def all_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))


def token_set(c: Column) -> Column:
    return F.array_distinct(all_tokens(c))


def tokenize(c: Column) -> Column:
    """Lower-case alphanumeric tokens without stopwords, in order."""
    return F.filter(all_tokens(c), lambda t: ~t.isin(STOPWORDS))


def word_count(c: Column) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(r"(?U)\S+")), F.lit(0))
