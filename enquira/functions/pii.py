"""Redaction of personal data by ordered rules."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Markers and patterns in the order in which they apply; passport ranges and
# addresses of machines come before telephone numbers.
RULES = [
    ("EMAIL", r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"),
    ("PASSPORT", r"\b\d{4}[\-–]\d{4}\b"),
    ("IP", r"\b(?:\d{1,3}\.){3}\d{1,3}\b"),
    ("PHONE", r"(?<![\d-])(?:\+?\d{1,3}[\s\-.]?)?(?:\(\d{1,3}\)[\s\-.]?)?(?:\d{3}[\s\-.]?\d{3}[\s\-.]?\d{3,4}|\d{10,12})(?![\d-])"),
    ("AMOUNT", r"(?i)(?:[$£€]\s*[\d,]+(?:\.\d+)?(?:[km]|million|thousand|pounds|sterling|shillings)?|\b(?:kes|ksh|usd|gbp|eur|aed|pounds|sterling|shillings|euros|dollars)\s*[\d,]+(?:\.\d+)?|\b[\d,]+(?:\.\d+)?\s*(?:million|thousand|pounds|sterling|shillings|[km])\b|\b\d{1,3}(?:,\d{3})+(?:\.\d+)?\b)"),
    ("ADDRESS", r"(?i)\b(?:\d{1,5}[\s-])?(?:[a-z0-9.\-]+\s){1,4}?(?:road|street|avenue|lane|boulevard|drive|close|park|estate|floor|plaza|tower|box|chiromo|westlands|nairobi)\s*(?:[a-z0-9.\-]+\s?){0,3}?"),
    ("SOCIAL", r"(?i)\b(?:facebook\.com|twitter\.com|instagram\.com|linkedin\.com|youtube\.com|@)\S+"),
]
_EMAIL = r"[A-Za-z0-9._%+\-]"
#: The same matches for Spark's engine with less trying: a match starts where its run of characters or the search does, what
#: the next part cannot give back is not tried again, and a first character says whether a rule can begin.
_QUICK = {
    "EMAIL": rf"(?:(?<!{_EMAIL})|\G){_EMAIL}++@[A-Za-z0-9.\-]+\.[A-Za-z]{{2,}}",
    "PHONE": r"(?=[+(\d])" + dict(RULES)["PHONE"],
    "AMOUNT": dict(RULES)["AMOUNT"].replace("(?i)", r"(?i)(?=[$£€\d,kugeapsd])", 1),
    "ADDRESS": r"\b(?:\d{1,5}[\s-])?(?:[A-Za-z0-9.\-]++\s){1,4}?(?=[RrSsAaLlBbDdCcPpEeFfTtWwNn])(?i:" + re.search(r"\?:(road.*nairobi)\)", dict(RULES)["ADDRESS"])[1] + r")\s*",
}
_RUN = [(m, _QUICK.get(m, p)) for m, p in RULES]
# Fixed value: the counsellor's name in a form's subject.
FORM_NAME = r"(?i)(Counsellor Assessment Form\s*-\s*)[A-Z][A-Za-z&.'\- ]*?(?=\s*-\s*(?:Cold|Good|Excellent|Warm|Hot)\b)"


def name_pattern(names: list[str]) -> str:
    return r"(?i)\b(" + "|".join(names) + r")\b"


def redact(c: Column, names: list[str] | None = None) -> Column:
    """Two passes of all rules, then of counsellor and listed names; NULL becomes ""."""
    v = F.trim(F.coalesce(c, F.lit("")))
    for _ in range(2):
        for marker, pattern in _RUN:
            v = F.regexp_replace(v, pattern, f"[{marker}_REDACTED]")
        v = F.regexp_replace(v, FORM_NAME, "$1[NAME_REDACTED]")
        if names:
            v = F.regexp_replace(v, name_pattern(names), "[NAME_REDACTED]")
    return F.trim(F.regexp_replace(v, r"\s+", " "))


def counts(c: Column, names: list[str] | None = None) -> Column:
    """A map from marker to the number of matches."""
    found = [(F.lit(m), F.regexp_count(c, F.lit(p))) for m, p in _RUN]
    by_name = F.regexp_count(c, F.lit(FORM_NAME))
    if names:
        by_name = by_name + F.regexp_count(c, F.lit(name_pattern(names)))
    return F.create_map(*(x for pair in [*found, (F.lit("NAME"), by_name)] for x in pair))


def has_pii(c: Column, names: list[str] | None = None) -> Column:
    patterns = [p for _, p in _RUN] + [FORM_NAME] + ([name_pattern(names)] if names else [])
    out = F.lit(False)
    for p in patterns:
        out = out | c.rlike(p)
    return F.coalesce(out, F.lit(False))
