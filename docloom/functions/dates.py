"""Dates in texts: spans by priority, and partial matches of two dates.

The order-dependent resolution of overlapping spans runs in an Arrow function;
everything else is column work.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.lexicon import MONTHS_EN, MONTHS_FR, SHORT_EN, SHORT_FR

#: Names of each month, long and short.
MONTH_NAMES = [[en, fr, *(x for x in SHORT_EN if en.startswith(x)), *(x for x in SHORT_FR if fr.startswith(x))] for en, fr in zip(MONTHS_EN, MONTHS_FR, strict=True)]
DAY, YEAR = r"(?:0?[1-9]|[12][0-9]|3[01])", r"(?:19|20)\d{2}"
TH, ER = r"(?:st|nd|rd|th)?", r"(?:er|ère|ème|e|è)?"
EN, FR = "(?:" + "|".join(MONTHS_EN) + ")", "(?:" + "|".join(MONTHS_FR) + ")"
EN_SHORT, FR_SHORT = "(?:" + "|".join(SHORT_EN) + r")\.?", "(?:" + "|".join(SHORT_FR) + r")\.?"
LEAD = r"(?:dated|dated\s+as\s+of|as\s+of|effective\s+date|with\s+effect\s+from|en\s+date\s+du)[\s:]+"
ANY_EN, ANY_FR = "(?:" + "|".join(MONTHS_EN + SHORT_EN) + r")\.?", "(?:" + "|".join(MONTHS_FR + SHORT_FR) + r")\.?"
#: Fixed values, from the parts above: groups in order of priority; in a group the order of patterns.
GROUPS = [
    [rf"{LEAD}{DAY}{TH}\s+{ANY_EN},?\s+{YEAR}", rf"{LEAD}{ANY_EN}\s+{DAY}{TH},?\s+{YEAR}", rf"(?:from|du)\s+{DAY}{TH}\s+{ANY_EN},?\s+{YEAR}\s+(?:to|au|jusqu'au)\s+{DAY}{TH}\s+{ANY_EN},?\s+{YEAR}", rf"\bsigned\s+on\s+{DAY}{TH}\s+{ANY_EN},?\s+{YEAR}\b", rf"\bsigné\s+le\s+{DAY}{ER}\s+{ANY_FR}\s+{YEAR}\b", rf"\ble\s+{DAY}{ER}\s+{FR}\s+{YEAR}\b"],
    [rf"\b{EN}\s+{DAY}{TH},?\s+{YEAR}\b", rf"\b{DAY}{TH}\s+{EN}\s+{YEAR}\b", rf"\b{EN_SHORT}\s+{DAY}{TH},?\s+{YEAR}\b", rf"\b{DAY}{TH}\s+{EN_SHORT}\s+{YEAR}\b", rf"\b{DAY}{ER}\s+{FR}\s+{YEAR}\b", rf"\b{DAY}{ER}\s+{FR_SHORT}\s+{YEAR}\b"],
    [rf"\b{DAY}[/-](?:0?[1-9]|1[0-2])[/-]{YEAR}\b", rf"\b{YEAR}[/-](?:0?[1-9]|1[0-2])[/-]{DAY}\b", rf"\b{DAY}\.(?:0?[1-9]|1[0-2])\.{YEAR}\b", rf"\b(?:0?[1-9]|1[0-2])\.{DAY}\.{YEAR}\b"],
    [rf"\bQ[1-4]\s+{YEAR}\b", rf"\b(?:1st|2nd|3rd|4th|first|second|third|fourth)\s+quarter\s+(?:of\s+)?{YEAR}\b", rf"\b(?:1er|2e|3e|4e|premier|deuxième|troisième|quatrième)\s+trimestre\s+(?:de\s+)?{YEAR}\b", rf"\b(?:{EN}|{EN_SHORT})\s+{YEAR}\b", rf"\b(?:{FR}|{FR_SHORT})\s+{YEAR}\b"],
]
#: Patterns with context words take the place of what they overlap, the later ones too, so these come first and from the last to the first.
BY_PRIORITY = [re.compile(p, re.IGNORECASE) for p in (*GROUPS[0][::-1], *(p for group in GROUPS[1:] for p in group))]


def found_dates(text: str | None) -> list[str]:
    """Distinct dates, sorted; of matches that overlap or touch, the one of highest priority stays."""
    text, taken = text or "", []
    for pattern in BY_PRIORITY:
        for m in pattern.finditer(text):
            start, end = m.span()
            k = bisect_left(taken, (start, end))
            if (k == 0 or taken[k - 1][1] < start) and (k == len(taken) or end < taken[k][0]):
                taken.insert(k, (start, end))
    return sorted({text[a:b] for a, b in taken})


def detect_dates(text: Column) -> Column:
    """``array<string>``; null texts have none.  Only texts with a year reach Python."""

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(found_dates)

    return F.coalesce(run(F.when(text.rlike(r"(?:19|20)[0-9]{2}"), text)), F.array().cast("array<string>"))


def iso_dates(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"((?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2})"), F.lit(1))


def month_of(date: Column) -> Column:
    """The month of a date in numbers or with an English or French month name, else null."""
    number = F.coalesce(F.nullif(F.regexp_extract(date, r"^[0-9]{4}[-/]([0-9]{1,2})", 1), F.lit("")), F.nullif(F.regexp_extract(date, r"(?:^|[0-9]{1,2}[-/.])([0-9]{1,2})[-/.][0-9]{4}$", 1), F.lit("")))
    named = [F.when(date.rlike(rf"(?iu)(^|[^\p{{L}}])({'|'.join(names)})($|[^\p{{L}}])"), F.lit(k + 1)) for k, names in enumerate(MONTH_NAMES)]
    return F.coalesce(number.cast("int"), *named)


def partial_match(a: Column, b: Column, strict_year: bool = True) -> Column:
    """Whether two dates can be the same: equal years (or centuries, not ``strict_year``), equal months where both name one, and a number from 1 to 31 in common where both have such.

    Reads ``D/M/Y``, ``Y-M-D``, ``M/Y``, ``Y`` and month names in English or French.
    """
    year = lambda d: F.regexp_extract(d, r"((?:19|20)[0-9]{2})" if strict_year else r"(19|20)[0-9]{2}", 1)
    years = (year(a) == "") | (year(b) == "") | (year(a) == year(b))
    months = month_of(a).isNull() | month_of(b).isNull() | (month_of(a) == month_of(b))
    numbers = lambda d: F.regexp_extract_all(d, F.lit(r"\b(0?[1-9]|[12][0-9]|3[01])(?:st|nd|rd|th)?\b"), F.lit(1))
    days = (F.size(numbers(a)) == 0) | (F.size(numbers(b)) == 0) | F.arrays_overlap(numbers(a), numbers(b))
    return years & months & days
