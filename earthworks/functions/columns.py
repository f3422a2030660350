"""Column expressions shared by the jobs, all built-in functions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from earthworks.sources import catalog

NO_LABEL = "—"
GENERAL = "Général"
NO_DELIVERABLE = "Sans livrable"

# Letters folded by the name normaliser and what becomes of signs.
_FOLD_FROM = "éèêëàâùûôîïç"
_FOLD_TO = "eeeeaauuoiic"
_SIGNS_TO_UNDERSCORE = " /-."
_SIGNS_DROPPED = "()°"


def zero_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(0))


# All white space, no-break and other wide spaces included.
_SPACE = r"[\s\p{Z}\x1C-\x1F\x85]"
VISIBLE = r"[^\s\p{Z}\x1C-\x1F\x85]"
_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def strip(c: str | Column) -> Column:
    """Text without white space of any kind at its ends."""
    return F.regexp_replace(c if isinstance(c, Column) else F.col(c), f"^{_SPACE}+|{_SPACE}+$", "")


def blank_to_null(c: str | Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def or_label(c: str | Column, label: str = NO_LABEL) -> Column:
    return F.coalesce(c if isinstance(c, Column) else F.col(c), F.lit(label))


def amount(quantity: str, price: str) -> Column:
    return F.col(quantity) * F.col(price)


def signed(kind: str, value: str, plus: list[str], minus: list[str]) -> Column:
    """Value with the sign its kind gives it; other kinds count for nothing."""
    return (
        F.when(F.col(kind).isin(plus), F.col(value))
        .when(F.col(kind).isin(minus), -F.col(value))
        .otherwise(F.lit(0))
    )


def percent(part: Column, whole: Column) -> Column:
    """Share in percent to one decimal, 0 where the whole is 0 or missing."""
    ratio = part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0)) * 100
    return F.coalesce(F.round(ratio, 1), F.lit(0.0))


def percent_of_one(part: Column, whole: Column) -> Column:
    """As ``percent`` but a whole of 0 counts as 1, the rule of the reports."""
    base = F.coalesce(F.nullif(whole.cast("double"), F.lit(0.0)), F.lit(1.0))
    return F.round(part.cast("double") / base * 100, 1)


def remaining(whole: Column, done: Column) -> Column:
    """What is left, never below zero."""
    left = whole - done
    return F.when(left > 0, left).otherwise(F.lit(0))


def money_text(value: Column, currency: str = "FCFA") -> Column:
    """No decimals, blanks between thousands, then the currency symbol."""
    digits = F.translate(F.format_number(value.cast("double"), 0), ",", " ")
    return F.coalesce(F.concat(digits, F.lit(" " + catalog.CURRENCY_SYMBOLS[currency])), F.lit("0"))


def percent_text(value: Column) -> Column:
    rounded = F.round(value.cast("double"), 1)
    return F.when(rounded.isNull(), "0.0 %").otherwise(F.format_string("%.1f %%", rounded))


def normalised_name(c: str | Column) -> Column:
    """Lower-case ASCII name with single underscores, for matching headers."""
    text = F.lower(strip(c))
    text = F.translate(text, _FOLD_FROM + _SIGNS_TO_UNDERSCORE + _SIGNS_DROPPED,
                       _FOLD_TO + "_" * len(_SIGNS_TO_UNDERSCORE))
    text = F.replace(F.replace(text, F.lit("œ"), F.lit("oe")), F.lit("æ"), F.lit("ae"))
    return F.btrim(F.regexp_replace(text, "_+", "_"), F.lit("_"))


def to_number(c: str | Column) -> Column:
    """Number in a text cell, 0 where there is none."""
    text = strip(c)
    return F.coalesce(F.when(text.rlike(_NUMBER), text.try_cast("double")), F.lit(0.0))


def has_name(c: str | Column) -> Column:
    """True where a designation is neither blank nor a written "nan"."""
    return ~F.coalesce(strip(c), F.lit("")).isin("", "nan", "None")


def line_key(code: str, designation: str, unit: str) -> Column:
    """Code in lower case, or designation and unit where there is no code."""
    given = F.trim(F.col(code))
    fallback = F.concat(
        F.lower(F.trim(F.col(designation))), F.lit("|"), F.lower(F.trim(F.col(unit)))
    )
    return F.when(~F.coalesce(given, F.lit("")).isin("", "nan", "None"), F.lower(given)).otherwise(fallback)


def delay(start: str, days: str, as_of: dt.date) -> dict[str, Column]:
    """Days consumed, days left and share of the delay, from the start date."""
    known = F.col(start).isNotNull() & (zero_if_null(F.col(days)) != 0)
    elapsed = F.datediff(F.lit(as_of), F.col(start))
    whole = zero_if_null(F.col(days)).cast("int")
    share = F.round(elapsed.cast("double") / F.col(days).cast("double") * 100, 1)
    return {
        "jours_consommes": F.when(known, F.greatest(F.lit(0), elapsed)).otherwise(0),
        "jours_restants": F.when(known, whole - elapsed).otherwise(whole),
        "pct_delai": F.when(known, F.least(F.lit(100.0), share)).otherwise(0.0),
    }


def delay_band(pct: Column) -> Column:
    return F.when(pct < 75, "ok").when(pct < 100, "a surveiller").otherwise("en retard")


# Headings of the parts of a diary note.
_NOTE_TAGS = {
    "incidents": "INCIDENTS/SÉCURITÉ: ",
    "livraisons": "LIVRAISONS/RÉCEPTIONS: ",
    "visites": "VISITES/RÉUNIONS: ",
    "observations": "OBSERVATIONS: ",
}


def tagged_note(**parts: Column) -> Column:
    """Non-blank parts, each under its heading, one per line."""
    tagged = [
        F.concat(F.lit(_NOTE_TAGS[name]), blank_to_null(part)) for name, part in parts.items()
    ]
    return F.concat_ws("\n", *tagged)


def unit_or_mark(c: str) -> Column:
    return F.coalesce(blank_to_null(c), F.lit("?"))


def is_known_unit(c: str) -> Column:
    return F.coalesce(strip(c).isin(catalog.UNITS), F.lit(False))
