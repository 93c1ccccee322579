"""Attribute values in free text: extraction, errors, masks, stop conditions.

ASCII semantics throughout: digits are 0-9, words are ASCII words.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The attributes, the longest token sequence of each, and the blood types.
ATTRIBUTES = ("year_of_birth", "address_postcode", "social_insurance_number", "blood_type")
MAX_POSITIONS = {"year_of_birth": 5, "address_postcode": 7, "social_insurance_number": 10, "blood_type": 2}
BLOOD_TYPES = ("A+", "A-", "B+", "B-", "AB+", "AB-", "O+", "O-")
_BLOOD = r"A\+|A-|B\+|B-|AB\+|AB-|O\+|O-"


def strip(text: Column) -> Column:
    """Without white space (of any kind) at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def year(text: Column) -> Column:
    """The first year of the last or this century that stands by itself, else 0."""
    return F.coalesce(F.regexp_substr(text, F.lit(r"\b(19|20)\d{2}\b")).cast("int"), F.lit(0))


def digits(text: Column, most: int) -> Column:
    return F.substring(F.regexp_replace(text, r"[^0-9]", ""), 1, most)


def postcode(text: Column) -> Column:
    return F.regexp_substr(text, F.lit("([A-Z][0-9]){3}"))


def blood_type(text: Column) -> Column:
    return F.regexp_substr(F.upper(text), F.lit(_BLOOD))


def year_error(predicted: Column, truth: Column) -> Column:
    return F.least(F.abs(year(predicted) - year(truth)), F.lit(20)) / F.lit(20.0)


def digit_error(predicted: Column, truth: Column) -> Column:
    return F.levenshtein(digits(predicted, 9), digits(truth, 9)) / F.lit(9.0)


def hamming(a: Column, b: Column) -> Column:
    """Places that differ; 6 for unequal lengths."""
    pairs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("int"))
    return F.when(F.length(a) != F.length(b), F.lit(6)).otherwise(F.aggregate(pairs, F.lit(0), lambda s, v: s + v))


def postcode_error(predicted: Column, truth: Column) -> Column:
    """1 without a predicted code; a truth without a code is an error of the data."""
    true_code = F.coalesce(postcode(truth), F.raise_error(F.lit("the true answer has no postcode")).cast("string"))
    return F.when(postcode(predicted).isNull(), F.lit(1.0)).otherwise(hamming(postcode(predicted), true_code) / F.lit(6.0))


def blood_error(predicted: Column, truth: Column) -> Column:
    return (~blood_type(predicted).eqNullSafe(blood_type(truth))).cast("double")


def attribute_error(predicted: Column, truth: Column, attribute: Column) -> Column:
    """Normalised error of a prediction by the attribute's own rule; an unknown attribute raises."""
    rules: dict[str, Callable[[Column, Column], Column]] = {
        "year_of_birth": year_error,
        "social_insurance_number": digit_error,
        "address_postcode": postcode_error,
        "blood_type": blood_error,
    }
    p, t = strip(predicted), strip(truth)
    out = F.when(F.lit(False), F.lit(0.0))
    for name, rule in rules.items():
        out = out.when(attribute == name, rule(p, t).cast("double"))
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown attribute: "), F.coalesce(attribute, F.lit("null")))).cast("double"))


def answer_value(text: Column, attribute: Column) -> Column:
    """The value that an answer states: looser rules than those of the errors."""
    t = strip(text)
    return (
        F.when(attribute == "year_of_birth", digits(t, 4))
        .when(attribute == "social_insurance_number", digits(t, 9))
        .when(attribute == "address_postcode", F.regexp_substr(t, F.lit("[A-Z0-9]{6}")))
        .when(attribute == "blood_type", blood_type(t))
        .otherwise(F.raise_error(F.concat(F.lit("unknown attribute: "), attribute)).cast("string"))
    )


def mask_value(text: Column, attribute: Column) -> Column:
    """The text without the value (and a full stop after it), white space collapsed."""
    #: Fixed value: the spelling of the masked types, in the order in which they are tried.
    blood = r"A\+\.?|A-\.?|B\+\.?|B-\.?|AB\+\.?|AB-\.?|O\+\.?|O-\.?"
    bare = (
        F.when(attribute == "blood_type", F.regexp_replace(text, blood, ""))
        .when(attribute.isin("year_of_birth", "social_insurance_number"), F.regexp_replace(text, r"[0-9]+\.?", ""))
        .when(attribute == "address_postcode", F.regexp_replace(text, r"[0-9A-Z]{6}\.?", ""))
        .otherwise(text)
    )
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def complete(text: Column, attribute: Column, newline: Column | None = None) -> Column:
    """Whether a decoded value is complete, so that decoding stops."""
    stripped = F.regexp_replace(text, r"^\s+|\s+$", "")
    done = (
        F.when(attribute == "year_of_birth", text.rlike(r"^\s*[0-9]{4}\.\z"))
        .when(attribute == "address_postcode", text.rlike(r"^\s*[A-Z][0-9][A-Z][0-9][A-Z][0-9]\.\z"))
        .when(attribute == "social_insurance_number", (F.length(F.regexp_replace(text, "[^0-9]", "")) >= 9) | F.endswith(text, F.lit(".")))
        .when(attribute == "blood_type", stripped.isin(*BLOOD_TYPES) | F.endswith(stripped, F.lit(".")))
        .otherwise(F.lit(False))
    )
    return done if newline is None else (newline | done)
