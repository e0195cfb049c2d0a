"""Small text functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that a page must not contain as they are, in the order of replacement.
ESCAPES = (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"), ("/", "&#x2F;"))
#: Accented letters and the plain ones that they fold to.
ACCENTED = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyy"


def luhn_valid(value: Column) -> Column:
    """Do the 13 to 19 digits of a card number check?"""
    digits = F.regexp_replace(value, r"\D", "")
    return F.length(digits).between(13, 19) & F.coalesce(F.call_function("luhn_check", digits), F.lit(False))


def iban_format(value: Column) -> Column:
    """Has it the form of an international account number (15 to 34 characters)? Blanks don't count; check digits aren't tested."""
    return F.regexp_replace(value, r"\s", "").rlike(r"\A[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}\z")


def snippet(text: Column, size: int = 120) -> Column:
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size - 3), F.lit("..."))).otherwise(text)


def html_escaped(text: Column) -> Column:
    for plain, safe in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def html_text(page: Column) -> Column:
    """A page without scripts, styles and tags."""
    bare = F.regexp_replace(page, r"(?is)<(script|style)[^>]*>.*?</(?:script|style)>", " ")
    return F.regexp_replace(bare, r"<[^>]*>", " ")


def without_accents(text: Column) -> Column:
    return F.translate(text, ACCENTED, PLAIN)
