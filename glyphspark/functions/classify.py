"""Character classes as column expressions.

A classifier gives ``structural``, ``lexical``, ``ambiguous`` or ``other``, or null where a character
is left out. The variants differ in their sets, in what they do with blanks, and in their order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The character sets of the published classes.
NL_STRUCTURAL = ",.;:?!'\"()[]{}"
CODE_SYNTAX = "()[]{},:;=.@+-*/%&|^~<>"
CODE_IDENTITY = CODE_SYNTAX + "!?"
JS_SYNTAX = CODE_SYNTAX + "!?\\#"
AMBIGUOUS = " \n\t"
ASCII_LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
DIGITS = "0123456789"

#: Letters and decimal digits; the digits beyond those that count as digits elsewhere follow.
_ALNUM = r"^[\p{L}\p{Nd}²³¹⁰⁴-⁹₀-₉①-⑨]$"


def _in(ch: Column, chars: str) -> Column:
    return ch.isin(*chars)


def _alnum(ch: Column) -> Column:
    return ch.rlike(_ALNUM)


def nl(ch: Column, stratum: Column | None = None) -> Column:
    """Natural language: punctuation, then blanks as ambiguous, then letters and digits."""
    return F.when(_in(ch, NL_STRUCTURAL), "structural").when(_in(ch, AMBIGUOUS), "ambiguous").when(_alnum(ch), "lexical").otherwise("other")


def nl_profile(ch: Column, stratum: Column | None = None) -> Column:
    """As ``nl``, but a space is lexical and no class is ambiguous."""
    return F.when(_in(ch, NL_STRUCTURAL), "structural").when(_alnum(ch) | (ch == " "), "lexical").otherwise("other")


def code(ch: Column, stratum: Column) -> Column:
    """Source code with strata: strings and comments are left out, syntax in code is structural."""
    return (
        F.when(stratum.isin("string", "comment"), "other")
        .when((stratum == "syntax") & _in(ch, CODE_SYNTAX), "structural")
        .when((stratum == "whitespace") | _in(ch, AMBIGUOUS), "ambiguous")
        .when(stratum.isin("keyword", "identifier", "numeric") | _alnum(ch), "lexical")
        .otherwise("other")
    )


def code_profile(ch: Column, stratum: Column) -> Column:
    """As ``code`` without an ambiguous class."""
    return (
        F.when(stratum.isin("string", "comment"), "other")
        .when((stratum == "syntax") & _in(ch, CODE_SYNTAX), "structural")
        .when(stratum.isin("keyword", "identifier", "numeric"), "lexical")
        .otherwise("other")
    )


def code_identity(ch: Column, stratum: Column | None = None) -> Column:
    """Source code by the character alone; the underscore is lexical."""
    return F.when(_in(ch, CODE_IDENTITY), "structural").when(_alnum(ch) | (ch == "_"), "lexical").otherwise("other")


def js_identity(ch: Column, stratum: Column | None = None) -> Column:
    """Candidates of the stratified JavaScript analysis: syntax characters, letters, digits, marks and space."""
    return F.when(_in(ch, JS_SYNTAX), "structural").when(_alnum(ch) | ch.isin("_", "$", " "), "lexical").otherwise("other")


def ascii_sets(with_digits: bool) -> Callable[..., Column]:
    """Membership classes of the sensitivity runs: ASCII letters, with digits and space or without."""
    lexical = ASCII_LETTERS + (DIGITS + " " if with_digits else "")
    return lambda ch, stratum=None: F.when(_in(ch, NL_STRUCTURAL), "structural").when(_in(ch, lexical), "lexical").otherwise("other")


CLASSIFIERS: dict[str, Callable[..., Column]] = {
    "nl": nl,
    "nl_profile": nl_profile,
    "code": code,
    "code_profile": code_profile,
    "code_identity": code_identity,
    "js_identity": js_identity,
    "ascii_alnum_space": ascii_sets(True),
    "ascii_letters": ascii_sets(False),
}
