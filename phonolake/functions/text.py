"""Text functions: tokens, path stems, sub-words and letters back to words, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters a plain whitespace split breaks at, besides the blank.
SPACES = (
    "\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Sub-word clean-up drops the blank before these piece starts.
CLEANUP_PUNCTUATION = r" ([.?!,])"
CLEANUP_CONTRACTION = r" (n't|'m|'s|'ve|'re)"


def tokens(text: Column) -> Column:
    """Tokens between runs of whitespace; empty text has none.

    Every space becomes a blank first, as splitting at one character needs no
    regular expression; runs leave empty tokens, which are removed.
    """
    return F.array_remove(F.split(F.translate(text, SPACES, " " * len(SPACES)), " "), "")


def tokens_strict(text: Column) -> Column:
    """Tokens between single blanks; empty text has one empty token."""
    return F.split(text, " ", -1)


def strip(text: Column) -> Column:
    """Text without whitespace at either end."""
    return F.btrim(text, F.lit(SPACES + " "))


def squeeze(text: Column) -> Column:
    """Tokens joined again by single blanks."""
    return F.array_join(tokens(text), " ")


def path_stem(path: Column) -> Column:
    """Last part of a path without its last suffix; dot-files keep their name."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.regexp_replace(name, r"(?<!^)\.[^.]+$", "")


def pieces_to_words(pieces: Column, cleanup: bool = True) -> Column:
    """Space-joined sub-word pieces to words.

    ``##`` pieces are glued to the piece before, a free-standing apostrophe is
    glued on both sides, a ``##`` left at the very start is deleted. ``cleanup``
    also glues pieces that start with punctuation or a contraction.
    """
    words = F.replace(pieces, F.lit(" ##"), F.lit(""))
    if cleanup:
        words = F.regexp_replace(words, CLEANUP_PUNCTUATION, "$1")
        words = F.regexp_replace(words, CLEANUP_CONTRACTION, "$1")
    words = F.replace(words, F.lit(" ' "), F.lit("'"))
    return F.replace(words, F.lit("##"), F.lit(""))


def letters_to_words(letters: Column, words: Column | None = None) -> Column:
    """Space-joined letters with ``|`` at word ends to words; a decoder's own words win."""
    joined = F.trim(F.replace(F.replace(letters, F.lit(" "), F.lit("")), F.lit("|"), F.lit(" ")))
    return joined if words is None else F.coalesce(F.array_join(words, " "), joined)


def units_to_words(units: Column, label_kind: Column, words: Column | None = None) -> Column:
    """Choose the post-processing by label kind: ``wp``, ``ltr`` or ``phn``."""
    return (
        F.when(label_kind == "wp", pieces_to_words(units))
        .when(label_kind == "ltr", letters_to_words(units, words))
        .when(label_kind == "phn", units)
        .otherwise(F.raise_error(F.concat(F.lit("unknown label kind: "), label_kind)))
    )


def fingerprint(text: Column, modulus: int = 1_000_000) -> Column:
    """md5 of the text, read as one 128-bit number, modulo ``modulus``."""
    digest = F.md5(text)
    value = F.lit(0).cast("bigint")
    for start in range(1, 33, 4):
        digit = F.conv(F.substring(digest, start, 4), 16, 10).cast("bigint")
        value = (value * 65536 + digit) % modulus
    return value
