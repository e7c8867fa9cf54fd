"""Text functions: the tokenizer and line flattening."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a digit, as a letter, and what joins flattened lines.
DIGITS = "[0-9]+"
NON_LETTERS = "[^a-zA-Z]+"
LINE_JOIN = " --- "


def tokens(text: Column | str) -> Column:
    """The lower-case ASCII words of a text, as an array in text order.

    Digits vanish first, so ``a1b`` is the one word ``ab``; every other run of
    characters that are not ASCII letters separates words, so ``don't`` gives
    ``don`` and ``t`` and an accented letter cuts its word.  A text without any
    letter gives one empty token.  Only two regular expressions run per text: a
    whole run of separators, blanks included, becomes one blank at once.
    """
    text = F.col(text) if isinstance(text, str) else text
    no_digits = F.regexp_replace(text, DIGITS, "")
    words = F.regexp_replace(no_digits, NON_LETTERS, " ")
    return F.split(F.trim(F.lower(words)), " ")


def cut_text(text: Column | str, size: int) -> Column:
    """The text as an array of parts of at most ``size`` characters, cut between words.

    Joined, the parts are the text.  No cut falls between two ASCII letters or digits, so
    the words of the parts are the words of the text; a longer run of those stays whole.
    One pass over the text; a shorter text is its only part.
    """
    text = F.col(text) if isinstance(text, str) else text
    part = f"(?s).{{1,{size}}}(?:(?<![0-9a-zA-Z])|(?![0-9a-zA-Z]))|[0-9a-zA-Z]++"
    return F.when(F.char_length(text) > size, F.regexp_extract_all(text, F.lit(part), F.lit(0))).when(text.isNotNull(), F.array(text))


def flatten_lines(text: Column | str) -> Column:
    """One line per text: newlines become `` --- `` and bad UTF-8 becomes U+FFFD."""
    text = F.col(text) if isinstance(text, str) else text
    return F.replace(F.make_valid_utf8(text), F.lit("\n"), F.lit(LINE_JOIN))
