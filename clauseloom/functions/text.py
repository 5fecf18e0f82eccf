"""Text functions. Every one is a Column expression evaluated inside the JVM; none is a UDF.

Character classes are spelled out because the engines' shorthand classes differ outside ASCII: these give the same
answer in Java, RE2 and Python on arbitrary Unicode text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITESPACE = r"\t-\r\x1c-\x20\x{85}\x{a0}\p{Z}"
WORD = r"\p{L}\p{N}_"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def collapse_whitespace(text: Column | str) -> Column:
    """Turn every run of Unicode white space into one space.

    The pattern skips lone spaces: they would only be replaced by themselves, once per word.
    """
    changing = f"[{WHITESPACE}&&[^ ]][{WHITESPACE}]*+| [{WHITESPACE}]++"
    return F.regexp_replace(_col(text), changing, " ")


def strip_symbols(text: Column | str) -> Column:
    """Drop everything but word characters, spaces and ``. , ; : ! ? ( ) -``."""
    return F.regexp_replace(_col(text), f"[^{WORD} .,;:!?()-]+", "")


def strip_page_numbers(text: Column | str) -> Column:
    """Drop ``Page <number>`` in any letter case, also inside a longer word."""
    return F.regexp_replace(_col(text), r"[Pp][Aa][Gg][Ee] \p{Nd}+", "")


def blank_digit_text(text: Column | str) -> Column:
    """Empty a text that consists of digits and trailing spaces only."""
    return F.regexp_replace(_col(text), r"^\p{Nd}+ *$", "")


def normalize_text(text: Column | str, remove_page_numbers: bool = True) -> Column:
    """Normalise a raw document: white space, symbols, page numbers, then trim.

    Symbols go before page numbers, so ``Page #12`` disappears as well; blanks left behind by removed pieces stay.
    """
    out = strip_symbols(collapse_whitespace(text))
    if remove_page_numbers:
        out = blank_digit_text(strip_page_numbers(out))
    return F.trim(out)


def text_length(text: Column | str) -> Column:
    """Length in code points."""
    return F.length(_col(text))


def word_count(text: Column | str) -> Column:
    """Number of white-space separated words."""
    return F.regexp_count(_col(text), F.lit(f"[^{WHITESPACE}]+"))


def preview(text: Column | str, size: int = 500) -> Column:
    """The first ``size`` characters, with ``...`` only if something was cut."""
    t = _col(text)
    return F.when(F.length(t) > size, F.concat(F.substring(t, 1, size), F.lit("..."))).otherwise(t)


def snippet(text: Column | str, size: int = 100) -> Column:
    """The first ``size`` characters, always followed by ``...``."""
    return F.concat(F.substring(_col(text), 1, size), F.lit("..."))


def head(text: Column | str, size: int = 4000) -> Column:
    """The first ``size`` characters, as put into a prompt."""
    return F.substring(_col(text), 1, size)


def was_truncated(text: Column | str, size: int) -> Column:
    """Whether ``head(text, size)`` loses anything."""
    return F.length(_col(text)) > size


def clean_response(text: Column | str) -> Column:
    """Strip Unicode white space from both ends of a model response."""
    return F.regexp_replace(_col(text), f"^[{WHITESPACE}]+|[{WHITESPACE}]+$", "")


def estimate_tokens(text: Column | str, chars_per_token: int = 4) -> Column:
    """Token estimate of a prompt: one token per ``chars_per_token`` characters, rounded up."""
    return F.ceil(F.length(_col(text)) / F.lit(chars_per_token)).cast("int")


def mentions_word(text: Column | str, word: str) -> Column:
    """Whether ``word`` occurs in the text in any letter case."""
    return F.lower(_col(text)).contains(word.lower())


def file_name(path: Column | str) -> Column:
    """Last segment of a path."""
    return F.element_at(F.split(_col(path), "/"), -1)


def file_extension(name: Column | str) -> Column:
    """Lower-cased suffix of a file name without its dot; empty if there is none."""
    return F.regexp_extract(F.lower(file_name(name)), r"[^.]\.([^.]+)$", 1)


def sentences(text: Column | str) -> Column:
    """Split a text into sentences; each keeps its closing ``.``, ``!`` or ``?`` and its leading blank.

    The parts joined together give the text back, but for stops at its very start.
    """
    return F.regexp_extract_all(_col(text), F.lit("[^.!?]++[.!?]*+"), F.lit(0))


def terms(text: Column | str) -> Column:
    """Lower-cased words of a text, in order, repeats kept."""
    return lowered_terms(F.lower(_col(text)))


def lowered_terms(lowered: Column | str) -> Column:
    """``terms`` of a text that is in lower case already."""
    return F.array_remove(F.split(_col(lowered), f"[^{WORD}]+"), "")
