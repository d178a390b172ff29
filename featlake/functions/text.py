"""Text cleaning, counting and tokenising as column expressions.

Patterns use only syntax that Java and RE2 read alike; a word character is a letter, a number or
the underscore, white space is what Unicode calls white space.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from featlake.functions.binding import bind

SPACE = r"[\t-\r\x1c-\x20\x85\p{Z}]+"
PUNCT = r"[!-/:-@\[-`{-~]"
WORD = r"[\p{L}\p{N}_]+"
WORD_NO_PUNCT = r"[\p{L}\p{N}]+"
WORD_OR_PUNCT = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\t-\r\x1c-\x20\x85\p{Z}]+"


def squeeze(col: Column) -> Column:
    """White space runs to one blank, none at the ends."""
    return F.trim(F.regexp_replace(col, SPACE, " "))


def words(col: Column) -> Column:
    """Array of white-space separated words; empty for an empty text."""
    return F.filter(F.split(squeeze(col), " "), lambda w: w != "")


# What a missing text turns into, by cleaning entry point.
NULL_TEXT = {"name": "name error", "text": "nan"}

_AS_WRITTEN = r"[^\[:alph]\]"  # what a POSIX class means to an engine without POSIX classes


def clean_text(col: Column, mode: str = "letters", null: str = "text") -> Column:
    """Lower case, without backslash-u codes, ``===`` and all but letters; single blanks.

    ``mode="as_written"`` keeps everything except the few two-character matches of a misread class,
    with blanks around runs of digits.
    """
    t = F.lower(F.coalesce(col, F.lit(NULL_TEXT[null])))
    t = F.regexp_replace(t, r"\\u[0-9a-f]+", "")
    t = F.regexp_replace(t, "===", " ")
    if mode == "as_written":
        t = F.regexp_replace(F.regexp_replace(t, r"(\p{Nd}+)", " $1 "), _AS_WRITTEN, " ")
    else:
        t = F.regexp_replace(t, r"[^\p{L}]", " ")
    return squeeze(t)


def clean_tokens(col: Column, stopwords: list[str] = (), alphabet: str = "any") -> Column:
    """Lower-cased words of two or more characters that are not stop-words, joined by blanks.

    Punctuation becomes a blank; ``alphabet="ascii"`` keeps only A-Z, a-z and 0-9.
    """
    pattern = PUNCT if alphabet == "any" else "[^A-Za-z0-9]+"
    parts = F.split(F.trim(F.regexp_replace(F.lower(col), pattern, " ")), " ")
    keep = (lambda w: (F.length(w) > 1) & ~w.isin(list(stopwords))) if stopwords else (lambda w: F.length(w) > 1)
    return F.array_join(F.filter(parts, keep), " ")


def strip_digits_punct(col: Column) -> Column:
    """White space squeezed, then digits and punctuation to blanks."""
    return F.regexp_replace(F.regexp_replace(col, SPACE, " "), r"[0-9!-/:-@\[-`{-~]", " ")


# Symbols that become a blank.
SYMBOLS = "\"\n\t:+=,."


def strip_symbols(col: Column, chars: str = SYMBOLS) -> Column:
    return F.translate(col, chars, " " * len(chars))


# Substring -> replacement, applied in this order to lower-cased text.
BRAND_RULES = [
    (r"\xa0", " "), ("●", " "), ("😎", " "), ("👍", " "), ("»", " "), ("«", " "), ("↓", " "),
    ("iphone", " iphone "), ("samsung", " samsung "), ("apple", " apple "), ("dell", " dell "),
    ("seilmann", " steilmann "), ("multipad", " multipad "), ("triple", " triple "), ("philip", " philip "),
    ("ipod", " ipod "), ("asusintel", " asus intel "), ("00asus", " asus "), ("chevrolet", " chevrolet "),
    ("nikenike", " nike "), ("™", " "), ("compac", " compac "), ("gtx", " gtx "),
]


def apply_rules(col: Column, rules: list[tuple[str, str]] = BRAND_RULES) -> Column:
    """Literal replacements, one after the other."""
    return reduce(lambda c, r: F.replace(c, F.lit(r[0]), F.lit(r[1])), rules, col)


def split_scripts(col: Column) -> Column:
    """A blank wherever a character below code point 256 meets one above."""
    t = F.regexp_replace(col, r"([\x{0}-\x{ff}])([^\x{0}-\x{ff}])", "$1 $2")
    return F.regexp_replace(t, r"([^\x{0}-\x{ff}])([\x{0}-\x{ff}])", "$1 $2")


def join_text(cols: list[Column], fill: str = "") -> Column:
    return F.concat_ws(" ", *[F.coalesce(c, F.lit(fill)) for c in cols])


def text_stats(col: Column, prefix: str) -> list[Column]:
    """Characters, words, distinct words and distinct words per hundred words."""
    w = words(F.coalesce(col, F.lit("")))
    n, u = F.size(w), F.size(F.array_distinct(w))
    return [F.coalesce(F.length(col), F.lit(0)).alias(f"{prefix}_num_chars"), n.alias(f"{prefix}_num_words"),
            u.alias(f"{prefix}_num_unique_words"), (F.try_divide(u, n) * 100).alias(f"{prefix}_words_vs_unique")]


def case_stats(col: Column, prefix: str) -> list[Column]:
    up, low = F.regexp_count(col, F.lit(r"\p{Lu}")), F.regexp_count(col, F.lit(r"\p{Ll}"))
    return [up.alias(f"{prefix}_count_upper"), (low + 1).alias(f"{prefix}_count_lower"),
            (up / (low + 1)).alias(f"{prefix}_count_upper_lower_ratio")]


def count_chars(col: Column, chars: str) -> Column:
    """Occurrences of any of the given characters."""
    return F.length(col) - F.length(F.translate(col, chars, ""))


def char_class_counts(col: Column, prefix: str) -> list[Column]:
    return [F.regexp_count(col, F.lit(PUNCT)).alias(f"{prefix}_num_punct"),
            F.regexp_count(col, F.lit(r"\p{N}")).alias(f"{prefix}_num_digits"),
            F.regexp_count(col, F.lit(r"\p{S}")).alias(f"{prefix}_num_symbols"),
            count_chars(col, "!").alias(f"{prefix}_num_exclamation"),
            count_chars(col, "?").alias(f"{prefix}_num_question")]


# Fixed value: the characters that a misquoted class "[A-Z]" counts.
CLASS_AS_CHARS = "[A-Z]"


def stopword_count(col: Column, stopwords: list[str], unit: str = "word") -> Column:
    """Stop-words among the words, or (``unit="char"``) one-letter stop-words among the characters."""
    parts = words(col) if unit == "word" else F.split(col, "")
    return F.size(F.filter(parts, lambda w: w.isin(list(stopwords))))


def text_ratios(col: Column, stopwords: list[str], prefix: str) -> list[Column]:
    low = F.lower(col)
    w = words(low)
    n_words, n_chars = F.size(w), F.length(low)
    punct, digits = F.regexp_count(low, F.lit(PUNCT)), F.regexp_count(low, F.lit(r"\p{N}"))
    stop, upper = F.size(F.filter(w, lambda t: t.isin(list(stopwords)))), F.regexp_count(col, F.lit(r"\p{Lu}"))
    r = F.try_divide
    return [r(F.size(F.array_distinct(w)), n_words).alias(f"{prefix}_words_vs_unique"),
            r(n_chars, n_words).alias(f"{prefix}_letters_per_word"), r(punct, n_chars).alias(f"{prefix}_punct_by_letters"),
            r(punct, n_words).alias(f"{prefix}_punct_by_words"), r(digits, n_chars).alias(f"{prefix}_digits_by_letters"),
            r(upper, n_chars).alias(f"{prefix}_alphabets_by_letters"), r(stop, n_words).alias(f"{prefix}_stopwords_by_words"),
            (F.coalesce(r(n_words, n_chars), F.lit(0.0)) * 10).alias(f"{prefix}_mean")]


def log_length(col: Column) -> Column:
    return F.log1p(F.length(col))


def tokenize(col: Column, kind: str = "word") -> Column:
    """Array of tokens: ``word``, ``no_punct`` or ``word_punct``."""
    pattern = {"word": WORD, "no_punct": WORD_NO_PUNCT, "word_punct": WORD_OR_PUNCT}[kind]
    return F.regexp_extract_all(col, F.lit(f"({pattern})"), 1)


def _runs(parts: Column, n: int, sep: str) -> Column:
    """All runs of ``n`` neighbours of an array, joined by ``sep``; each run reads only its own elements."""
    run = lambda i: F.concat_ws(sep, *[F.get(parts, i + k) for k in range(n)])
    return F.when(F.size(parts) >= n, F.transform(F.sequence(F.lit(0), F.size(parts) - n), run)).otherwise(
        F.array().cast("array<string>"))


def char_ngrams(tokens: Column, n: int = 3) -> Column:
    """All runs of ``n`` characters inside each token; shorter tokens give none."""
    return F.flatten(F.transform(tokens, lambda t: bind(F.split(t, ""), lambda c: _runs(c, n, ""))))


def text_char_ngrams(col: Column, lo: int, hi: int) -> Column:
    """Runs of ``lo`` to ``hi`` characters of the whole text, blanks included."""
    return bind(F.split(col, ""), lambda c: F.concat(*[_runs(c, n, "") for n in range(lo, hi + 1)]))


def word_ngrams(tokens: Column, lo: int, hi: int) -> Column:
    """Runs of ``lo`` to ``hi`` tokens, joined by blanks."""
    return bind(tokens, lambda t: F.concat(*[t if n == 1 else _runs(t, n, " ") for n in range(lo, hi + 1)]))


def field_tokens(fields: list[tuple[str, Column]]) -> Column:
    """One line of ``<prefix><value>`` tokens; a value of several columns is joined by ``_`` beforehand."""
    return F.concat_ws(" ", *[F.concat(F.lit(p), F.coalesce(c.cast("string"), F.lit("nan"))) for p, c in fields])
