"""Text expressions: normalisation, tokens, folding, entities and markup.

Everything is a Column expression but ``stem``, ``fold_exact`` and, for texts that hold an
ampersand, ``decode_entities``, which Spark has no built-in for and which are Arrow-batched.
"""

from __future__ import annotations

import html.entities
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from termloom.functions import stemmers

MAX_WORD = 65
MAX_BYTES = 4 << 20
TOKEN = "[\\p{L}\\p{Nd}_-]+"
#: A word counts once a separator ends it; the one open at the end of the text is then not a word.
CLOSED_TOKEN = "([\\p{L}\\p{Nd}_-]+)[^\\p{L}\\p{Nd}_-]"


def capped_bytes(raw: Column, most: int = MAX_BYTES) -> Column:
    """The first ``most`` bytes of a binary column."""
    return F.substring(raw, 1, most)


def until_nul(text: Column) -> Column:
    return F.substring_index(text, "\0", 1)


def to_unicode(raw: Column, errors: str = "strict") -> Column:
    """Text of UTF-8 bytes; of bad bytes null ("strict"), nothing ("ignore") or U+FFFD ("replace")."""
    if errors == "strict":
        return F.when(F.is_valid_utf8(raw), raw.cast("string"))
    if errors not in ("ignore", "replace"):
        raise ValueError(f"unknown way with errors: {errors}")
    replaced = F.make_valid_utf8(raw)
    return replaced if errors == "replace" else F.when(F.is_valid_utf8(raw), raw.cast("string")).otherwise(F.replace(replaced, F.lit("\ufffd"), F.lit("")))


def utf8_prefix(raw: Column) -> Column:
    """The longest valid UTF-8 prefix without a zero byte; null where it is empty.

    Bytes before the first zero byte have none, so it can stand for U+FFFD while U+FFFD marks bad bytes.
    """
    marked = F.make_valid_utf8(F.replace(until_nul(raw.cast("string")), F.lit("\ufffd"), F.lit("\0")))
    return F.nullif(F.replace(F.substring_index(marked, "\ufffd", 1), F.lit("\0"), F.lit("\ufffd")), F.lit(""))


def normalised(raw: Column, most: int = MAX_BYTES) -> Column:
    """Document text of a binary column: capped, then its valid prefix."""
    return utf8_prefix(capped_bytes(raw, most))


def tokens(text: Column, flush_tail: bool = False) -> Column:
    """Array of the words of a text. With ``flush_tail`` the last word needs no separator."""
    return F.regexp_extract_all(text, F.lit(TOKEN), 0) if flush_tail else F.regexp_extract_all(text, F.lit(CLOSED_TOKEN), 1)


_C = "\\p{L}\\p{Nd}_-"


def words(text: Column, flush_tail: bool = False, max_word: int = MAX_WORD) -> Column:
    """The words of a text as ``term`` makes them, with a space between two; empty if there are none."""
    word = f"(?<![{_C}])([{_C}]{{1,{max_word}}}+)[{_C}]*+"
    return F.lower(F.array_join(F.regexp_extract_all(text, F.lit(word if flush_tail else f"{word}[^{_C}]"), 1), " "))


def term(token: Column, max_word: int = MAX_WORD) -> Column:
    """A token cut to ``max_word`` code points and lower-cased."""
    return F.lower(F.substring(token, 1, max_word))


def _fold(word: str) -> str:
    out = []
    for c in word:
        x = c.lower() if c < "\x80" or unicodedata.category(c) == "Lu" else c
        out.append(x if len(x) == 1 else {"İ": "i"}.get(c, c))
    return "".join(out)


@F.pandas_udf(StringType())
def fold_exact(word: pd.Series) -> pd.Series:
    """One code point to one: final sigma is not special and title case letters stay."""
    return word.map(lambda x: None if x is None else _fold(x))


def char_class(c: Column) -> Column:
    """lower, upper, number, hyphen, underscore, alpha_lower, alpha_upper or ignore, of one character."""
    return (
        F.when(c.rlike("^[a-z]$"), "ascii_lower").when(c.rlike("^[A-Z]$"), "ascii_upper").when(c.rlike("^\\p{Nd}$"), "number").when(c == "-", "hyphen").when(c == "_", "underscore")
        .when(c.rlike("^\\p{Lu}$"), "alpha_upper").when(c.rlike("^\\p{L}$"), "alpha_lower").otherwise("ignore")
    )


def stem_udf(language: str = "english"):
    """Arrow-batched stemmer; each distinct word of a batch is stemmed once."""
    stemmers.stemmer(language)  # fails on the driver if unknown

    @F.pandas_udf(StringType())
    def run(word: pd.Series) -> pd.Series:
        return word.map({w: stemmers.stem(w, language) for w in word.dropna().unique()})

    return run


_ENTITY = re.compile(r"&(?:#(\d+)|#[xX]([0-9a-fA-F]+)|(\w+));")


def decode_text(text: str) -> str:
    def one(m):
        try:
            if m[3]:
                return chr(html.entities.name2codepoint[m[3]])
            return chr(int(m[1]) if m[1] else int(m[2], 16))
        except (KeyError, ValueError, OverflowError):
            return m[0]

    return _ENTITY.sub(one, text)


def decode_entities(text: Column, times: int = 1) -> Column:
    """Decimal, hexadecimal and named references that end in a semicolon; unknown ones stay.

    Texts without an ampersand don't leave the JVM.
    """

    @F.pandas_udf(StringType())
    def decode(x: pd.Series) -> pd.Series:
        for _ in range(times):
            x = x.map(lambda y: None if y is None else decode_text(y))
        return x

    return F.coalesce(decode(F.when(F.contains(text, F.lit("&")), text)), text)


_TRAILING_LANGUAGES = "(?dU)(?:\\n\\[\\[[a-z][a-z][\\w-]*:[^:\\]]+\\]\\])+$"
#: What a text must hold for the pattern of the same place in ROUND to match.
_NEEDS = ["<!--", "<ref", "<nowiki", "<math", "<", "{{", "{{", "://", "\n[[", "\n[[", "|", "||", "\n", "\n", "[]"]
#: Fixed values. One round of markup removal: (pattern, replacement).
ROUND = [
    ("(?s)<!--.*?-->", ""),
    ("(?s)<ref(?:[> ].*?)(?:</ref>|/>)", ""),
    ("(?s)<nowiki(?:[> ].*?)(?:</nowiki>|/>)", ""),
    ("(?s)<math(?:[> ].*?)(?:</math>|/>)", ""),
    ("(?s)<.*?>", ""),
    ("\\{\\{[^}{]*\\}\\}", ""),
    ("\\{\\{[^}]*\\}\\}", ""),
    ("(?dU)\\[(\\w+)://(.*?)(( (.*?))|())\\]", "$3"),
    ("(?d)\\n\\[\\[[iI]mage(.*?)(\\|.*?)*\\|(.*?)\\]\\]", "\n$3"),
    ("(?d)\\n\\[\\[[fF]ile(.*?)(\\|.*?)*\\|(.*?)\\]\\]", "\n$3"),
    ("\\[([^\\]\\[]*)\\|([^\\]\\[]*)\\]", "$2"),
    ("\\|\\|", "\n|"),
    ("(?d)\\n(?:\\{\\||\\|-|\\|\\}).*?(?=\\n)", "\n"),
    ("\\n[|!](?:[^\\n]*\\|)?", "\n"),
    ("\\[\\]", ""),
]


def strip_comments(text: Column) -> Column:
    return F.regexp_replace(text, *map(F.lit, ROUND[0]))


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, *map(F.lit, ROUND[4]))


def strip_templates(text: Column) -> Column:
    for pattern, new in ROUND[5:7]:
        text = F.regexp_replace(text, F.lit(pattern), F.lit(new))
    return text


def _where(need: str, pattern: str, new: str, text: Column) -> Column:
    """The replacement, only where the text holds ``need``. As a lambda, so that the text is computed once."""
    return F.element_at(F.transform(F.array(text), lambda t: F.when(F.contains(t, F.lit(need)), F.regexp_replace(t, F.lit(pattern), F.lit(new))).otherwise(t)), 1)


def one_round(text: Column) -> Column:
    for need, (pattern, new) in zip(_NEEDS, ROUND, strict=True):
        text = _where(need, pattern, new, text)
    return text


def strip_languages(text: Column) -> Column:
    """Without the links to other languages at the end."""
    return _where("[[", _TRAILING_LANGUAGES, "", text)


def plain_text(text: Column, rounds: int = 3) -> Column:
    """Wiki markup to plain text. A round on a fixpoint changes nothing, so three are unrolled."""
    text = strip_languages(decode_entities(text, 2))
    for _ in range(rounds):
        text = one_round(text)
    return F.translate(text, "[]", "")
