"""Text columns: casing, repair, normalisation, tokens, stems, cleaning and predicates.

All functions map ``Column`` to ``Column`` and stay inside the JVM, except two Arrow functions
(Unicode composition, rare HTML entities) that receive a value only for rows that need them.
"""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from themeloom import constants as K

_W = K.WORD_CLASS
_EDGE_SPACE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
_SPACES = r"(?U)[\s\x1c-\x1f]+"


def turkish_lower(text: Column) -> Column:
    """Lower-case with dotless and dotted i kept apart."""
    return F.lower(F.translate(text, "Iİ", "ıi"))


def strip(text: Column) -> Column:
    """Cut white space of every kind at both ends (``trim`` cuts blanks only)."""
    return F.regexp_replace(text, _EDGE_SPACE, "")


def squeeze(text: Column) -> Column:
    """Fold runs of white space to one blank and cut the ends."""
    return F.trim(F.regexp_replace(text, _SPACES, " "))


# ---------------------------------------------------------------------------------- repair

# The printable characters code page 1252 puts at bytes 0x80-0x9F, from the codec itself.
_CP1252_CHARS = bytes(range(0x80, 0xA0)).decode("cp1252", "ignore")
_CP1252_BYTES = "".join(chr(c.encode("cp1252")[0]) for c in _CP1252_CHARS)
_CP1252_ONLY = "^[\\x00-\\x7F\\xA0-\\xFF" + _CP1252_CHARS + "]*$"
_LATIN1_ONLY = "^[\\x00-\\xFF]*$"


_MARKED = "[" + "".join(K.MOJIBAKE_MARKERS) + "]"


def fix_mojibake(text: Column) -> Column:
    """Undo UTF-8 text that was read as code page 1252 or Latin-1; other text is unchanged.

    The bytes are rebuilt with a translate (1252's extra characters to their byte values) and a
    Latin-1 encode, and accepted only if they are valid UTF-8.  Each branch is reached only for
    text the code page can hold, so ``encode`` never fails.  Unmarked text costs one search.
    """
    as_1252 = F.when(
        text.rlike(_CP1252_ONLY),
        F.encode(F.translate(text, _CP1252_CHARS, _CP1252_BYTES), "ISO-8859-1").cast("string"),
    )
    as_latin1 = F.when(
        text.rlike(_LATIN1_ONLY), F.encode(text, "ISO-8859-1").cast("string")
    )
    return (
        F.when(~text.rlike(_MARKED), text)
        .when(F.is_valid_utf8(as_1252), as_1252)
        .when(F.is_valid_utf8(as_latin1), as_latin1)
        .otherwise(text)
    )


def _unstable_under_nfc() -> str:
    """Character class of everything NFC may change: singletons, combining marks, jamo."""
    points = [p for p in range(0x300, 0x30000)
              if not 0xD800 <= p <= 0xDFFF and not unicodedata.is_normalized("NFC", chr(p))]
    ranges: list[list[int]] = []
    for p in points:
        if ranges and p == ranges[-1][1] + 1:
            ranges[-1][1] = p
        else:
            ranges.append([p, p])
    body = "".join(f"\\x{{{a:X}}}" if a == b else f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges)
    return "[\\p{M}\\x{1160}-\\x{11FF}" + body + "]"


_NFC_GUARD = _unstable_under_nfc()


@lru_cache(maxsize=1)
def _compose():
    # Defined inside a function so that it is shipped by value: executors need no copy of
    # this package.
    def compose(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")

    return F.pandas_udf(compose, StringType())


def _may_change_under_nfc(text: Column) -> Column:
    # Nothing below U+0300 changes under NFC, so one cheap search settles ordinary text.
    return text.rlike("[^\\x00-\\x{2FF}]") & text.rlike(_NFC_GUARD)


def nfc(text: Column) -> Column:
    """Unicode composition (NFC); text it cannot change is never sent to Python."""
    return F.coalesce(_compose()(F.when(_may_change_under_nfc(text), text)), text)


def repair(text: Column) -> Column:
    """Mojibake repair, then composition; the Arrow function sees a null for clean text."""
    needed = text.rlike(_MARKED) | _may_change_under_nfc(text)
    return F.coalesce(_compose()(F.when(needed, fix_mojibake(text))), text)


def strip_symbols(text: Column) -> Column:
    """Remove emoji and other symbols (categories So, Sk, Cs, Co)."""
    return F.regexp_replace(text, r"[\p{So}\p{Sk}\p{Cs}\p{Co}]", "")


# ---------------------------------------------------------------------------------- normalise

def normal_form(repaired: Column) -> Column:
    """Normal form of repaired text; built-in functions only.

    Look-behinds stand after the character that starts a match, so the search runs on that
    character and not on each position.
    """
    t = F.regexp_replace(repaired, K.TAG_PATTERN, " ")
    t = F.regexp_replace(t, K.URL_PATTERN, " ")
    t = F.regexp_replace(t, f"@(?<!{_W}@){_W}+", " ")
    t = F.regexp_replace(t, f"#(?<!{_W}#)(?={_W})", "")
    # The letter before an apostrophe is consumed: of two suffixes in a row only the first goes.
    t = F.regexp_replace(t, f"({_W})['’`´]{_W}+", "$1")
    t = strip_symbols(t)
    t = turkish_lower(t)
    t = F.regexp_replace(
        t, f"\\p{{Nd}}(?<!{_W}\\p{{Nd}})\\p{{Nd}}*(?:[.,]\\p{{Nd}}+)?(?!{_W})", " ")
    # Punctuation, underscores, stray combining marks and white space all end up as one blank.
    return F.trim(F.regexp_replace(t, r"[^\p{L}\p{N}]+", " "))


def normalize(text: Column) -> Column:
    """The one normal form used for keys, features and queries: repair, then normal form."""
    return normal_form(repair(text))


def words(normalized: Column) -> Column:
    """Words of a normalised text; no text gives no words."""
    return F.filter(F.split(normalized, " "), lambda w: w != "")


def tokens(normalized: Column, stopwords: Sequence[str] | None = None) -> Column:
    """Letter runs of a normalised text, optionally without stop words (repeats stay)."""
    found = F.regexp_extract_all(normalized, F.lit(f"({K.TOKEN_PATTERN})"), F.lit(1))
    if not stopwords:
        return found
    return F.filter(found, lambda t: ~t.isin(*stopwords))


def content_tokens(normalized: Column, stopwords: Sequence[str] = K.STOPWORDS) -> Column:
    """Tokens that carry meaning: no stop words, more than one letter."""
    return F.filter(tokens(normalized, stopwords), lambda t: F.length(t) > 1)


def has_content(normalized: Column, stopwords: Sequence[str] = K.STOPWORDS) -> Column:
    return F.size(content_tokens(normalized, stopwords)) > 0


def f5_stem(token: Column, length: int = 5) -> Column:
    """Prefix stem."""
    return F.substring(token, 1, length)


def f5_preprocess(normalized: Column) -> Column:
    """Normalised text with every word cut to its stem."""
    return F.array_join(F.transform(words(normalized), lambda w: f5_stem(w)), " ")


def stemmed_stopwords(stopwords: Sequence[str] = K.STOPWORDS, length: int = 5) -> list[str]:
    """Stop words as they look after stemming (the given words are in normal form)."""
    return sorted({w[:length] for w in stopwords})


def term_group(term: Column, length: int = 6) -> Column:
    """Group key of a term: the first letters of each normalised word."""
    return F.array_join(
        F.transform(words(normalize(term)), lambda w: F.substring(w, 1, length)), " ")


# ---------------------------------------------------------------------------------- input shape

def clip(text: Column, limit: int = K.MAX_INPUT_CHARS) -> Column:
    """Stripped text cut to the scorer's input length, with a ``truncated`` flag."""
    clean = strip(text)
    return F.struct(F.substring(clean, 1, limit).alias("text"),
                    (F.length(clean) > limit).alias("truncated"))


def is_command(text: Column, commands: Sequence[str]) -> Column:
    """Control message: equals a command under generic or Turkish lower-casing."""
    generic = F.lower(F.translate(text, "ſ", "s"))
    return generic.isin(*commands) | turkish_lower(text).isin(*commands)


def sentences(text: Column) -> Column:
    """Trimmed sentences, broken after a full stop, question or exclamation mark."""
    parts = F.split(F.replace(text, F.lit("\n"), F.lit(" ")), "(?U)" + K.SENTENCE_BREAK_PATTERN)
    return F.transform(parts, strip)


def word_count(text: Column) -> Column:
    """Number of white-space separated words."""
    squeezed = squeeze(text)
    return F.when(squeezed == "", 0).otherwise(F.size(F.split(squeezed, " ")))


def percent_text(share: Column) -> Column:
    """``0.792`` as ``%79,2``."""
    return F.concat(F.lit("%"), F.replace(F.format_string("%.1f", share * 100), F.lit("."),
                                          F.lit(",")))


# ---------------------------------------------------------------------------------- untrusted text

@lru_cache(maxsize=1)
def _unescape():
    def unescape(texts: pd.Series) -> pd.Series:
        return texts.map(html.unescape, na_action="ignore")

    return F.pandas_udf(unescape, StringType())


def unescape_html(text: Column) -> Column:
    """All HTML entities; rows without an ampersand stay in the JVM."""
    return F.coalesce(_unescape()(F.when(text.contains("&"), text)), text)


def clean_text(value: Column, limit: int | None = None) -> Column:
    """Plain text out of untrusted HTML, cut at a word with an ellipsis; null gives ''.

    Without a limit the text is whole.
    """
    plain = squeeze(unescape_html(F.regexp_replace(value, K.TAG_PATTERN, " ")))
    if limit is None:
        return F.coalesce(plain, F.lit(""))
    cut = F.concat(F.regexp_replace(F.substring(plain, 1, limit - 1), "(?s) [^ ]*$", ""),
                   F.lit("…"))
    return F.coalesce(F.when(F.length(plain) > limit, cut).otherwise(plain), F.lit(""))


def allowed_url(url: Column, hosts: Sequence[str] = K.ALLOWED_HOSTS) -> Column:
    """https link on an allowed host or a subdomain of one; null is not allowed."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    scheme = F.lower(F.try_parse_url(url, F.lit("PROTOCOL")))
    on_host = F.lit(False)
    for allowed in hosts:
        on_host = on_host | (host == allowed) | host.endswith("." + allowed)
    ok = (F.length(url) <= K.MAX_URL_CHARS) & (scheme == "https") & on_host
    return F.coalesce(ok, F.lit(False))
