"""Text cleaning as Column expressions; everything stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points Python's str.strip() and \s treat as white space.
SPACE_RANGES = (
    r"\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
SPACE_CHARS = "".join(
    chr(c)
    for c in [*range(0x9, 0xE), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B)]
    + [0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
)

# The symbol ranges that cleaning blanks out. The last range also
# covers CJK, kana and Hangul; that is the behaviour results must match.
SYMBOL_RANGES = (
    r"\x{1F300}-\x{1F5FF}\x{1F600}-\x{1F64F}\x{1F680}-\x{1F6FF}\x{1F700}-\x{1F77F}"
    r"\x{1F780}-\x{1F7FF}\x{1F800}-\x{1F8FF}\x{1F900}-\x{1F9FF}\x{1FA00}-\x{1FA6F}"
    r"\x{1FA70}-\x{1FAFF}\x{2702}-\x{27B0}\x{24C2}-\x{1F251}"
)

TAG_PATTERN = r"<[^>\n]*>"
URL_PATTERN = rf"http[^{SPACE_RANGES}]+|www[^{SPACE_RANGES}]+"
SYMBOL_PATTERN = f"[{SYMBOL_RANGES}]+"
SPACE_PATTERN = f"[{SPACE_RANGES}]+"
# The same patterns for Java, arranged so that an ordinary letter is rejected by a short test:
# `&&` intersects with a few wide ranges first, the look-ahead needs one of two letters first.
FAST_URL = rf"(?=[hw])(?:http|www)[^{SPACE_RANGES}]+"
FAST_GAP = rf"[\x{{9}}-\x{{d}}\x{{1c}}-\x{{20}}\x{{85}}\x{{a0}}\x{{1680}}-\x{{1FAFF}}&&[{SPACE_RANGES}{SYMBOL_RANGES}]]+"
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"


def strip(text: Column) -> Column:
    """Remove Unicode white space at both ends."""
    return F.trim(text, F.lit(SPACE_CHARS))


def strip_html(text: Column) -> Column:
    """Blank out tags that open and close on one line; the text between tags stays."""
    return F.regexp_replace(text, TAG_PATTERN, " ")


def strip_urls(text: Column) -> Column:
    return F.regexp_replace(text, FAST_URL, " ")


def strip_symbols(text: Column) -> Column:
    return F.regexp_replace(text, SYMBOL_PATTERN, " ")


def collapse_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACE_PATTERN, " "))


def clean_text(text: Column) -> Column:
    """Lower-case, then drop tags, URLs, symbols and surplus space, in that order.

    Symbols become one space and runs of space become one space, so the last two
    steps are a single pass over a joint character class.
    """
    body = strip_urls(strip_html(F.lower(text.cast("string"))))
    return F.trim(F.regexp_replace(body, FAST_GAP, " "))


def survives_cleaning(text: Column) -> Column:
    """Whether clean_text leaves anything, without cleaning most texts.

    A character that is no space or symbol and has no '<', 'h' or 'w' before it can be
    part of neither a tag nor a URL, so it survives. Only texts that start otherwise are
    cleaned to find out. A plain comparison with '' would be pushed below the projection
    and clean every text twice.
    """
    early = F.rlike(F.lower(text.cast("string")), F.lit(f"^[^<hw]*?[^<hw{SPACE_RANGES}{SYMBOL_RANGES}]"))
    return early | (clean_text(text) != "")


def is_blank(text: Column) -> Column:
    return text.isNull() | (strip(text.cast("string")) == "")


def one_line(text: Column) -> Column:
    """A review as one line: ends stripped, line feeds to spaces."""
    return F.replace(strip(text), F.lit("\n"), F.lit(" "))


def shorten(text: Column, width: int = 45, tail: str = "…") -> Column:
    return F.when(F.length(text) > width, F.concat(F.left(text, F.lit(width)), F.lit(tail))).otherwise(text)


def content_hash(content: Column) -> Column:
    """sha256 of the stripped, lower-cased text."""
    return F.sha2(F.lower(strip(content.cast("string"))), 256)


def tokens(text: Column) -> Column:
    """Lower-case word tokens of two characters or more, in reading order."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), F.lit(0))


def bigrams(words: Column) -> Column:
    pairs = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(
        F.slice(words, F.lit(1), pairs),
        F.slice(words, F.lit(2), pairs),
        lambda a, b: F.concat(a, F.lit(" "), b),
    )


def words_and_pairs(words: Column) -> Column:
    """All one- and two-word terms of a token list."""
    return F.concat(words, bigrams(words))


def without(words: Column, stop_words: list[str]) -> Column:
    """Tokens outside the list; two-word terms then span what was removed."""
    return F.filter(words, lambda w: ~w.isin(stop_words))
