"""Text column expressions. All of them stay on the JVM side."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Scripts by which text is cut into words, as a search server does. Signs of Han and
# Hiragana are words of their own, Katakana and the scripts of South-East Asia are words as runs.
_HAN, _HIRAGANA = r"\p{IsHan}", r"\p{IsHiragana}"
_KATAKANA = r"\p{IsKatakana}\u3031-\u3035\u309b\u309c\u30a0\u30fc\uff70"
_SOUTH_EAST = r"\p{IsThai}\p{IsLao}\p{IsMyanmar}\p{IsKhmer}"
# Marks and invisible signs belong to what is before them.
_MARKS = r"\p{M}\p{Cf}"
# Letters of all other scripts, digits, and what joins them. The ranges in front are some of these
# letters again: a class is tried from left to right, and looking up a script takes far longer.
_COMMON = r"a-zA-Z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u0400-\u0481\u048a-\u052f"
_LETTERS = rf"{_COMMON}[^\P{{L}}{_HAN}{_HIRAGANA}{_KATAKANA}{_SOUTH_EAST}][^\P{{Nl}}{_HAN}]"
_DIGITS = r"0-9\p{Nd}\u066b"
# No word starts with one of these; they are common, and would be held against every script.
_NO_START = r"\x00-/:-@\[-\^`{-\x7f"
_JOINERS = r"\p{Pc}"
# Between two letters, between two digits, between either: don't, a:b, 3.14, 1,000.
_IN_BOTH = r".'\u2018\u2019\u2024\ufe52\uff07\uff0e"
_IN_LETTERS = rf"[{_IN_BOTH}:\u00b7\u0387\u055f\u05f4\u2027\ufe13\ufe55\uff1a]"
_IN_DIGITS = rf"[{_IN_BOTH},;\u037e\u0589\u060c\u060d\u066c\u07f8\u2044\ufe10\ufe14\ufe50\ufe54\uff0c\uff1b]"
# Fixed value: longer words are cut into pieces of this length.
LONGEST_WORD = 255

# Letters of the most common scripts, without marks, and characters that end a word of small letters.
_SINGLE, _KANA, _THAI = r"\u4e00-\u9fef\u3041-\u3096", r"\u30a1-\u30fa\u30fc", r"\u0e01-\u0e30\u0e32\u0e33\u0e40-\u0e46"
_ENDS, _ASCII = r"\x00-&(-\-/;-@\[-^`{-\x7f", r"\x00-\x7f"
# Most words are runs of such letters before a character that cannot belong to them. That is found with a
# few comparisons, where the whole pattern holds the character against every class; it decides all other cases.
PLAIN_WORD = (
    rf"[a-z]++(?=[{_ENDS}{_SINGLE}{_KANA}{_THAI}])|[{_SINGLE}](?=[{_ASCII}{_SINGLE}{_KANA}{_THAI}])"
    rf"|[{_THAI}]++(?=[{_ASCII}{_SINGLE}{_KANA}])|[{_KANA}]++(?=[{_ASCII}{_SINGLE}{_THAI}])"
)


def _word_pattern() -> str:
    """What counts as a word. Groups are possessive, so that long runs need no deep stack."""
    alpha = rf"[{_LETTERS}][{_LETTERS}{_MARKS}]*+(?:{_IN_LETTERS}[{_LETTERS}][{_LETTERS}{_MARKS}]*+)*+"
    number = rf"[{_DIGITS}][{_DIGITS}{_MARKS}]*+(?:{_IN_DIGITS}[{_DIGITS}][{_DIGITS}{_MARKS}]*+)*+"
    joined = rf"[{_JOINERS}]*+(?:{alpha}|{number})(?:[{_JOINERS}]*+(?:{alpha}|{number}))*+[{_JOINERS}]*+"
    single = rf"[\u4e00-\u9fef\u3041-\u3096{_HAN}{_HIRAGANA}][{_MARKS}]*+"
    south_east = rf"\u0e01-\u0e3a\u0e40-\u0e4e[{_SOUTH_EAST}&&[\p{{L}}\p{{M}}]]"
    runs = rf"[{_KATAKANA}][{_KATAKANA}{_MARKS}]*+|[{south_east}][{south_east}]*+"
    # No two of them start with the same character, so the most common ones come first.
    return f"(?![{_NO_START}])(?:{PLAIN_WORD}|{joined}|{single}|{runs})"


WORD = _word_pattern()

# All characters that count as white space.
WHITE = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

DEFAULT_TITLE = "Unknown Title"
DEFAULT_ARTIST = "Unknown Artist"


def strip(text: Column) -> Column:
    """Drop all leading and trailing white space (trim() drops blanks only)."""
    return F.btrim(text, F.lit(WHITE))


def words(text: Column, pattern: str = WORD) -> Column:
    """Lower-cased words in order; an empty array for null.

    Text is cut by script (see WORD), a word of more than LONGEST_WORD characters into pieces.
    """
    found = F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))

    def pieces(word: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.char_length(word) - 1) / LONGEST_WORD).cast("int"))
        return F.transform(starts, lambda i: F.substr(word, i * LONGEST_WORD + 1, F.lit(LONGEST_WORD)))

    def short(listed: Column) -> Column:
        # Few texts have long words, so all others are taken as they were found.
        long = F.exists(listed, lambda word: F.char_length(word) > LONGEST_WORD)
        return F.when(long, F.flatten(F.transform(listed, pieces))).otherwise(listed)

    # As an array of one, so that a text is searched once, whatever is asked of its words.
    cut = F.transform(F.array(found), short)[0]
    return F.coalesce(cut, F.array().cast("array<string>"))


def _accents() -> tuple[str, str]:
    """Small letters of Latin and Greek with an accent, and their bare letters, by decomposition."""
    pairs = [("ß", "s")]
    for point in [*range(0xC0, 0x250), *range(0x386, 0x3CF), *range(0x1E00, 0x2000)]:
        bare = unicodedata.normalize("NFD", chr(point))
        if len(bare) > 1 and chr(point).islower() and bare[0].islower():
            pairs.append((chr(point), bare[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, BARE = _accents()


def collation_key(text: Column) -> Column:
    """What two texts share that a column of general, case-insensitive collation holds equal: letter case,
    accents of Latin and Greek letters and blanks at the end do not count. A plain text, so it can be
    hashed, grouped and joined like any other."""
    return F.translate(F.lower(F.rtrim(text)), ACCENTED, BARE)


def none_word(text: Column) -> Column:
    """The word 'none' in any case."""
    return F.lower(text) == "none"


def or_else(first: Column, second: Column, empty) -> Column:
    """first unless it is null or the given empty value (0 or ''), else second."""
    return F.coalesce(F.nullif(first, F.lit(empty)), second)


def contains_either_way(a: Column, b: Column) -> Column:
    return F.contains(a, b) | F.contains(b, a)


def before_parenthesis(name: Column) -> Column:
    return strip(F.substring_index(name, "(", 1))


def first_quoted(text: Column) -> Column:
    """Text between the first two single quotes; the whole text if there are none."""
    token = F.substring_index(F.substring_index(text, "'", 2), "'", -1)
    return F.btrim(token, F.lit("'"))


def clean_keywords(keywords: Column) -> Column:
    """Strip every keyword and drop the empty ones; an empty array for null."""
    stripped = F.filter(F.transform(keywords, strip), lambda k: k.isNotNull() & (k != ""))
    return F.coalesce(stripped, F.array().cast("array<string>"))


def embedding_text(billboard: Column, lyrics: Column) -> Column:
    """The text to embed: chart note, blank line, lyrics; lyrics alone without a note."""
    note = F.coalesce(billboard, F.lit(""))
    body = F.coalesce(lyrics, F.lit(""))
    return F.when(note == "", body).otherwise(F.concat(note, F.lit("\n\n"), body))


def clip_words(text: Column, limit: int) -> Column:
    """The text up to its limit-th blank-separated word, unchanged if it has no more."""
    head = F.regexp_extract(text, r"^(?:[ \t\n\r\f]*+[^ \t\n\r\f]++){0," + str(limit) + r"}+", 0)
    rest = F.substr(text, F.char_length(head) + 1)
    return F.when(F.regexp_like(rest, F.lit(r"[^ \t\n\r\f]")), head).otherwise(text)
