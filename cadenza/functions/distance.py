"""Bounded edit distance with transpositions, and keys that find all near strings by equality.

The distance is optimal string alignment (OSA): insert, delete, replace a character, or swap
two neighbours, no part of the text edited twice. It counts characters, not bytes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts up to this length meet on deletion keys, longer ones on segment keys.
SHORT = 20
# One edit touches at most two neighbouring segments, so of five segments one survives two edits.
SEGMENTS = 5


def allowed_edits(term: Column) -> Column:
    """Up to 2 characters 0 edits, 3 to 5 one edit, longer two."""
    n = F.char_length(term)
    return F.when(n <= 2, 0).when(n <= 5, 1).otherwise(2)


def _places(first: Column, last: Column) -> Column:
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))


def _without_one(text: Column) -> Column:
    """All strings made by dropping one character."""
    return F.transform(
        _places(F.lit(1), F.char_length(text)),
        lambda i: F.concat(F.substr(text, F.lit(1), i - 1), F.substr(text, i + 1)),
    )


def _without_two(text: Column) -> Column:
    """All strings made by dropping two characters, each pair of places once."""
    n = F.char_length(text)

    def second(i: Column) -> Column:
        head = F.substr(text, F.lit(1), i - 1)
        return F.transform(
            _places(i + 1, n),
            lambda j: F.concat(head, F.substr(text, i + 1, j - i - 1), F.substr(text, j + 1)),
        )

    return F.flatten(F.transform(_places(F.lit(1), n - 1), second))


def _drop_up_to(text: Column, edits: int) -> Column:
    found = [F.array(text), _without_one(text), _without_two(text)]
    return F.concat(*found[: edits + 1])


def _tagged(tag: str, keys: Column) -> Column:
    return F.transform(keys, lambda k: F.concat(F.lit(tag), k))


def _no_keys() -> Column:
    return F.array().cast("array<string>")


def _segment(text: Column, total: Column, number: Column, start_shift: Column) -> Column:
    """Segment `number` of a text of `total` characters, read from text at a shifted place."""
    lo = F.floor(total * number / SEGMENTS).cast("int")
    hi = F.floor(total * (number + 1) / SEGMENTS).cast("int")
    begin = lo + start_shift
    inside = (begin >= 0) & (begin + hi - lo <= F.char_length(text))
    piece = F.substr(text, begin + 1, hi - lo)
    return F.when(inside, F.concat_ws("|", total, number, piece))


def _numbers(lo: int, hi: int) -> Column:
    return F.sequence(F.lit(lo), F.lit(hi))


def vocabulary_keys(term: Column) -> Column:
    """Keys under which an indexed term can be found by any search term."""
    n = F.char_length(term)
    exact = F.when(n <= 2, F.array(F.concat(F.lit("0:"), term))).otherwise(_no_keys())
    one = F.when(n.between(2, 6), _tagged("1:", _drop_up_to(term, 1))).otherwise(_no_keys())
    two = F.when(n.between(4, SHORT + 2), _tagged("2:", _drop_up_to(term, 2))).otherwise(_no_keys())
    own = F.transform(_numbers(0, SEGMENTS - 1), lambda j: _segment(term, n, j, F.lit(0)))
    long = F.when(n >= SHORT - 1, _tagged("s:", own)).otherwise(_no_keys())
    return F.concat(exact, one, two, long)


def search_keys(term: Column) -> Column:
    """Keys of a search term; every term within its allowed edits shares at least one."""
    n = F.char_length(term)

    def for_length(delta: Column) -> Column:
        return F.flatten(
            F.transform(
                _numbers(0, SEGMENTS - 1),
                lambda j: F.transform(_numbers(-2, 2), lambda s: _segment(term, n + delta, j, s)),
            )
        )

    pieces = F.flatten(F.transform(_numbers(-2, 2), for_length))
    long = F.array_distinct(_tagged("s:", F.filter(pieces, lambda p: p.isNotNull())))
    return (
        F.when(n <= 2, F.array(F.concat(F.lit("0:"), term)))
        .when(n <= 5, _tagged("1:", _drop_up_to(term, 1)))
        .when(n <= SHORT, _tagged("2:", _drop_up_to(term, 2)))
        .otherwise(long)
    )


def _swapped_at(a: Column, i: Column, b: Column, j: Column) -> Column:
    """Characters i, i+1 of a are characters j+1, j of b."""
    return (F.substr(a, i, F.lit(1)) == F.substr(b, j + 1, F.lit(1))) & (
        F.substr(a, i + 1, F.lit(1)) == F.substr(b, j, F.lit(1))
    )


def _head(text: Column, before: Column) -> Column:
    return F.substr(text, F.lit(1), before - 1)


def _tail(text: Column, after: Column) -> Column:
    return F.substr(text, after + 2)


def _swap_places(a: Column) -> Column:
    return _places(F.lit(1), F.char_length(a) - 1)


def one_swap(a: Column, b: Column) -> Column:
    """b is a with exactly one pair of neighbours swapped."""
    return (F.char_length(a) == F.char_length(b)) & F.exists(
        _swap_places(a),
        lambda i: _swapped_at(a, i, b, i)
        & (_head(a, i) == _head(b, i))
        & (_tail(a, i) == _tail(b, i)),
    )


def _within_one(a: Column, b: Column) -> Column:
    return (F.levenshtein(a, b) <= 1) | one_swap(a, b)


def _swap_and_one_more(a: Column, b: Column) -> Column:
    """One swap, and at most one edit wholly before or wholly after it."""
    shift = F.char_length(b) - F.char_length(a)

    def split(i: Column) -> Column:
        j = i + shift
        after = _swapped_at(a, i, b, i) & (_head(a, i) == _head(b, i)) & _within_one(_tail(a, i), _tail(b, i))
        before = (
            (j >= 1)
            & _swapped_at(a, i, b, j)
            & (_tail(a, i) == _tail(b, j))
            & _within_one(_head(a, i), _head(b, j))
        )
        return after | before

    return F.exists(_swap_places(a), split)


def osa_within(a: Column, b: Column, limit: Column) -> Column:
    """The distance if it is at most limit, which is at most 2, else null."""

    def corrected(plain: Column) -> Column:
        # Counted without swaps, two edits are four at most; above that levenshtein gives -1.
        two = limit == 2
        return (
            F.when(plain.between(0, 1) & (plain <= limit), plain)
            .when((plain == 2) & (limit >= 1) & one_swap(a, b), F.lit(1))
            .when((plain == 2) & two, F.lit(2))
            .when((plain > 2) & two & _swap_and_one_more(a, b), F.lit(2))
        )

    # As an array of one, so that the distance is computed once.
    return F.get(F.transform(F.array(F.levenshtein(a, b, 4)), corrected), F.lit(0))
