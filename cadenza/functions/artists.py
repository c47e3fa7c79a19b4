"""First artist of a text field that may hold a dict literal, JSON, a list or plain text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cadenza.functions.text import before_parenthesis, strip

STRICT = {"allowSingleQuotes": "false"}
# Anything else is not JSON, so it need not be parsed.
JSON_START = r"^\s*(?:[\[{\"0-9-]|(?:null|true|false)\s*$)"


def _is_json(text: Column) -> Column:
    """Whether the whole text is one JSON value.

    The JSON reader stops at the end of the first value. Closing the text once with a
    bracket and once with a brace leaves no way for trailing text to slip through.
    """
    item = F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>", STRICT)
    member = F.from_json(F.concat(F.lit('{"v":'), text, F.lit("}")), "map<string,string>", STRICT)
    one = F.coalesce((F.size(item) == 1) & (F.size(member) == 1), F.lit(False))
    return text.rlike(JSON_START) & one


def _first_value(json_object: Column) -> Column:
    """Value of the first key; a repeated key counts with its last value."""
    entries = F.map_entries(F.from_json(json_object, "map<string,string>", STRICT))
    first_key = F.get(entries, F.lit(0))["key"]
    same = F.filter(entries, lambda e: e["key"] == first_key)
    return F.get(same, F.size(same) - 1)["value"]


def _first_item(json_array: Column) -> Column:
    """First item of a list; the first value of an item that is an object."""
    items = F.from_json(json_array, "array<string>", STRICT)
    return F.get(F.transform(items, lambda i: F.when(_starts(i, "{"), _first_value(i)).otherwise(i)), F.lit(0))


def _scalar(json_scalar: Column) -> Column:
    """Text of a single value, constants spelled as None, True and False."""
    bare = strip(json_scalar)
    content = F.get(F.from_json(F.concat(F.lit("["), json_scalar, F.lit("]")), "array<string>", STRICT), F.lit(0))
    return (
        F.when(bare == "null", F.lit("None"))
        .when(bare == "true", F.lit("True"))
        .when(bare == "false", F.lit("False"))
        .otherwise(content)
    )


def _starts(text: Column, mark: str) -> Column:
    return F.ltrim(text).startswith(mark)


def _after_last_colon(text: Column) -> Column:
    tail = strip(F.substring_index(text, ":", -1))
    tail = strip(F.regexp_replace(tail, r"\}+$", ""))
    return F.nullif(F.btrim(tail, F.lit("'\"")), F.lit(""))


def _plain(text: Column) -> Column:
    """Rule for everything that is not a dict literal."""
    return (
        F.when(~_is_json(text), strip(F.substring_index(text, ",", 1)))
        .when(_starts(text, "{"), _first_value(text))
        .when(_starts(text, "["), _first_item(text))
        .otherwise(_scalar(text))
    )


def first_artist(text: Column) -> Column:
    """First artist name of a field in any of its forms; null for an empty field."""
    looks_like_dict = text.contains("{") & text.contains(":") & text.contains("}")
    quoted = F.replace(text, F.lit("'"), F.lit('"'))
    from_dict = (
        F.when(~_is_json(quoted), _after_last_colon(text))
        .when(_starts(quoted, "{"), _first_value(quoted))
        .otherwise(_plain(text))
    )
    return F.when(text == "", F.lit(None)).when(looks_like_dict, from_dict).otherwise(_plain(text))


def first_artist_simple(text: Column) -> Column:
    """Text before the first comma, without a bracketed note; null for an empty field."""
    name = strip(F.substring_index(text, ",", 1))
    return F.when(text != "", F.when(name.contains("("), before_parenthesis(name)).otherwise(name))


def clean_artist(name: Column) -> Column:
    """Drop a bracketed note such as (feat. X) and outer white space."""
    return before_parenthesis(name)
