"""Normal forms of identifiers, titles and free text that serve as join keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def trimmed(value: Column) -> Column:
    return F.regexp_replace(_text(value), r"^\s+|\s+$", "")


def doi_key(value: Column) -> Column:
    """The DOI inside a text, lower case, without closing stops and brackets; "" if there is none."""
    return F.regexp_replace(F.regexp_extract(F.lower(trimmed(value)), r"10\.\S+", 0), r"[.)]+$", "")


def doi_without_resolver(value: Column) -> Column:
    """Lower case, trimmed, without the resolver's address; other forms stay."""
    return F.regexp_replace(F.lower(trimmed(value)), r"^https?://doi\.org/", "")


def lowered(value: Column) -> Column:
    return F.lower(trimmed(value))


def title_words_key(value: Column) -> Column:
    """Lower case; everything but letters, digits, underscores and blanks deleted; blanks collapsed."""
    kept = F.regexp_replace(F.lower(_text(value)), r"[^\p{L}\p{N}_\s\p{Z}]", "")
    return F.trim(F.regexp_replace(kept, r"[\s\p{Z}]+", " "))


def title_letters_key(value: Column) -> Column:
    """Lower-case ASCII letters and digits only; "" for titles in other scripts."""
    return F.regexp_replace(F.lower(_text(value)), r"[^a-z0-9]", "")


def collapsed(value: Column) -> Column:
    """Zero characters turned to blanks, runs of blanks collapsed, trimmed."""
    return F.trim(F.regexp_replace(F.replace(_text(value), F.lit("\u0000"), F.lit(" ")), r"\s+", " "))


def venue_key(value: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(_text(value), r"\s+", " ")))


def venue_name(journal: Column, venue: Column) -> Column:
    """The journal, or the venue where that is blank."""
    return F.coalesce(F.nullif(trimmed(journal), F.lit("")), trimmed(venue))


def title_and_abstract(title: Column, abstract: Column) -> Column:
    return F.concat(_text(title), F.lit(" "), _text(abstract))


def number(value: Column) -> Column:
    """The number a text is in digits, else null; words, suffixes of a type and names of no number are none."""
    text = trimmed(value)
    return F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), text.try_cast("double"))


def rebuilt_text(index: Column) -> Column:
    """The text of an index from words to places: words in the order of their places; of words at one place the later entry's."""
    flat = F.flatten(F.transform(F.map_entries(index), lambda e, i: F.transform(e["value"], lambda p: F.struct(p.alias("p"), (-i).alias("i"), e["key"].alias("w")))))
    ordered = F.array_sort(F.coalesce(flat, F.array().cast("array<struct<p:int,i:int,w:string>>")))
    kept = F.filter(ordered, lambda x, k: (k == 0) | (x["p"] != F.get(ordered, k - 1)["p"]))
    return F.array_join(F.transform(kept, lambda x: x["w"]), " ")


def prompt(title: Column, abstract: Column) -> Column:
    """The text that asks for the label of a record; null fields are empty."""
    # Fixed value: the wording.
    return F.format_string("Classify the following scientific paper.\n\nTITLE:\n%s\n\nABSTRACT:\n%s\n\nReturn JSON only.", _text(title), _text(abstract))


def shortened(value: Column, limit: int, mark: str = " [...]") -> Column:
    """The text, or its first ``limit`` characters and a mark."""
    return F.when(F.length(_text(value)) > limit, F.concat(F.substring(value, 1, limit), F.lit(mark))).otherwise(_text(value))


def last_segment(value: Column) -> Column:
    """What follows the last slash."""
    return F.substring_index(value, "/", -1)
