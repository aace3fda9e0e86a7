"""Author lists: parsing, order, names and places."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

AUTHORS = "array<struct<first_name:string,last_name:string,position:int,role:string,is_corresponding:boolean,orcid:string,institutions:array<struct<institution:string,country:string,type:string,ror:string>>>>"


def json_list(value: Column) -> Column:
    """The strings of a JSON array; empty for blank, broken or other text."""
    parsed = F.from_json(F.when(F.trim(value).rlike(r"(?s)^\[.*\]$"), value), "array<string>")
    return F.coalesce(parsed, F.array().cast("array<string>"))


def people(value: Column) -> Column:
    """Author structs of a JSON array, those that have a first or last name; empty for blank or broken text."""
    parsed = F.from_json(F.when(F.trim(value).rlike(r"(?s)^\[.*\]$"), value), AUTHORS)
    named = F.filter(parsed, lambda p: (F.coalesce(p["first_name"], F.lit("")) != "") | (F.coalesce(p["last_name"], F.lit("")) != ""))
    return F.coalesce(named, F.array().cast(AUTHORS))


def split_authors(value: Column) -> Column:
    """Names of a list parted by semicolons, or of a JSON array; trimmed, blank ones left out."""
    text = F.coalesce(value, F.lit(""))
    parts = F.when(F.trim(text).startswith("["), json_list(text)).otherwise(F.split(text, ";"))
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda a: a != "")


def join_authors(names: Column) -> Column:
    return F.array_join(F.array_distinct(names), "; ")


def surnames(names: Column) -> Column:
    """What stands before the first comma, else the last word; in lower case, each once."""

    def surname(name: Column) -> Column:
        return F.lower(F.when(F.instr(name, ",") > 0, F.trim(F.substring_index(name, ",", 1))).otherwise(F.element_at(F.split(F.trim(name), r"\s+"), -1)))

    return F.array_distinct(F.transform(names, surname))


def split_name(name: Column) -> Column:
    """``struct<first, last>``: around the comma if both sides hold something, else the last word is the surname."""
    text = F.trim(F.regexp_replace(F.coalesce(name, F.lit("")), r"\s+", " "))
    before, after = F.trim(F.substring_index(text, ",", 1)), F.trim(F.regexp_extract(text, r"^[^,]*,(.*)$", 1))
    last = F.regexp_extract(text, r"(\S+)$", 1)
    return F.when((F.instr(text, ",") > 0) & (before != "") & (after != ""), F.struct(after.alias("first"), before.alias("last"))).otherwise(
        F.struct(F.trim(F.regexp_replace(text, r"\S+$", "")).alias("first"), last.alias("last"))
    )


def full_name(person: Column) -> Column:
    return F.trim(F.regexp_replace(F.concat_ws(" ", person["first_name"], person["last_name"]), r"[\s\p{Z}]+", " "))


def full_names(persons: Column) -> Column:
    return F.transform(persons, full_name)


def first_author(persons: Column) -> Column:
    return F.coalesce(F.get(full_names(persons), F.lit(0)), F.lit(""))


def corresponding_author(persons: Column) -> Column:
    return F.coalesce(F.get(full_names(F.filter(persons, lambda p: F.coalesce(p["is_corresponding"], F.lit(False)))), F.lit(0)), F.lit(""))


def any_orcid(persons: Column) -> Column:
    return F.exists(persons, lambda p: F.coalesce(p["orcid"], F.lit("")) != "")


def places(persons: Column, field: str) -> Column:
    """The institutions or countries of all authors, each once, in order of first appearance."""
    nested = F.flatten(F.transform(persons, lambda p: F.transform(F.coalesce(p["institutions"], F.array()), lambda i: i[field])))
    return F.array_distinct(F.filter(nested, lambda x: F.coalesce(x, F.lit("")) != ""))


def network_names(persons: Column) -> Column:
    """Last and first name in lower case, each person once, in order."""
    name = lambda p: F.lower(F.trim(F.regexp_replace(F.concat_ws(" ", p["last_name"], p["first_name"]), r"[\s\p{Z}]+", " ")))
    return F.array_distinct(F.filter(F.transform(persons, name), lambda n: n != ""))


# Signs that are written as a plain dash and apostrophe.
_DASHES = dict.fromkeys([*range(0x2010, 0x2016), 0x2212], "-")
_QUOTES = dict.fromkeys([0x2018, 0x2019, 0x02BC, 0x0060, 0x00B4], "'")


def _name_key(name: str | None) -> str:
    text = unicodedata.normalize("NFD", unicodedata.normalize("NFKC", name or ""))
    text = "".join(c for c in text if unicodedata.category(c) != "Mn").translate(_DASHES | _QUOTES)
    return " ".join(text.split()).lower()


@F.pandas_udf(ArrayType(StringType()))
def name_keys(names: pd.Series) -> pd.Series:
    """Names without accents and in lower case (a vectorised UDF: the Unicode forms aren't built in); sorted, each once."""
    return names.map(lambda row: sorted({k for k in map(_name_key, row if row is not None else []) if k}))


@F.pandas_udf(StringType())
def ascii_label(names: pd.Series) -> pd.Series:
    """ASCII letters for a label: accents dropped, dashes plain, Cyrillic written in Latin letters, the rest left out."""
    special = str.maketrans("øØłŁđĐıæÆœŒßðÐ", "oOlLdDiaAoOsdD")
    cyrillic = dict(zip(map(ord, "абвгдеёжзийклмнопрстуфхцчшщъыьэюя"), "a b v g d e e zh z i i k l m n o p r s t u f kh ts ch sh shch  y  e yu ya".split(" ")))

    def label(text: str | None) -> str:
        folded = unicodedata.normalize("NFKD", (text or "").translate(_DASHES).translate(special))
        out = "".join(cyrillic.get(ord(c), cyrillic.get(ord(c.lower()), "").capitalize() if ord(c.lower()) in cyrillic else c) for c in folded if not unicodedata.combining(c))
        return out.encode("ascii", "ignore").decode()

    return names.map(label)


def abbreviated(last_first: Column) -> Column:
    """The surname with its own initial before it, ``B. Batty`` for "batty michael"; single words are kept."""
    words = F.split(F.trim(last_first), r"\s+")
    surname = F.initcap(F.element_at(words, 1))
    return F.when(F.size(words) < 2, surname).otherwise(F.concat(F.upper(F.substring(surname, 1, 1)), F.lit(". "), surname))


def author_label(last_first: Column, initial: bool = True) -> Column:
    """The surname and the given name's initial, ``Haas E.`` for "haas ellen c."; names with digits are hidden."""
    words = F.filter(F.split(F.replace(last_first, F.lit("."), F.lit(" ")), r"\s+"), lambda w: w != "")
    first = F.element_at(words, 1)
    surname = F.concat(F.upper(F.substring(first, 1, 1)), F.lower(F.substring(first, 2, 1000)))
    given = F.concat(F.lit(" "), F.upper(F.substring(F.get(words, F.lit(1)), 1, 1)), F.lit("."))
    label = F.when(F.size(words) == 0, last_first).when(F.lit(initial) & (F.size(words) > 1), F.concat(surname, given)).otherwise(surname)
    return F.when(label.rlike(r"\d"), "(unnamed)").otherwise(label)


AUTHORSHIPS = "array<struct<author:struct<display_name:string,orcid:string>,raw_author_name:string,author_position:string,is_corresponding:boolean,institutions:array<struct<display_name:string,country_code:string,type:string,ror:string>>>>"


def authorships(items: Column) -> Column:
    """``struct<authors, affiliations>`` of harvested authorships: authors as of ``people``, and all places of work, the first of each name.

    Authors without a name are left out, but places in the list count them; so are places without a name.
    """
    blank = lambda c: F.trim(F.coalesce(c, F.lit("")))
    listed = F.coalesce(items, F.array().cast(AUTHORSHIPS))

    def place(i: Column) -> Column:
        return F.struct(blank(i["display_name"]).alias("institution"), blank(i["country_code"]).alias("country"), blank(i["type"]).alias("type"), blank(i["ror"]).alias("ror"))

    def person(a: Column, i: Column) -> Column:
        shown, raw = F.regexp_replace(blank(a["author"]["display_name"]), r"\s+", " "), blank(a["raw_author_name"])
        after = F.trim(F.regexp_extract(raw, r"^[^,]*,(.*)$", 1))
        name = split_name(F.when((F.instr(raw, ",") > 1) & (after != "") & (F.trim(F.substring_index(raw, ",", 1)) != ""), raw).otherwise(F.replace(shown, F.lit(","), F.lit("\u0001"))))
        plain = lambda c: F.replace(c, F.lit("\u0001"), F.lit(","))
        at = F.filter(F.transform(F.coalesce(a["institutions"], F.array().cast("array<struct<display_name:string,country_code:string,type:string,ror:string>>")), place), lambda x: x["institution"] != "")
        return F.struct(
            plain(name["first"]).alias("first_name"), plain(name["last"]).alias("last_name"), (i + 1).alias("position"), blank(a["author_position"]).alias("role"),
            F.coalesce(a["is_corresponding"], F.lit(False)).alias("is_corresponding"), blank(a["author"]["orcid"]).alias("orcid"), at.alias("institutions"),
        )

    every = F.filter(F.transform(listed, person), lambda p: (p["first_name"] != "") | (p["last_name"] != ""))
    at = F.flatten(F.transform(every, lambda p: p["institutions"]))
    low = F.transform(at, lambda x: F.lower(x["institution"]))
    once = F.filter(at, lambda x, k: F.array_position(low, F.lower(x["institution"])) == k + 1)
    return F.struct(every.alias("authors"), once.alias("affiliations"))


# Names of the codes, and the regions, of which the first that lists a code has it.
COUNTRIES = (
    "US United States;CN China;GB United Kingdom;DE Germany;CA Canada;AU Australia;IN India;FR France;IT Italy;ES Spain;JP Japan;NL Netherlands;BR Brazil;KR South Korea;"
    "IR Iran;RU Russia;SE Sweden;CH Switzerland;PL Poland;TR Turkey;SA Saudi Arabia;BE Belgium;AT Austria;IL Israel;DK Denmark;SG Singapore;MY Malaysia;PT Portugal;"
    "NO Norway;FI Finland;GR Greece;MX Mexico;ZA South Africa;IE Ireland;NZ New Zealand;CZ Czechia;EG Egypt;PK Pakistan;AR Argentina;CL Chile;CO Colombia;TH Thailand;"
    "VN Vietnam;ID Indonesia;NG Nigeria;HU Hungary;RO Romania;UA Ukraine;RS Serbia;TW Taiwan (China);HK Hong Kong (China);MO Macao (China)"
)
REGIONS = (
    ("Americas", "US CA MX BR AR CL CO PE UY VE CU JM DO GT EC BO PY CR PA TT BB"),
    ("Europe", "GB DE FR IT ES NL BE CH AT SE NO DK FI IE PT GR PL CZ HU RO BG HR SI SK LT LV EE IS LU MT CY RS UA RU TR IL"),
    ("Asia", "CN JP KR IN ID MY TH VN PH SG PK BD LK TW HK MO KH MM NP MN KZ UZ AZ GE AM"),
    ("Oceania", "AU NZ FJ PG"),
    ("Africa", "ZA EG NG KE GH ET TN DZ MA CM UG TZ SN ZW BW MZ NA RW MW ZM AO CI LY SD SO ML BF NE GN"),
    ("Middle East", "SA AE QA KW OM BH JO LB IR IQ SY YE PS"),
)


def country_name(code: Column) -> Column:
    """The name of a country code, the code itself in capitals if it has none here."""
    key = F.upper(F.trim(code))
    names = dict(x.split(" ", 1) for x in COUNTRIES.split(";"))
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for item in names.items() for x in item)), key), key)


def region(code: Column) -> Column:
    """The first region that lists a country code, else "Other"; null codes are "Other" too."""
    out = F.when(F.lit(False), F.lit(""))
    for name, codes in REGIONS:
        out = out.when(code.isin(*codes.split()), name)
    return out.otherwise("Other")
