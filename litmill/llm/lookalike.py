"""Bring text of one look to one form: compatibility forms, combining accents, invisible characters, look-alike letters.

The mapping is embedded SQL that DuckDB runs over the Arrow batches of each partition: ``translate`` for single
characters, regular expressions for what vanishes, ``nfc_normalize`` to compose accents. Most values are plain ASCII and
pass untouched, so the long tables are only applied to the few that are not. No shuffle.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Letters of one look, Latin first.
CYRILLIC = ("ABCEHIJKMOPSTXYaceijopsxyhvdqwëïËÏèÈ", "АВСЕНІЈКМОРЅТХУасеіјорѕхуһѵԁԛԝёїЁЇѐЀ")
GREEK = ("ABEZHIKMNOPTYXovaipukxáéíóúÁÉÍÓÚ", "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοναιρυκχάέίόύΆΈΊΌΎ")
# Characters that stand for a plain blank, hyphen or apostrophe, and ranges that show nothing.
HYPHENS = "‐‑‒–—―−⁃˗﹣－﹘"
APOSTROPHES = "’‘‛ʼʻʹ′＇`´ʽ"
INVISIBLE = (
    r"\x{00AD}\x{034F}\x{061C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180E}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}"
    r"\x{3164}\x{FE00}-\x{FE0F}\x{FEFF}\x{FFA0}\x{FFF9}-\x{FFFB}\x{E0000}-\x{E0FFF}\x{0000}-\x{0008}\x{000E}-\x{001F}\x{007F}"
)


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@cache
def _compatibility() -> tuple[str, str, list[tuple[str, str]]]:
    """Characters with a compatibility form of one character, those forms, and the pairs with longer forms; from the Unicode data."""
    single, forms, longer = [], [], []
    for code in range(0x80, 0x30000):
        char = chr(code)
        if 0xD800 <= code < 0xE000 or char in HYPHENS + APOSTROPHES or not unicodedata.decomposition(char).startswith("<"):
            continue
        form = unicodedata.normalize("NFKC", char)
        if len(form) == 1:
            single.append(char)
            forms.append(form)
        elif form.isalpha() and unicodedata.category(char)[0] == "L" and unicodedata.name(char, "").startswith("LATIN"):
            longer.append((char, form))
    spaces = [chr(c) for c in range(0x80, 0x3001) if unicodedata.category(chr(c)) == "Zs" and chr(c) not in single]
    singles = "".join(single + spaces) + HYPHENS + APOSTROPHES
    return singles, "".join(forms) + " " * len(spaces) + "-" * len(HYPHENS) + "'" * len(APOSTROPHES), longer


#: A value in the ordinary form: letters of one script, composed, with plain ASCII between them.
_PLAIN = r" -@\[-_{-~\t\r\n"
ORDINARY = "|".join(
    f"[{_PLAIN}{letters}]*" for letters in (r"A-Za-z\x{00C0}-\x{00D6}\x{00D8}-\x{00F6}\x{00F8}-\x{0131}\x{0134}-\x{0148}\x{014A}-\x{017E}", r"А-Яа-яЁё", r"Α-Ωα-ωάέήίόύώΆΈΉΊΌΎΏϊϋΐΰ", r"\x{4E00}-\x{9FFF}")
)


def _class(chars: str) -> str:
    """A character class of the given characters, neighbours joined to ranges."""
    codes, ranges = sorted(set(map(ord, chars))), []
    for code in codes:
        if ranges and ranges[-1][1] == code - 1:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges) + "]"


@cache
def canonical_sql(items: str) -> str:
    """SQL over a query ``items`` with a column ``item`` that adds ``ordinary``; each step is its own level, so that it is computed once."""
    single, forms, longer = _compatibility()
    ligatures = "x1"
    for char, form in longer:
        ligatures = f"replace({ligatures}, {_quoted(char)}, {_quoted(form)})"
    twins = {
        "Latin": (CYRILLIC[1] + GREEK[1], CYRILLIC[0] + GREEK[0]),
        "Cyrillic": CYRILLIC,
        "Greek": GREEK,
    }
    # letters of a script that look like no letter of another one tell which script a value is in
    own = {
        "Latin": rf"[^\p{{Latin}}]|[{CYRILLIC[0]}{GREEK[0]}]",
        "Cyrillic": rf"[^\p{{Cyrillic}}]|[{CYRILLIC[1]}]",
        "Greek": rf"[^\p{{Greek}}]|[{GREEK[1]}]",
    }
    to = {k: f"translate(x2, {_quoted(a)}, {_quoted(b)})" for k, (a, b) in twins.items()}
    counts = ", ".join(f"length(regexp_replace(x2, '{v}', '', 'g')) as n_{k.lower()}" for k, v in own.items())
    scripts = " + ".join(f"regexp_matches(x2, '\\p{{{k}}}')::int" for k in own)
    return f"""
with q0 as ({items}),
q1 as (select *, case when regexp_full_match(item, '{ORDINARY}') then null else regexp_replace(item, '[{INVISIBLE}]', '', 'g') end as x0 from q0),
q2 as (select * exclude (x0), case when regexp_matches(x0, '{_class(single)}') then translate(x0, {_quoted(single)}, {_quoted(forms)}) else x0 end as x1 from q1),
q3 as (select * exclude (x1), case when regexp_matches(x1, '{_class("".join(c for c, _ in longer))}') then {ligatures} else x1 end as x2 from q2),
q4 as (select *, {scripts} as n_scripts, {counts} from q3)
select * exclude (x2, n_scripts, n_latin, n_cyrillic, n_greek), case
  when x2 is null then item
  when n_scripts < 2 then nfc_normalize(x2)
  when n_cyrillic > n_latin and n_cyrillic >= n_greek then nfc_normalize({to["Cyrillic"]})
  when n_greek > n_latin then nfc_normalize({to["Greek"]})
  else nfc_normalize({to["Latin"]}) end as ordinary
from q4"""


def _connection():
    import duckdb

    return duckdb.connect(config={"threads": 1, "memory_limit": "600MB"})


def duckdb_over_batches(df: DataFrame, sql: str, schema: str) -> DataFrame:
    """Run ``sql``, which reads the table ``batch``, over the Arrow batches of each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = None
        for batch in batches:
            con = con or _connection()
            con.register("batch", pa.Table.from_batches([batch]))
            result = con.execute(sql)
            table = result.to_arrow_table() if hasattr(result, "to_arrow_table") else result.fetch_arrow_table()
            con.unregister("batch")
            yield from table.to_batches(max_chunksize=20_000)

    return df.mapInArrow(run, schema)


def canonical_text(df: DataFrame, text_col: str, out_col: str) -> DataFrame:
    """``df`` with ``out_col``, the one form of ``text_col``; a column of that name is replaced.

    Null stays null, empty stays empty, and values in the ordinary form stay as they are. A value of several scripts is
    brought to the script most of whose letters have no twin elsewhere; letters without a twin stay. Blanks are not
    collapsed. Repeated rows are kept.
    """
    rest = df.drop(out_col) if out_col != text_col else df
    packed = rest.select(F.struct(*(F.col(f"`{c}`") for c in rest.columns)).alias("row"), F.col(f"`{text_col}`").cast("string").alias("item"))
    sql = "select row, ordinary from (" + canonical_sql("select row, item from batch") + ")"
    done = duckdb_over_batches(packed, sql, f"row {packed.schema['row'].dataType.simpleString()}, ordinary string")
    columns = [F.col(f"row.`{c}`").alias(c) for c in rest.columns if c != out_col]
    return done.select(*columns, F.col("ordinary").alias(out_col))


_AUTHOR = '[{"first_name":"VARCHAR","last_name":"VARCHAR","position":"INTEGER"}]'
_NOT_PLAIN = f"[^{_PLAIN}A-Za-z]"
_ITEMS = f"""
  select rec_id, 'authors_std' as field_name, a.position::int as item_pos, coalesce(a.first_name, '') || ' ' || coalesce(a.last_name, '') as item from (
    select rec_id, unnest(from_json(authors_std, '{_AUTHOR}')) as a from batch
    where regexp_matches(authors_std, '{_NOT_PLAIN}|\\\\u') and json_valid(authors_std) and json_type(authors_std) = 'ARRAY')
  union all select rec_id, 'institutions', item_pos::int, item from (
    select rec_id, unnest(institutions) as item, generate_subscripts(institutions, 1) as item_pos from batch)
  where regexp_matches(item, '{_NOT_PLAIN}')"""
_CASES = "select * from (" + canonical_sql(_ITEMS) + ") where ordinary <> item"


def odd_items(df: DataFrame) -> DataFrame:
    """``(rec_id, field_name, item_pos, item, ordinary)`` of the names and institutions not in the ordinary form.

    ``authors_std`` is JSON text (first and last name of one author taken together, ``item_pos`` its position),
    ``institutions`` an array (``item_pos`` from 1). Null, blank or broken JSON and null arrays hold no items; authors
    without a position give a null ``item_pos``. Repeated rows give repeated cases.
    """
    source = df.select(F.col("rec_id").cast("long"), F.col("authors_std").cast("string"), F.col("institutions").cast("array<string>"))
    return duckdb_over_batches(source, _CASES, "rec_id bigint, field_name string, item_pos int, item string, ordinary string")
