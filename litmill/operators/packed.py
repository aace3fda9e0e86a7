"""Split fields that pack several values in one string into one row per value.

Quoted spans may hold delimiters, so they are first taken out: each becomes a placeholder that carries its index, the
rest is split at the delimiters, and the spans are put back by array lookup. Everything is a built-in expression; no
shuffle and no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters that separate values, and the slash, which does so only between blanks (identifiers hold slashes).
DELIMITERS = ";；,，|｜\t\n\r"
SLASH = r"\s/\s"
#: Placeholder brackets, and the escape for these three characters where a text holds them already.
OPEN, CLOSE, ESCAPE = "\ue000", "\ue001", "\ue002"

_edge = f"[{DELIMITERS}]"
#: A span opens at a value's start, may hold doubled or escaped quotes, and closes at the value's end.
_SPAN = rf'(?<![^\s{DELIMITERS}])"(?:[^"\\]|\\.|"")*"(?=\s*(?:{_edge}|/\s|$))'


def packed_items(value: Column) -> Column:
    """``array<string>`` of the non-empty values packed in a string, in order, repeats kept.

    Null, blank, ``[]`` and delimiters only give an empty array. An unclosed quote is an ordinary character.
    """
    text = F.coalesce(value, F.lit(""))
    listed = text.rlike(r"(?s)^\s*\[.*\]\s*$")
    body = F.when(listed, F.regexp_extract(text, r"(?s)^\s*\[(.*)\]\s*$", 1)).otherwise(text)
    for raw, code in ((ESCAPE, "2"), (OPEN, "0"), (CLOSE, "1")):
        body = F.replace(body, F.lit(raw), F.lit(ESCAPE + code))
    spans = F.regexp_extract_all(body, F.lit(_SPAN), F.lit(0))
    pieces = F.split(body, _SPAN, -1)
    last = F.size(pieces) - 1
    masked = F.array_join(
        F.transform(pieces, lambda p, i: F.when(i < last, F.concat(p, F.lit(OPEN), i.cast("string"), F.lit(CLOSE))).otherwise(p)), ""
    )
    whole = rf"^\s*{OPEN}(\d+){CLOSE}\s*$"

    def unquoted(span: Column) -> Column:
        plain = F.regexp_replace(F.replace(span.substr(F.lit(2), F.length(span) - 2), F.lit('""'), F.lit('"')), r"\\(.)", "$1")
        parsed = F.get(F.from_json(F.concat(F.lit("["), span, F.lit("]")), "array<string>"), F.lit(0))
        return F.when(listed, F.coalesce(parsed, plain)).otherwise(plain)

    def restored(part: Column) -> Column:
        at = F.regexp_extract(part, whole, 1)
        return F.when(at != "", unquoted(F.get(spans, at.try_cast("int")))).otherwise(part)

    def unescaped(item: Column) -> Column:
        for raw, code in ((CLOSE, "1"), (OPEN, "0"), (ESCAPE, "2")):
            item = F.replace(item, F.lit(ESCAPE + code), F.lit(raw))
        return F.regexp_replace(item, r"^\s+|\s+$", "")

    parts = F.split(masked, f"{_edge}|{SLASH}", -1)
    return F.filter(F.transform(parts, lambda p: unescaped(restored(p))), lambda x: x != "")


def split_packed(df: DataFrame, id_col: str, fields: list[str], min_items: int = 1) -> DataFrame:
    """One row ``(id, field_name, item_pos, item)`` for each value packed in ``fields``.

    ``item_pos`` counts non-empty values from 1, repeats included; ``item`` is trimmed, without enclosing quotes or
    escapes, its case kept. Fields with fewer than ``min_items`` values give no rows. Null ids are kept as null.
    Repeated input rows give repeated output rows. Columns of ``df`` that are not named are not read.
    """
    lists = F.array(*(F.struct(F.lit(f).alias("field_name"), packed_items(F.col(f"`{f}`").cast("string")).alias("items")) for f in fields))
    return (
        df.select(F.col(f"`{id_col}`").alias("_id"), F.explode(lists).alias("_f"))
        .where(F.size("_f.items") >= min_items)
        .select("_id", "_f.field_name", F.posexplode("_f.items").alias("_pos", "item"))
        .select(F.col("_id").alias(id_col), "field_name", (F.col("_pos") + 1).cast("int").alias("item_pos"), "item")
    )
