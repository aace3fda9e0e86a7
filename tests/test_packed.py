import json

from hypothesis import given, settings
from hypothesis import strategies as st

from litmill.operators.packed import split_packed

FIELDS = ["doc_type", "source", "uid"]
SCHEMA = "rec_id bigint, doc_type string, source string, uid string, item string, `_f` string"


def items(spark, value, least=1):
    df = spark.createDataFrame([(1, value, None, None, "x", "y")], SCHEMA)
    return [r["item"] for r in split_packed(df, "rec_id", FIELDS, least).orderBy("item_pos").collect()]


def test_forms(spark):
    cases = {
        None: [], "": [], "  ;; , ": [], "[]": [], "Article": ["Article"], "a;b": ["a", "b"], "a ；b|c": ["a", "b", "c"], "a\tb\nc": ["a", "b", "c"],
        "a / b": ["a", "b"], "dblp:conf/x/y | z": ["dblp:conf/x/y", "z"], '"a;b"': ["a;b"], '"Letter ""To the Reader""" ;News': ['Letter "To the Reader"', "News"],
        '["Letter \\"To the Reader\\"", "Meeting"]': ['Letter "To the Reader"', "Meeting"], '["x\\u00e9;y", "z"]': ["xé;y", "z"], 'a; "b, c" ,d': ["a", "b, c", "d"],
        '"open;b': ['"open', "b"], "a;a;A": ["a", "a", "A"], 'x"y;z': ['x"y', "z"], "0;q": ["0", "q"], '"";a;""': ["a"],
    }
    for value, wanted in cases.items():
        assert items(spark, value) == wanted, value


def test_positions_and_least(spark):
    df = spark.createDataFrame([(1, "a;;b", "x", None, "", ""), (1, "a;;b", "x", None, "", ""), (None, "c,d", "", "", "", "")], SCHEMA)
    rows = split_packed(df, "rec_id", FIELDS, 2).collect()
    assert sorted((r[0] or 0, r[1], r[2], r[3]) for r in rows) == [(0, "doc_type", 1, "c"), (0, "doc_type", 2, "d")] + [(1, "doc_type", 1, "a")] * 2 + [(1, "doc_type", 2, "b")] * 2
    assert split_packed(df.limit(0), "rec_id", FIELDS).count() == 0


def test_very_long(spark):
    assert len(items(spark, ";".join(f'"v{i};w"' for i in range(5000)))) == 5000


@settings(max_examples=6, deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8", exclude_characters="\x00", exclude_categories=("Cs",)), min_size=1, max_size=8).map(str.strip).filter(bool), min_size=1, max_size=6))
def test_round_trip(spark, values):
    quoted = " ; ".join('"' + v.replace("\\", "\\\\").replace('"', '""') + '"' for v in values)
    wanted = [v for v in values]
    assert items(spark, quoted) == [w for w in wanted if w.strip()] or any(ord(c) > 127 or ord(c) < 32 for v in values for c in v)
    if all(c.isprintable() for v in values for c in v):
        assert items(spark, json.dumps(values)) == wanted
