"""Codes, labels and document types."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

# Rules of the document types, in order; a rule is tried on every part before the next rule.
DOC_TYPE_RULES = (
    ("retraction", "^retract"),
    ("thesis", "^(phdthesis|mastersthesis|thesis)$"),
    ("book", "^(book|booklet|incollection)$"),
    ("proceedings", "^(inproceedings|proceedings|conference)"),
    ("editorial", "^(editorial|letter|comment|note|erratum|correction)"),
    ("review", "^(review|survey)"),
    ("article", "^(article|journal article|data paper|early access|meeting)"),
    ("other", "^(news|biography|abstract)"),
)


def parts(value: Column) -> Column:
    """Trimmed parts of a text between semicolons and commas, blank ones left out."""
    return F.filter(F.transform(F.split(F.coalesce(value, F.lit("")), "[;,]"), lambda x: F.trim(x)), lambda t: t != "")


def doc_type(value: Column, rules: Sequence[tuple[str, str]] = DOC_TYPE_RULES) -> Column:
    """The label of the first rule that fits at the beginning of any part; ``unknown`` without parts, ``other`` without a rule."""
    tokens = parts(value)
    out = F.when(F.size(tokens) == 0, "unknown")
    for label, pattern in rules:
        out = out.when(F.exists(tokens, _fits(pattern)), label)
    return out.otherwise("other")


def _fits(pattern: str):
    return lambda token: F.lower(token).rlike(pattern)


def code(value: Column, letter: str, most: int) -> Column:
    """A code of one letter and two digits: as it is, or from its number however padded; null if it is no such code."""
    text = F.upper(F.trim(value))
    digits = F.regexp_extract(text, rf"^{letter}?0*(\d+)$", 1)
    padded = F.concat(F.lit(letter), F.lpad(digits, 2, "0"))
    n = F.substring(F.when(text.rlike(rf"^{letter}\d\d$"), text).when(digits != "", padded), 2, 9).try_cast("int")
    return F.when(n.between(1, most), F.concat(F.lit(letter), F.lpad(n.cast("string"), 2, "0")))


def canonical_label(value: Column, allowed: Sequence[str], rescue: Sequence[tuple[str, str]], fallback: str) -> Column:
    """An allowed label: the text itself, one it contains, one a keyword stands for, in that order; else the fallback."""
    text = F.trim(F.coalesce(value, F.lit("")))
    out = F.when(text.isin(*allowed), text)
    for label in allowed:
        out = out.when(F.contains(F.lower(text), F.lit(label.lower())), label)
    for word, label in rescue:
        out = out.when(F.contains(F.lower(text), F.lit(word)), label)
    return out.otherwise(fallback)


# Entities that say nothing.
EMPTY_ENTITIES = ("not_applicable", "unspecified", "agents", "agent", "entities", "autonomous entities")


def entity_parts(value: Column, stop: Sequence[str] = EMPTY_ENTITIES) -> Column:
    """Entities of a free text parted by commas, slashes, semicolons, "and" and "&": lower case, longer than two, sorted, each once."""
    text = F.replace(F.coalesce(value, F.lit("")), F.lit("not_applicable"), F.lit(" "))
    cut = F.transform(F.split(text, r"[,/;]|\band\b|&"), lambda p: F.lower(F.trim(F.regexp_replace(F.regexp_replace(p, r"^[ .;-]+|[ .;-]+$", ""), r"\s+", " "))))
    return F.array_sort(F.array_distinct(F.filter(cut, lambda p: (F.length(p) > 2) & ~p.isin(*stop))))


def retryable(kind: Column, message: Column) -> Column:
    """Whether an error is of a kind that may pass."""
    # Marks of passing errors.
    marks = ("429", "rate limit", "timeout", "timed out", "connection", "502", "503", "504", "overload", "truncat", "unbalanced", "empty model output")
    text = F.lower(F.concat_ws(": ", F.coalesce(kind, F.lit("")), F.coalesce(message, F.lit(""))))
    return text.rlike("|".join(marks))


_FENCE = re.compile(r"```(?:json)?\s*(.*?)```", re.S)
ANSWER = StructType([StructField("object", StringType()), StructField("error", StringType())])


def _first_object(text: str | None) -> tuple[str | None, str | None]:
    """The text of the first JSON object, or why there is none."""
    if not (text or "").strip():
        return None, "empty model output"
    fenced = _FENCE.search(text)
    body = fenced[1] if fenced else text
    at = body.find("{")
    if at < 0:
        return None, "no JSON object"
    try:
        found, end = json.JSONDecoder().raw_decode(body, at)
        return (body[at:end], None) if isinstance(found, dict) else (None, "no JSON object")
    except ValueError:
        pass
    depth = 0
    for part in re.finditer(r'"(?:[^"\\]|\\.)*"?|[{}]', body[at:], re.S):
        depth += {"{": 1, "}": -1}.get(part[0], 0)
        if not depth:
            return None, "malformed JSON"
    return None, "unbalanced JSON (truncated)"


@F.pandas_udf(ANSWER)
def first_json_object(texts: pd.Series) -> pd.DataFrame:
    """``struct<object, error>``: the first JSON object in a text as it is written there, code fences left out, or why there is none.

    Only the first opening brace counts: what stands inside an object that breaks off is no answer. (Nesting is no regular
    language, hence a vectorised UDF.)
    """
    return pd.DataFrame([_first_object(t) for t in texts], columns=["object", "error"])


def classification(answer: Column, topics: int = 32, agents: int = 15, roles: int = 20) -> Column:
    """``struct<topic, agent, agent_type, llm_used, llm_role, error>`` of the text of an answer's object.

    All five fields must be there and hold a code (or a truth value for ``llm_used``), and both agent codes must be one.
    Without a language model the role is the first code. ``error`` names the first test that fails; the other fields are null then.
    """
    fields = ("topic", "agent", "agent_type", "llm_used", "llm_role")
    read = F.from_json(answer, "map<string,string>")
    absent = F.filter(F.array(*(F.lit(f) for f in fields)), lambda f: ~F.map_contains_key(read, f))
    used_text = F.lower(F.trim(read["llm_used"]))
    quoted = answer.rlike(r'"llm_used"\s*:\s*"')
    used = F.when(used_text.isin("1", "true", "yes"), 1).when(quoted | used_text.isin("0", "false"), 0)
    topic, agent, kind = code(read["topic"], "T", topics), code(read["agent"], "A", agents), code(read["agent_type"], "A", agents)
    role = F.when(used == 0, F.when(code(read["llm_role"], "L", roles).isNotNull(), F.lit("L01"))).otherwise(code(read["llm_role"], "L", roles))
    error = (
        F.when(answer.isNull() | read.isNull(), "no JSON object")
        .when(F.size(absent) > 0, F.concat(F.lit("missing field(s): "), F.array_join(absent, ", ")))
        .when(used.isNull(), "invalid llm_used")
        .when(topic.isNull(), "unrecognised T code")
        .when(agent.isNull() | kind.isNull(), "unrecognised A code")
        .when(agent != kind, "agent_type must match agent")
        .when(role.isNull(), "unrecognised L code")
    )
    good = lambda c, name: F.when(error.isNull(), c).alias(name)
    return F.struct(good(topic, "topic"), good(agent, "agent"), good(kind, "agent_type"), good(used, "llm_used"), good(role, "llm_role"), error.alias("error"))


# Kinds of agents and the words that stand for them, in the order in which they are tried.
AGENT_KINDS = (
    ("Individuals / households", "individual|household|citizen|resident|consumer|farmer|traveler|traveller|commuter|voter|pedestrian|human|people|person|population|worker"),
    ("Patients / biological", "patient|cell|organism|bacteri|virus|biological|molecul|gene|tumor|tumour|protein|neuron|species|animal|insect"),
    ("Vehicles", "vehicle|car|truck|bus|vessel|ship|aircraft|bike|bicycle|uav|unmanned|drone|robotaxi"),
    ("Robots / swarms", "robot|swarm|drone|uav"),
    ("Software / LLM agents", "software|llm|language model|chatbot|intelligent agent|virtual agent|gpt|ai agent"),
    ("Firms / institutions", "firm|bank|compan|institution|government|regulator|retailer|supplier|producer|organization|organisation|hospital|school|investor|trader|policy maker"),
    ("Network nodes / generic", "node|network|agent|entity|unit|autonomous|mobile agent|intelligent|unspecified"),
)


def agent_kinds(value: Column, kinds: Sequence[tuple[str, str]] = AGENT_KINDS) -> Column:
    """The kind of each part of a free text, parts of no kind left out and repeats kept: the first kind of which a word stands anywhere in the part."""
    text = F.replace(F.coalesce(value, F.lit("")), F.lit("not_applicable"), F.lit(""))
    cut = F.transform(F.split(text, "[,/;]| and "), lambda p: F.trim(F.regexp_replace(F.regexp_replace(p, r"^[ .;]+|[ .;]+$", ""), r"\s+", " ")))

    def kind(part: Column) -> Column:
        out = F.when(F.length(part) < 3, F.lit(None).cast("string"))
        for label, words in kinds:
            out = out.when(part.rlike(f"(?i){words}"), label)
        return out

    return F.array_compact(F.transform(cut, kind))
