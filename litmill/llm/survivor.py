"""One surviving record for each group of records of one publication, field by field.

Texts are put to a consensus: the values of a group are aligned one after another, each column of the alignment is voted on
by weighted tokens, and the existing value closest to the consensus survives. A value that breaks off has no vote beyond
its end, so what only the whole value holds stays. Equal values are counted before anything moves. In groups of many
different values all of them vote as well, each aligned to the longest one, and the votes are summed across tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litmill.session import materialize


@dataclass(frozen=True)
class SurvivorConfig:
    """``gathered_values``: different values of a group that one task aligns one after another; the values of larger groups are each
    aligned to the longest one, wherever they are. ``restart_words``: a value that starts over, for so many words or more and to its end, is cut there."""

    gathered_values: int = 64
    restart_words: int = 5


# Sentences that stand in for an abstract, and marks of a value that breaks off.
STAND_INS = (
    r"(?i)^\W*(?:(?:no |the )?abstracts? (?:is |was )?(?:not |un)?available\b.*|please see the full text\b.*|n/?a|none|null|pending|abstract|-+|"
    r"kein(?:e)? (?:abstract|zusammenfassung)\b.*|résumé (?:non|in)\w*disponible.*|resumen no disponible.*|resumo (?:não|in)\w*disponível.*)\W*$"
)
_CUT = re.compile(r"\s*(?:…|\.\.\.|\(truncated\)|\[(?:\.\.\.|…)\])\s*$", re.I)
_CLOSERS = ".!?)\"'”»…。"
_CUT_INSIDE = re.compile(r"(?:…|\.\.\.|\(truncated\)|\[(?:\.\.\.|…)\])\s")


def bare_doi(value: Column) -> Column:
    """The DOI in a written form, bare and in lower case; null if there is none that can be used."""
    found = F.regexp_extract(F.lower(F.coalesce(value, F.lit(""))), r"10\.\d{4,9}/[^\s\"<>]+", 0)
    return F.nullif(F.regexp_replace(found, r"[.,;:)\]}>]+$", ""), F.lit(""))


def whole_part(value: str, config: SurvivorConfig = SurvivorConfig()) -> tuple[list[str], bool]:
    """Tokens of a value up to where it breaks off or starts over, and whether it does."""
    text = _CUT.sub("", value)
    cut = text != value
    tokens = text.split()
    head = tokens[: config.restart_words]
    if len(tokens) > 2 * len(head) and len(head) == config.restart_words:
        # from there on it must repeat the beginning to its end, but for a last word that may be broken
        again = (i for i in range(len(head), len(tokens) - len(head) + 1) if tokens[i] == head[0] and tokens[i + 1] == head[1])
        at = next((i for i in again if tokens[i:-1] == tokens[: len(tokens) - i - 1]), None)
        if at:
            kept = _CUT.sub("", " ".join(tokens[:at])).split()
            return (kept if kept and kept[-1][-1:] in _CLOSERS else kept[:-1]), True
    inside = _CUT_INSIDE.search(text)
    if inside and len(tokens) > 3:
        kept = text[: inside.start()].split()
        if head and head[0] in text[inside.end() :].split()[:2]:
            return kept, True
    ended = not tokens or tokens[-1][-1:] in _CLOSERS or len(tokens) < 4
    return (tokens, cut) if ended else (tokens[:-1], True)


def _blocks(a: list[str], b: list[str]) -> list[tuple[int, int, int]]:
    """Matching runs of two token lists; a common head and tail are taken first, since most values are cuts of one text."""
    n = min(len(a), len(b))
    head = next((i for i in range(n) if a[i] != b[i]), n)
    tail = next((i for i in range(n - head) if a[-1 - i] != b[-1 - i]), n - head)
    middle = SequenceMatcher(None, a[head : len(a) - tail], b[head : len(b) - tail], autojunk=False).get_matching_blocks()
    runs = [(0, 0, head), *((i + head, j + head, k) for i, j, k in middle if k)]
    return [*(r for r in runs if r[2]), *([(len(a) - tail, len(b) - tail, tail)] if tail else [])]


def consensus(values: list[tuple[str, float]], config: SurvivorConfig = SurvivorConfig()) -> int:
    """Index of the value closest to the consensus of ``(value, weight)``; the heavier, then the first one of equals."""
    parts = [whole_part(v, config) for v, _ in values]
    order = sorted(range(len(values)), key=lambda i: (-len(parts[i][0]), parts[i][1], i))
    columns: list[dict[str, float]] = []
    against: list[float] = []
    for i in order:  # progressive: the longest value first, each other one against the columns so far
        tokens, weight = parts[i][0], values[i][1]
        leading = [max(c, key=c.get) for c in columns]
        at, used, grown, votes = 0, 0, [], []
        for a, b, k in [*_blocks(leading, tokens), (len(leading), len(tokens), 0)]:
            for x in range(at, a):
                grown.append(columns[x])
                votes.append(against[x] + (weight if b < len(tokens) or k else 0))  # no vote beyond its end
            for y in range(used, b):
                grown.append({tokens[y]: weight})
                votes.append(sum(values[j][1] for j in order[: order.index(i)]) if a < len(leading) else 0.0)
            for z in range(k):
                columns[a + z][tokens[b + z]] = columns[a + z].get(tokens[b + z], 0) + weight
                grown.append(columns[a + z])
                votes.append(against[a + z])
            at, used = a + k, b + k
        columns, against = grown, votes
    agreed = [max(c, key=c.get) for c, v in zip(columns, against) if max(c.values()) >= v]

    def distance(i: int) -> tuple:
        same = sum(k for _, _, k in _blocks(agreed, parts[i][0]))
        return len(agreed) + len(parts[i][0]) - 2 * same, parts[i][1], -values[i][1], i

    return min(range(len(values)), key=distance)


def consensus_values(values: DataFrame, config: SurvivorConfig = SurvivorConfig()) -> DataFrame:
    """``(group_id, id, value)``: of each group the value closest to its consensus, with the smallest id that has it.

    ``values``: group_id bigint, id bigint, value string; null and blank values take no part.
    """
    kept = values.where(F.trim(F.col("value")) != "")
    counted = kept.groupBy("group_id", "value").agg(F.min("id").alias("id"), F.count("*").cast("double").alias("weight"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups, members = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows = []
            for group, found in zip(groups, members):
                found.sort(key=lambda m: m["id"])
                best = found[consensus([(m["value"], m["weight"]) for m in found], config)] if len(found) > 1 else found[0]
                rows.append((group, best["value"], best["id"], sum(m["weight"] for m in found)))
            columns = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int64(), pa.float64()))], names=["group_id", "value", "id", "weight"])

    current = materialize(counted, "values")
    sizes = current.groupBy("group_id").agg(F.count("*").alias("n"))
    large = sizes.where(F.col("n") > config.gathered_values).select("group_id")
    none = large.isEmpty()
    bounded = (current if none else current.join(large, "group_id", "left_anti")).groupBy("group_id").agg(F.collect_list(F.struct("id", "value", "weight")).alias("m"))
    small = bounded.mapInArrow(run, "group_id bigint, value string, id bigint, weight double").select("group_id", "id", "value")
    return small if none else small.unionByName(_of_large(current.join(large, "group_id", "left_semi"), config))


def _of_large(values: DataFrame, config: SurvivorConfig) -> DataFrame:
    """``(group_id, id, value)`` of groups of any number of values ``(group_id, value, id, weight)``: every value is aligned to the
    longest one of its group and votes for or against its tokens, up to its own end; the value closest to the tokens agreed on survives."""
    pick = lambda *names: ", ".join({"group_id": "group_id bigint", "value": "value string", "id": "id bigint", "weight": "weight double"}.get(n, n) for n in names)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [whole_part(v, config) for v in batch.column("value").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("group_id", "value", "id", "weight")), pa.array([len(t) for t, _ in parts], pa.int32()), pa.array([c for _, c in parts], pa.bool_())], names=["group_id", "value", "id", "weight", "size", "cut"])

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for group, value, weight, centre in zip(*(batch.column(n).to_pylist() for n in ("group_id", "value", "weight", "centre"))):
                mine, at, used = whole_part(value, config)[0], 0, 0
                for x, y, k in _blocks(whole_part(centre, config)[0], mine):
                    both = min(x - at, y - used)  # tokens that stand in for each other
                    rows += [(group, at + j, at + j + 1, weight, mine[used + j]) for j in range(both)]
                    rows += [(group, at + both, x, weight, ""), (group, x, x + k, weight, None)]
                    at, used = x + k, y + k
            columns = list(zip(*rows)) or [()] * 5
            types = (pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["group_id", "first", "last", "weight", "token"])

    def distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = []
            for value, centre, kept in zip(*(batch.column(n).to_pylist() for n in ("value", "centre", "kept"))):
                tokens = whole_part(centre, config)[0]
                agreed, mine = [tokens[k["place"]] if k["token"] is None else k["token"] for k in kept or ()], whole_part(value, config)[0]
                far.append(len(agreed) + len(mine) - 2 * sum(k for _, _, k in _blocks(agreed, mine)))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("group_id", "value", "id", "weight", "cut")), pa.array(far, pa.int32())], names=["group_id", "value", "id", "weight", "cut", "far"])

    sized = values.select("group_id", "value", "id", "weight").mapInArrow(measured, pick("group_id", "value", "id", "weight", "size int", "cut boolean"))
    centre = sized.groupBy("group_id").agg(F.min_by("value", F.struct(-F.col("size"), "cut", "id")).alias("centre"))
    joined = materialize(sized.join(centre, "group_id"), "centred")
    cast = joined.select("group_id", "value", "weight", "centre").mapInArrow(votes, pick("group_id", "first int", "last int", "weight", "token string"))
    places = cast.where(F.col("last") > F.col("first")).select("group_id", F.explode(F.sequence("first", F.col("last") - 1)).alias("place"), "weight", "token")
    # null stands for the centre's own token, "" for a vote against any
    tokens = places.groupBy("group_id", "place", "token").agg(F.sum("weight").alias("weight"))
    named = F.when(~F.col("token").eqNullSafe(F.lit("")), F.struct("weight", F.col("token").isNull().alias("own"), "token"))
    chosen = tokens.groupBy("group_id", "place").agg(F.max(named).alias("best"), F.sum(F.when(F.col("token") == "", F.col("weight")).otherwise(0.0)).alias("no"))
    kept = chosen.where("best.weight >= no").groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct("place", "best.token"))).alias("kept"))  # at most the centre's tokens
    far = joined.join(kept, "group_id", "left").mapInArrow(distances, pick("group_id", "value", "id", "weight", "cut boolean", "far int"))
    best = far.groupBy("group_id").agg(F.min_by(F.struct("id", "value"), F.struct("far", "cut", -F.col("weight"), "id")).alias("b"))
    return best.select("group_id", "b.id", "b.value")


def survivors(records: DataFrame, groups: DataFrame, config: SurvivorConfig = SurvivorConfig()) -> DataFrame:
    """``(group_id, abstract_rec_id, cited_rec_id, best_doi)``: what survives of each group.

    ``records``: rec_id, abstract, times_cited, doi, collected_at; ``groups``: rec_id, group_id. The abstract is the value
    closest to the consensus of those that are no stand-in (-1 if there is none), of equal ones the smallest rec_id. The
    count is the known one, above 0, collected last (ties: the larger rec_id; a null time is the earliest), else -1. The
    DOI is the consensus of the usable ones, bare and in lower case, else "". Repeated rows count as votes.
    """
    fields = records.select(F.col("rec_id").cast("bigint").alias("rec_id"), F.col("abstract").cast("string").alias("abstract"), F.col("times_cited").cast("bigint").alias("times_cited"), F.col("doi").cast("string").alias("doi"), F.col("collected_at").cast("timestamp").alias("collected_at"))
    members = materialize(fields.join(groups.select("rec_id", "group_id"), "rec_id"), "members")
    usable = F.when(~F.trim("abstract").rlike(STAND_INS) & F.trim("abstract").rlike(r"\S"), F.col("abstract"))
    texts = consensus_values(members.select("group_id", F.col("rec_id").alias("id"), usable.alias("value")), config)
    dois = consensus_values(members.select("group_id", F.col("rec_id").alias("id"), bare_doi(F.col("doi")).alias("value")), config)
    known = F.when(F.col("times_cited") > 0, F.struct(F.coalesce("collected_at", F.timestamp_micros(F.lit(0))), "rec_id"))
    cited = members.groupBy("group_id").agg(F.max(known).alias("last"))
    return (
        cited.join(texts.select("group_id", F.col("id").alias("text_id")), "group_id", "left")
        .join(dois.select("group_id", F.col("value").alias("doi")), "group_id", "left")
        .select(
            "group_id",
            F.coalesce("text_id", F.lit(-1)).alias("abstract_rec_id"),
            F.coalesce("last.rec_id", F.lit(-1)).alias("cited_rec_id"),
            F.coalesce("doi", F.lit("")).alias("best_doi"),
        )
    )
