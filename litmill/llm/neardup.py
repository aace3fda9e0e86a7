"""Group records that describe one publication, their titles and authors differing by small edits.

Each record gets a signature of coordinates, each made of two weighted minimum hashes over the title and one over the authors.
Documents are posted under every coordinate and value. The short lists are merged and collisions counted; the long ones are
skipped in the merge and probed by pairs of coordinates, so every pair at the match threshold or above is retained. These are
checked field by field, and the links that hold are closed to groups. Exact copies take part once.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litmill.operators.components import connected_components
from litmill.session import materialize


@dataclass(frozen=True)
class NearDupConfig:
    """``coordinates``: length of a signature. ``least_matches``: coordinates a pair must share, 2 or more. ``long_list``: members from
    which a posting list is skipped in the merge. ``block_rows``: members of a list that are compared with as many others at once.
    ``buckets``: counters of the feature frequencies (a fixed table, whatever the data). ``chunk_rows``: rows worked at once."""

    coordinates: int = 36
    least_matches: int = 2
    long_list: int = 32
    block_rows: int = 256
    buckets: int = 1 << 17
    chunk_rows: int = 4000


_FOLD = str.maketrans("øØłŁđĐðÐıßæÆœŒ", "oOlLdDdDisaAoO")
_WORDS = re.compile(r"[^\W_]+")
_TAGS = re.compile(r"</?\w{1,10}>")
_LINE_HYPHEN = re.compile(r"-\s*\n\s*")
_DROPPED = re.compile(r"[’'`´]")


@lru_cache(400_000)
def _fold_word(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", word.translate(_FOLD)) if not unicodedata.combining(c)).lower()


def fold_words(text: str | None) -> list[str]:
    """Words in lower case, without accents and signs."""
    text = text or ""
    if "<" in text:
        text = _TAGS.sub("", text)
    if "\n" in text:
        text = _LINE_HYPHEN.sub("-", text)
    if "'" in text or not text.isascii() or "`" in text:
        text = _DROPPED.sub("", text)
    if text.isascii():
        return _WORDS.findall(text.lower())
    return [f for w in _WORDS.findall(unicodedata.normalize("NFKC", text).lower()) for f in (_fold_word(w) if not w.isascii() else w).split()]


def fold(text: str | None) -> str:
    """``fold_words`` parted by one blank."""
    return " ".join(fold_words(text))


@lru_cache(400_000)
def _code(feature: str) -> int:
    return int.from_bytes(hashlib.blake2b(feature.encode(), digest_size=8).digest(), "little")


@lru_cache(200_000)
def _word_codes(word: str, kind: str) -> tuple[int, ...]:
    """Codes of a word and, so that an edit inside it leaves something, of its ends."""
    if len(word) < 5 or kind == "n":
        return (_code(kind + word),)
    return _code(kind + word), _code(kind + "^" + word[:4]), _code(kind + "$" + word[-4:])


def features(title: str | None, authors: str | None) -> tuple[list[int], list[int]]:
    """Feature codes of the title's words, and of the author names' words of three letters or more (all if there is none).

    A record that names nobody is drawn by its title on both sides, so that it meets others of its title that name nobody.
    """
    words = dict.fromkeys(fold_words(title))
    names = list(dict.fromkeys(fold_words(authors)))
    long = [n for n in names if len(n) > 2] or names
    side, people = ("a", long) if long else ("n", list(words))
    return [c for w in words for c in _word_codes(w, "t")], [c for n in people for c in _word_codes(n, side)]


def _ragged(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter((c for x in lists for c in x), np.uint64, int(sizes.sum())), sizes


#: Words below this share of the records weigh no more than those at it; most of them are slips.
RAREST = 1e-3
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _least(codes: np.ndarray, sizes: np.ndarray, weights: np.ndarray, coordinates: int, salt: int) -> np.ndarray:
    """For each row and coordinate the code that a weighted draw picks; rows without codes get 0."""
    out = np.zeros((len(sizes), coordinates), np.uint64)
    filled = sizes > 0
    if not filled.any():
        return out
    starts = (np.cumsum(sizes) - sizes)[filled]
    row = np.repeat(np.arange(int(filled.sum())), sizes[filled])
    most, inverse = np.float32(np.log(1 << 24)), (1 / weights).astype(np.float32)
    for k in range(coordinates):
        mixed = (codes ^ np.uint64((k * 2 + salt + 1) * 0x51ED2701)) * _MIX
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0xD6E8FEB86659FD93)
        draw = (most - np.log((mixed >> np.uint64(40)).astype(np.float32) + np.float32(0.5))) * inverse
        least = np.minimum.reduceat(draw, starts)
        hit = np.flatnonzero(draw == least[row])
        out[np.flatnonzero(filled)[row[hit]], k] = codes[hit]
    return out


def signatures(titles: list[str | None], authors: list[str | None], frequency: np.ndarray, rows: int, coordinates: int) -> np.ndarray:
    """Posts of each record: for each coordinate a code of its number, two draws of the title and one of the authors. Rare words weigh more."""
    parts = [features(t, a) for t, a in zip(titles, authors)]
    posts = np.zeros((len(parts), coordinates), np.uint64)
    for side, salts in ((0, (0, 101)), (1, (1,))):
        codes, sizes = _ragged([p[side] for p in parts])
        seen = np.maximum(frequency[(codes % np.uint64(len(frequency))).astype(np.int64)], max(1.0, RAREST * rows))
        weights = np.maximum(np.log((rows + 1) / seen), 0.1) ** 2
        for salt in salts:
            posts = (posts ^ _least(codes, sizes, weights, coordinates, salt)) * _MIX
            posts ^= posts >> np.uint64(31)
    return ((posts + np.arange(coordinates, dtype=np.uint64)) * _MIX).view(np.int64)


def feature_counts(titles: list[str | None], authors: list[str | None], buckets: int) -> np.ndarray:
    codes, _ = _ragged([c for t, a in zip(titles, authors) for c in features(t, a)])
    return np.bincount((codes % np.uint64(buckets)).astype(np.int64), minlength=buckets)


# Words that say nothing of a publication, forms that mean the same, and marks of a version.
_STOP = frozenset(
    "the a an of and in to for with on at by from de la le les des du et el los las del y en una un der die das und den dem des von zu ein eine "
    "het van een op o os da do dos das em no na e et al case note preprint extended abstract draft paper v1 v2 v3 version und sur dans par pour".split()
)
_SAME = {"abm": "agent based model", "multiagent": "multi agent", "agentbased": "agent based", "individualbased": "individual based"}
_VERSION = re.compile(r"\[\s*v\s*\]?\s*\d+\s*\]?|\(?\bextended abstract\b\)?|^\W*(?:preprint|a note on)\b\s*[:\-–—]?\s*", re.I)
_PART = re.compile(r"\b(?:part|pt|teil|partie|parte|deel|часть|volume|vol|no)\s*\.?\s*(\d{1,3}|[ivx]{1,5})\b", re.I)
_TAIL = re.compile(r"[.:,;\-–—]\s*(\d{1,2}|[IVX]{1,5}|[ivx]{2,5})\W*$")
_REPORT = re.compile(r"\b(\d{4})\s+\w*re?port\w*", re.I)
_RANGE = re.compile(r"(\d{4})\s*[–—-]\s*(\d{4})")
_ROMAN = {"i": "1", "ii": "2", "iii": "3", "iv": "4", "v": "5", "vi": "6", "vii": "7", "viii": "8", "ix": "9", "x": "10"}


def instalment(title: str | None) -> tuple[str, str]:
    """What part, issue or report of a series a title names, and the span of years it names; "" for none."""
    text = _VERSION.sub(" ", _TAGS.sub("", title or "")).strip(" \"'.…[]()\n")
    part = _REPORT.search(text) or _PART.search(text) or _TAIL.search(text)
    years = _RANGE.search(text)
    return (_ROMAN.get(part[1].lower(), part[1].lower()) if part else ""), ("-".join(years.groups()) if years else "")


#: Score from which two records are one publication, and that for titles of fewer than three words.
SAME_SCORE, SHORT_TITLE_SCORE = 0.4, 0.8


@lru_cache(100_000)
def near(a: str, b: str) -> bool:
    """Whether two words are one but for a typing slip: one edit from 4 letters, two from 7, a swap of neighbours counts one."""
    if a == b:
        return True
    short, long = sorted((len(a), len(b)))
    most = 0 if short < 4 else 1 if short < 7 else 2
    if long - short > most or not most or len(set(a) ^ set(b)) > 2 * most:  # an edit changes two letters at most
        return False
    return _edits(a, b, most) <= most


def _edits(a: str, b: str, most: int) -> int:
    """Edits between two words, swaps of neighbours included, or more than ``most``."""
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            cost = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if before and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, before[j - 2] + 1)
            row.append(cost)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return last[-1]


def title_words(title: str | None) -> list[str]:
    found = fold_words(_VERSION.sub(" ", _TAGS.sub("", title or "")))
    words = [x for w in found for x in _SAME.get(w, w).split()]
    return [w for w in words if w not in _STOP and not w.isdigit()]


@lru_cache(100_000)
def _letters(word: str) -> int:
    """The letters of a word as bits, so that words too unlike are told apart without a look at them."""
    bits = 0
    for c in word:
        bits |= 1 << (ord(c) & 63)
    return bits


def title_match(a: list[str], b: list[str]) -> tuple[float, int]:
    """Share of the words of both titles that have a partner, in any order, and how many lack one in the title that lacks fewer.

    Up to three words without a partner may be others run together. The share is given as 0 where it can't reach the score.
    """
    if not a or not b:
        return 0.0, max(len(a), len(b))
    rest, left = list(b), []
    for w in a:
        if w in rest:
            rest.remove(w)
        else:
            left.append(w)
    missing = len(rest) - len(left)
    lonely, masks, short = [], [_letters(x) for x in rest], (1 - SAME_SCORE**0.5) * (len(a) + len(b))
    for w in left:
        mask = _letters(w)
        for k, other in enumerate(masks):
            if (mask ^ other).bit_count() <= 4 and near(w, rest[k]):
                del rest[k], masks[k]
                break
        else:
            lonely.append(w)
            if len(lonely) > 3 and 2 * len(lonely) + missing > short:  # so many lack a partner that no score can be reached
                return 0.0, len(lonely)
    # words run together or torn apart by a slip
    if lonely and rest and len(lonely) <= 3:
        one, other = "".join(sorted("".join(lonely))), "".join(sorted("".join(rest)))
        if one == other or near("".join(lonely), "".join(rest)):
            lonely, rest = [], []
    matched = len(a) + len(b) - len(lonely) - len(rest)
    return matched / (len(a) + len(b)), min(len(lonely), len(rest))


_AUTHOR_SPLIT = re.compile(r"[;\n|]")
_ET_AL = re.compile(r"^\W*(?:et\.? al\.?|and others|u\. ?a\.|и др\.?)\W*$", re.I)


@lru_cache(100_000)
def name_parts(name: str) -> tuple[tuple[str, ...], str]:
    """Long words of one author's name and its initials (those of the long words apart)."""
    raw = _DROPPED.sub("", name)
    shout = raw.upper() == raw
    words, initials = [], ""
    for token in re.findall(r"[^\W\d_]+\.?", raw):
        bare = token.rstrip(".")
        folded = fold(bare)
        if not folded:
            continue
        if len(bare) == 1 or (token.endswith(".") and len(bare) <= 4) or (bare.isupper() and len(bare) <= 4 and not shout):
            initials += folded
        elif len(folded) <= 2 and shout:
            initials += folded
        else:
            words.append(folded)
    return tuple(words), initials


def same_name(a: str, b: str) -> bool | None:
    """Whether two written names can be one person's; None where there is nothing but initials to go by."""
    (wa, ia), (wb, ib) = name_parts(a), name_parts(b)
    if not wa or not wb:
        return None
    rest, matched, lone = list(wb), 0, []
    for w in wa:
        for k, x in enumerate(rest):
            if near(w, x):
                del rest[k]
                matched += 1
                break
        else:
            lone.append(w)
    if not matched:
        return False
    free_a, free_b = ia, ib
    for w in lone:  # a word on one side may be an initial on the other
        if w[0] in free_b:
            free_b = free_b.replace(w[0], "", 1)
        elif rest or len(w) > 3:
            return False
    for w in rest:
        if w[0] in free_a:
            free_a = free_a.replace(w[0], "", 1)
        elif lone or len(w) > 3:
            return False
    return not (free_a and free_b and not set(free_a) & set(free_b))


def author_share(a: str | None, b: str | None) -> float:
    """Share of the longer author list that has a partner in the other one, of the shorter list if either ends in "et al.".

    Authors given by initials only, on either side, are left out of the count if the initials fit; where nothing else is given,
    lists of one length count as alike. 0 if either names nobody.
    """
    (one, cut_a), (other, cut_b) = _listed(a), _listed(b)
    if len(one) > len(other):
        one, other = other, one
    if not one:
        return 0.0
    rest, missed = list(other), []
    for x in one:
        hit = next((k for k, y in enumerate(rest) if same_name(x, y)), None)
        if hit is None:
            missed.append(x)
        else:
            del rest[hit]
    unknown = 0
    for x in missed:  # against a name of initials only, either way round
        hit = next((k for k, y in enumerate(rest) if same_name(x, y) is None and _initials_fit(x, y)), None)
        if hit is not None:
            del rest[hit]
            unknown += 1
    size = len(one) if cut_a or cut_b else len(other)
    if unknown == len(one):
        return float(len(one) == len(other))
    return (len(one) - len(missed)) / (size - unknown)


def _initials_fit(a: str, b: str) -> bool:
    """Whether the initials of one name, of which there is nothing else, are among those of the other."""
    (wa, ia), (wb, ib) = name_parts(a), name_parts(b)
    one, other = sorted(("".join(w[0] for w in wa) + ia, "".join(w[0] for w in wb) + ib), key=len)
    return not Counter(one) - Counter(other)


@lru_cache(60_000)
def _listed(authors: str | None) -> tuple[tuple[str, ...], bool]:
    """The names of an author list, and whether it says that there are others."""
    names = [x.strip() for x in _AUTHOR_SPLIT.split(authors or "") if x.strip()]
    kept = tuple(x for x in names if not _ET_AL.match(x))
    return kept, len(kept) < len(names)


def publication_score(title_a: str | None, authors_a: str | None, title_b: str | None, authors_b: str | None) -> float:
    """Similarity of two records, 0 to 1: the square of the share of title words with a partner, times the share of authors with one.

    0 for different instalments of a series or report. The threshold was set on records of check_l whose DOIs are known: from 0.3
    to 0.5 it keeps 8545 to 8533 of 8547 true candidates and 63 to 4 of some 93,000 false ones.
    """
    a, b = _title_of(title_a), _title_of(title_b)
    (part_a, years_a), (part_b, years_b) = a[1], b[1]
    if part_a != part_b or years_a and years_b and not set(years_a.split("-")) & set(years_b.split("-")):
        return 0.0
    share, _ = title_match(list(a[0]), list(b[0]))
    return share**2 * author_share(authors_a, authors_b) if share**2 >= SAME_SCORE else 0.0


def same_publication(title_a: str | None, authors_a: str | None, title_b: str | None, authors_b: str | None) -> bool:
    """Whether two records describe one publication, by ``publication_score``. Records that name nobody are in no pair."""
    short = min(len(_title_of(title_a)[0]), len(_title_of(title_b)[0])) < 3
    return publication_score(title_a, authors_a, title_b, authors_b) >= (SHORT_TITLE_SCORE if short else SAME_SCORE)


@lru_cache(60_000)
def _title_of(title: str | None) -> tuple[tuple[str, ...], tuple[str, str]]:
    return tuple(title_words(title)), instalment(title)


def _posts(reps: DataFrame, frequency: np.ndarray, rows: int, config: NearDupConfig) -> DataFrame:
    """``(rep, posts array<bigint>)``."""
    sent = reps.sparkSession.sparkContext.broadcast(frequency)  # config.buckets numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, config.chunk_rows):
                part = batch.slice(at, config.chunk_rows)
                posts = signatures(part.column(1).to_pylist(), part.column(2).to_pylist(), sent.value, rows, config.coordinates)
                ends = pa.array(np.arange(0, posts.size + 1, config.coordinates), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(ends, pa.array(posts.reshape(-1)))], names=["rep", "posts"])

    return reps.select("rep", "title", "authors").mapInArrow(run, "rep bigint, posts array<bigint>")


def _frequencies(reps: DataFrame, config: NearDupConfig) -> np.ndarray:
    """How many records hold each feature, over all records, in a table of fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(config.buckets, np.int64)
        for batch in batches:
            total += feature_counts(batch.column(0).to_pylist(), batch.column(1).to_pylist(), config.buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["bucket", "n"])

    counted = reps.select("title", "authors").mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(config.buckets, np.int64)
    for bucket, n in counted.collect():  # at most config.buckets rows
        out[bucket] = n
    return out


def _colliding(keyed: DataFrame, long_list: int) -> tuple[DataFrame, DataFrame | None]:
    """Pairs ``(a, b)`` that meet under a key with at most ``long_list`` members, and the rows of the longer lists, if any.

    The rows are laid out by key once; counting works on that layout (it counts ``rep`` so that both sides have the same columns
    and share the exchange), and only rows whose key another record shares are kept.
    """
    laid = keyed.repartition("key")
    counted = materialize(laid.join(laid.groupBy("key").agg(F.count("rep").alias("n")).where("n > 1"), "key"), "collisions")
    lists = counted.where(F.col("n") <= long_list).groupBy("key").agg(F.array_sort(F.collect_set("rep")).alias("m"))
    every = F.flatten(F.transform("m", lambda x, i: F.transform(F.slice("m", i + 2, F.size("m")), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    long = counted.where(F.col("n") > long_list).drop("n")
    return lists.select(F.explode(every).alias("p")).select("p.a", "p.b"), None if long.isEmpty() else long


def candidate_pairs(reps: DataFrame, posts_of: Callable[[DataFrame], DataFrame], config: NearDupConfig) -> DataFrame:
    """Distinct pairs ``(a, b)``, a < b: all records that share ``least_matches`` coordinates or more (T), and few others.

    Lists of up to ``long_list`` members are merged and the collisions of each pair counted. Of T coordinates that a pair shares,
    either none lies in a long list (counted in full), or one (T - 1 counted, and the records are probed for a common long list), or two
    or more: then they meet under a pair of coordinates, under which the members of long lists are posted. What is long
    even then is compared in full, in blocks.
    """
    single = posts_of(reps).select("rep", F.explode("posts").alias("key"))
    met, long1 = _colliding(single, config.long_list)
    counted = met.groupBy("a", "b").agg(F.count("*").alias("n"))
    if long1 is None:
        return counted.where(F.col("n") >= config.least_matches).select("a", "b")
    counted = materialize(counted.where(F.col("n") >= config.least_matches - 1), "counted")
    own = materialize(long1.groupBy("rep").agg(F.array_sort(F.collect_set("key")).alias("keys")), "own")  # at most ``coordinates`` keys
    one, two = own.select(F.col("rep").alias("a"), F.col("keys").alias("ka")), own.select(F.col("rep").alias("b"), F.col("keys").alias("kb"))
    probed = counted.where(F.col("n") < config.least_matches).join(one, "a").join(two, "b").where(F.arrays_overlap("ka", "kb"))
    out = counted.where(F.col("n") >= config.least_matches).select("a", "b").unionByName(probed.select("a", "b"))
    pair = F.flatten(F.transform("keys", lambda x, i: F.transform(F.slice("keys", i + 2, F.size("keys")), lambda y: F.xxhash64(x, y))))
    met2, long2 = _colliding(own.where(F.size("keys") > 1).select("rep", F.explode(pair).alias("key")).distinct(), config.long_list)
    out = out.unionByName(met2)
    if long2 is not None:
        out = out.unionByName(_all_pairs(long2, config.block_rows))
    return out.distinct()


def _all_pairs(lists: DataFrame, block_rows: int) -> DataFrame:
    """Every pair ``(a, b)``, a < b, of the lists ``(key, rep)``; a pair may come from several lists.

    Lists of the same members (copies with equal signatures meet under every key) are worked once. A list is cut into hashed
    blocks, and each two of its blocks are a cell joined by itself, so no task holds a list as a whole.
    """
    h = F.xxhash64("rep")
    sized = lists.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(h).alias("x"), F.bit_xor(F.xxhash64(F.lit(7), "rep")).alias("y"))
    once = sized.groupBy("n", "x", "y").agg(F.min("key").alias("key"))
    parted = lists.join(once, "key").withColumn("blocks", F.ceil(F.col("n") / block_rows)).withColumn("block", F.pmod(h, "blocks"))
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("other")
    cells = parted.select("key", "rep", "block", other).select("key", "rep", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    cells = materialize(cells, "cells")
    one, two = cells.withColumnsRenamed({"rep": "a", "block": "p"}), cells.withColumnsRenamed({"rep": "b", "block": "q"})
    return one.join(two, ["key", "i", "j"]).where("a < b and (i = j or p <> q)").select("a", "b")


def _verified(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs ``(src, dst)`` whose records describe one publication."""
    text = reps.select("rep", "title", "authors")
    one = text.select(F.col("rep").alias("a"), F.col("title").alias("ta"), F.col("authors").alias("aa"))
    two = text.select(F.col("rep").alias("b"), F.col("title").alias("tb"), F.col("authors").alias("ab"))
    spread = max(int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * reps.sparkSession.sparkContext.defaultParallelism)
    # few bytes, much work: laid out for the second join in so many parts, which are not coalesced
    both = pairs.join(one, "a").repartition(spread, "b").join(two, "b").select("a", "b", "ta", "aa", "tb", "ab")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, *texts = (c.to_pylist() for c in batch.columns)
            keep = [k for k, four in enumerate(zip(*texts)) if same_publication(*four)]
            yield pa.RecordBatch.from_arrays([pa.array([a[k] for k in keep], pa.int64()), pa.array([b[k] for k in keep], pa.int64())], names=["src", "dst"])

    return both.mapInArrow(run, "src bigint, dst bigint")


def publication_groups(df: DataFrame, id_col: str = "rec_id", title_col: str = "title", authors_col: str = "authors", config: NearDupConfig = NearDupConfig()) -> DataFrame:
    """``(rec_id, group_id)`` of the records that share their publication with another one; ``group_id`` is the smallest id.

    Records without a title (null or without letters) or without authors are in no group: the same title by nobody known says
    nothing. Records with the same title and authors to the letter are one group. Null ids are left out, repeated ids taken once. The columns are cast to bigint and string; others are ignored.
    """
    rows = df.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{title_col}`").cast("string").alias("title"), F.col(f"`{authors_col}`").cast("string").alias("authors"))
    rows = rows.where("id is not null and title rlike '[\\\\p{L}]{2}'").withColumns({"h1": F.xxhash64("title", "authors"), "h2": F.xxhash64(F.lit(11), "authors", "title")})
    kept = rows.groupBy("h1", "h2").agg(F.min(F.struct("id", "title", "authors")).alias("r"), F.max("id").alias("last"))
    reps = materialize(kept.select(F.col("r.id").alias("rep"), "r.title", "r.authors", "h1", "h2", (F.col("last") > F.col("r.id")).alias("copied")), "reps")
    frequency = _frequencies(reps, config)
    rows_all = reps.count()
    pairs = candidate_pairs(reps, lambda some: _posts(some, frequency, rows_all, config), config)
    links = materialize(_verified(pairs, reps), "verified")
    closed = connected_components(links)
    # copies to the letter join the group of their representative, or make one
    copied = reps.where("copied").where(_copies_count(F.col("authors"))).select("h1", "h2", "rep")
    members = rows.join(copied, ["h1", "h2"]).select("id", "rep").distinct()
    grouped = members.join(closed.withColumnRenamed("id", "rep"), "rep", "left").select("id", F.coalesce("component", "rep").alias("group_id"))
    return grouped.unionByName(closed.select("id", F.col("component").alias("group_id"))).distinct().withColumnRenamed("id", id_col)


def _copies_count(authors: Column) -> Column:
    return F.trim(F.coalesce(authors, F.lit(""))) != ""


def group_pairs(groups: DataFrame, id_col: str = "rec_id") -> DataFrame:
    """Every pair of each group, smaller id first. Groups are the copies of one publication."""
    a, b = groups.select("group_id", F.col(id_col).alias(f"{id_col}_a")), groups.select("group_id", F.col(id_col).alias(f"{id_col}_b"))
    return a.join(b, "group_id").where(F.col(f"{id_col}_a") < F.col(f"{id_col}_b")).drop("group_id")
