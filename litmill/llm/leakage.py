"""Find held-out passages inside a training corpus with an FM-index per shard of documents.

Each task packs its documents into shards, builds an index over the words of a shard (suffix array, transform, wavelet
matrix) and searches all phrases of the held-out items in it by backward search, all phrases at once. Occurrences are
located by walking to sampled suffix positions, joined to the item's word positions, and merged to spans. The corpus is
read once and never shuffled; only the held-out items travel, in blocks of bounded size.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_REFERENCE_MARK = re.compile(r"\[\d+\]")
_SIGNS = re.compile(r"[^\w\s]+")
_TOKEN = re.compile(r"\S+(?:-\n\S+)*")


@dataclass(frozen=True)
class LeakConfig:
    """``phrase_words``: length of the phrases searched. ``least_share``: weighted share of an item's phrases that a document must
    hold: a third of the words less the phrases that run over the passage's ends. A phrase weighs the reciprocal root of the number
    of items that hold it, so texts of the same sentence pattern stay far below, and a passage that two items share counts for both.
    ``shard_words``: words a shard holds at most, except for one longer text. ``block_words``: words of held-out items
    searched, and sent to the executors, at once. ``sample_every``: distance of the sampled suffix positions. ``join_gap``: words
    between two matched spans that are removed with them."""

    phrase_words: int = 4
    least_share: float = 0.3
    shard_words: int = 1_000_000
    block_words: int = 2_000_000
    sample_every: int = 8
    join_gap: int = 12


def words_of(text: str | None) -> list[str]:
    """Words in lower case without signs; words broken at a line end are joined and numbers of references dropped."""
    text = (text or "").lower()
    if "-\n" in text:
        text = text.replace("-\n", "")
    if "[" in text:
        text = _REFERENCE_MARK.sub("", text)
    return _SIGNS.sub("", text).split()


def word_offsets(text: str) -> list[tuple[int, int]]:
    """Start and end in ``text`` of each word that ``words_of`` gives."""
    return [m.span() for m in _TOKEN.finditer(text) if words_of(m.group())]


class FMIndex:
    """Full-text index over integer symbols: counts and positions of a pattern without the text.

    Symbols are 0 (only at the very end) to ``sigma`` - 1. All methods take and give arrays, so many patterns or
    occurrences are worked at once.
    """

    def __init__(self, symbols: np.ndarray, sigma: int, sample_every: int = 8):
        text = np.append(symbols, 0).astype(np.int64)
        self.n, self.levels = len(text), max(1, int(sigma - 1).bit_length())
        suffixes = suffix_array(text, self.levels)
        transform = text[suffixes - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))]).astype(np.int64)
        marked = suffixes % sample_every == 0
        self.marked, self.mark_rank = marked, np.cumsum(marked, dtype=np.int32)
        self.samples = suffixes[marked].astype(np.int32)
        self.ranks, self.zeros, current = [], [], transform
        for level in range(self.levels - 1, -1, -1):  # wavelet matrix
            bits = ((current >> level) & 1).astype(bool)
            self.ranks.append(np.concatenate([[0], np.cumsum(bits, dtype=np.int32)]).astype(np.int32))
            self.zeros.append(self.n - int(self.ranks[-1][-1]))
            current = np.concatenate([current[~bits], current[bits]])

    def rank(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """How often each symbol stands in the transform before each row."""
        start = np.zeros_like(row)
        for ones, zeros, level in zip(self.ranks, self.zeros, range(self.levels - 1, -1, -1)):
            bit = (symbol >> level) & 1 == 1
            a, b = ones[start], ones[row]
            start, row = np.where(bit, zeros + a, start - a), np.where(bit, zeros + b, row - b)
        return row - start

    def step_back(self, row: np.ndarray) -> np.ndarray:
        """The rows of the suffixes that start one symbol earlier."""
        start, end, symbol = np.zeros_like(row), row, np.zeros_like(row)
        for ones, zeros in zip(self.ranks, self.zeros):
            a, b = ones[start], ones[end]
            bit = ones[end + 1] > b
            symbol = symbol * 2 + bit
            start, end = np.where(bit, zeros + a, start - a), np.where(bit, zeros + b, end - b)
        return self.first[symbol] + end - start

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First row and end of the rows of each pattern; ``patterns`` has one row of symbols for each."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for column in range(patterns.shape[1] - 1, -1, -1):
            symbol = patterns[:, column]
            low, high = self.first[symbol] + self.rank(symbol, low), self.first[symbol] + self.rank(symbol, high)
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of the suffix of each row."""
        at, steps, open_ = rows.astype(np.int64).copy(), np.zeros(len(rows), np.int64), np.arange(len(rows))
        out = np.empty(len(rows), np.int64)
        while len(open_):
            done = self.marked[at]
            out[open_[done]] = self.samples[self.mark_rank[at[done]] - 1] + steps[done]
            open_, at, steps = open_[~done], at[~done], steps[~done] + 1
            if len(open_):
                at = self.step_back(at)
        return out


def suffix_array(text: np.ndarray, bits: int) -> np.ndarray:
    """Suffixes of ``text``, whose last symbol is its only 0, in order. Ranks of a packed prefix are doubled; only suffixes still tied are sorted again."""
    n, width = len(text), max(1, 60 // bits)
    key = np.zeros(n, np.int64)
    for k in range(width):
        key = (key << bits) | np.concatenate([text[k:], np.zeros(min(k, n), np.int64)])[:n]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.concatenate([[0], np.where(same, 0, np.arange(1, n))]) if n else 0
    rank[order] = np.maximum.accumulate(rank[order])
    tied = np.zeros(n, bool)
    tied[1:] |= same
    tied[:-1] |= same
    slots = np.flatnonzero(tied)
    while len(slots):
        members = order[slots]
        beyond = members + width
        follow = np.where(beyond < n, rank[np.minimum(beyond, n - 1)] + 1, 0)
        head = rank[members]
        again = np.lexsort((follow, head))
        members, head, follow = members[again], head[again], follow[again]
        order[slots] = members
        new = np.concatenate([[True], (head[1:] != head[:-1]) | (follow[1:] != follow[:-1])])
        rank[members] = np.maximum.accumulate(np.where(new, slots, 0))
        alone = new & np.append(new[1:], True)
        slots = slots[~alone]
        width *= 2
    return order


@dataclass(frozen=True)
class Phrases:
    """The phrases searched: symbols of each, its weight, and where each stands in its items."""

    vocabulary: dict[str, int]
    patterns: np.ndarray
    items: list[list[tuple[int, int]]]  # of each pattern: index of the item, word position
    ids: list
    weight: np.ndarray  # of each pattern
    total: np.ndarray  # of each item: the weight of all its places


def phrase_spread(items: DataFrame, config: LeakConfig) -> dict[tuple, int]:
    """In how many items a phrase stands, for those in more than one; over all items, whatever block they are searched in.

    Counted on the cluster; what comes back are the phrases that items share, fewer than the words of the items.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(" ".join(g), i) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for g in set(_grams(words_of(t), config.phrase_words))]
            yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in rows], pa.string())], names=["g"])

    counted = items.select("_item", "_t").mapInArrow(run, "g string").groupBy("g").agg(F.count("*").alias("n")).where("n > 1")
    return {tuple(g.split(" ")): n for g, n in counted.toLocalIterator()}


def _grams(words: list[str], k: int) -> list[tuple]:
    """The phrases of an item; one shorter than a phrase is a phrase as a whole."""
    return [tuple(words[p : p + k]) for p in range(max(1, len(words) - k + 1) if words else 0)]


def phrases_of(items: list[tuple], config: LeakConfig, spread: dict[tuple, int] | None = None) -> Phrases:
    """All phrases of the items. ``spread``: in how many items a phrase stands; counted over these items if not given."""
    words = [words_of(t) for _, t in items]
    places: dict[tuple, list[tuple[int, int]]] = defaultdict(list)
    for i, w in enumerate(words):
        for p, g in enumerate(_grams(w, config.phrase_words)):
            places[g].append((i, p))
    if spread is None:
        spread = {g: len({i for i, _ in v}) for g, v in places.items()}
    weight = np.array([spread.get(g, 1) ** -0.5 for g in places], np.float64)
    total = np.zeros(len(items))
    for w, v in zip(weight, places.values()):
        for i, _ in v:
            total[i] += w
    vocabulary = {x: n for n, x in enumerate(dict.fromkeys(x for g in places for x in g), 2)}
    width = max(map(len, places), default=1)
    patterns = np.array([[vocabulary[x] for x in g] + [-1] * (width - len(g)) for g in places], np.int64).reshape(len(places), width)
    return Phrases(vocabulary, patterns, list(places.values()), [i for i, _ in items], weight, total)


def _in_order(found: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int, float]]:
    """The heaviest set of matches ``(text position, item position, size, weight)`` whose item positions rise with their text positions, each place of the item once."""
    rows = sorted(found, key=lambda x: (x[0], -x[1]))
    rank = {q: n for n, q in enumerate(sorted({q for _, q, _, _ in rows}), 1)}
    best: list[tuple[float, int]] = [(0.0, -1)] * (len(rank) + 1)  # largest weight up to a rank, in a tree of prefixes
    back = []
    for k, (_, q, _, w) in enumerate(rows):
        at, top = rank[q] - 1, (0.0, -1)
        while at:
            top = max(top, best[at])
            at -= at & -at
        back.append(top[1])
        mine, at = (top[0] + w, k), rank[q]
        while at < len(best):
            best[at] = max(best[at], mine)
            at += at & -at
    k, at = (0.0, -1), len(rank)
    while at:
        k = max(k, best[at])
        at -= at & -at
    out, k = [], k[1]
    while k >= 0:
        out.append(rows[k])
        k = back[k]
    return out[::-1]


def search_shard(texts: list[str | None], phrases: Phrases, config: LeakConfig, tokens: list[list[str]] | None = None) -> list[tuple[int, int, float, list[tuple[int, int]]]]:
    """``(text, item, share, spans)`` of one shard: indexes of text and item, the share found, and character spans to remove."""
    tokens = tokens or [words_of(t) for t in texts]
    code = phrases.vocabulary.get
    parts = [np.array([code(w, 1) for w in t] + [1], np.int64) for t in tokens]
    starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    index = FMIndex(np.concatenate(parts), len(phrases.vocabulary) + 2, config.sample_every)
    matches: dict[tuple[int, int], list[tuple[int, int, int, float]]] = defaultdict(list)
    lengths = (phrases.patterns >= 0).sum(axis=1)
    for size in np.unique(lengths):
        which = np.flatnonzero(lengths == size)
        low, high = index.search(phrases.patterns[which, :size])
        counts = high - low
        rows = np.repeat(low, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        at = index.locate(rows)
        text = np.searchsorted(starts, at, side="right") - 1
        for pattern, t, p in zip(np.repeat(which, counts).tolist(), text.tolist(), (at - starts[text]).tolist()):
            for item, q in phrases.items[pattern]:
                matches[t, item].append((p, q, int(size), float(phrases.weight[pattern])))
    out = []
    for (t, item), found in sorted(matches.items()):
        total = float(phrases.total[item])
        if sum({q: w for _, q, _, w in found}.values()) < config.least_share * total:
            continue
        chain = _in_order(found)
        share = sum(w for *_, w in chain) / total
        if share < config.least_share:
            continue
        spans: list[list[int]] = []
        for p, _, size, _ in sorted({*chain, *(m for m in found if m[3] >= 0.5)}):  # a passage may stand there twice
            if spans and p <= spans[-1][1] + config.join_gap:
                spans[-1][1] = max(spans[-1][1], p + size)
            else:
                spans.append([p, p + size])
        offsets = word_offsets(texts[t])
        last = len(offsets) - 1
        cut = [(offsets[min(a, last)][0], offsets[min(b - 1, last)][1]) for a, b in spans]
        out.append((t, item, share, cut))
    return out


def leaks(corpus: DataFrame, items: DataFrame, config: LeakConfig = LeakConfig(), id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``(doc_id, item_id, share, spans array<struct<start, end>>)`` of the documents that hold a passage of an item.

    ``share`` is the weighted part of the item's phrases found in order; ``spans`` are character offsets to remove, merged, in order.
    Null and empty texts and items hold nothing. A repeated document is reported for each copy, a repeated item under
    each of its ids. Whole texts are searched; other columns are ignored.
    """
    spark = corpus.sparkSession
    source = corpus.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    held = items.select(F.col(f"`{item_id}`").alias("_item"), F.col(f"`{item_text}`").cast("string").alias("_t")).where(F.trim("_t") != "")
    id_type, item_type = source.schema["_id"].dataType.simpleString(), held.schema["_item"].dataType.simpleString()
    schema = f"_id {id_type}, _item {item_type}, share double, spans array<struct<start:int,end:int>>"
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def scan(phrases: Phrases) -> DataFrame:
        sent = spark.sparkContext.broadcast(phrases)  # at most block_words words

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, texts, tokens, size = [], [], [], 0

            def flush() -> pa.RecordBatch:
                found = search_shard(texts, sent.value, config, tokens)
                return pa.RecordBatch.from_arrays(
                    [
                        pa.array([ids[t] for t, *_ in found], id_arrow),
                        pa.array([sent.value.ids[i] for _, i, *_ in found], item_arrow),
                        pa.array([s for _, _, s, _ in found], pa.float64()),
                        pa.array([[{"start": a, "end": b} for a, b in c] for *_, c in found], span_type),
                    ],
                    names=["_id", "_item", "share", "spans"],
                )

            for batch in batches:
                for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    found = words_of(text)
                    if not found:
                        continue
                    if size and size + len(found) > config.shard_words:
                        yield flush()
                        ids, texts, tokens, size = [], [], [], 0
                    ids.append(key)
                    texts.append(text)
                    tokens.append(found)
                    size += len(found)
            if size:
                yield flush()

        return source.mapInArrow(run, schema)

    from pyspark.sql.pandas.types import to_arrow_type

    id_arrow, item_arrow = to_arrow_type(source.schema["_id"].dataType), to_arrow_type(held.schema["_item"].dataType)
    spread = phrase_spread(held, config)
    result, block, size = None, [], 0
    for row in held.orderBy("_item").toLocalIterator():  # a stated query set, block by block
        block.append((row["_item"], row["_t"]))
        size += len(row["_t"].split())
        if size >= config.block_words:
            part = scan(phrases_of(block, config, spread))
            result, block, size = (part if result is None else result.unionByName(part)), [], 0
    if block or result is None:
        part = scan(phrases_of(block, config, spread)) if block else spark.createDataFrame([], schema)
        result = part if result is None else result.unionByName(part)
    return result.withColumnsRenamed({"_id": id_col, "_item": item_id})
