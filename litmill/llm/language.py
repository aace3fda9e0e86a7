"""Language of each text and of each segment where languages mix, by n-gram filters with one bit for each language.

A filter slot holds a bitmask of languages; the masks at the slots of an n-gram, taken together, name all languages that
contain it. Over a unit of text the bits are counted for each language and corrected for what chance sets, and a
path over the units that pays for each change of language gives the segments. The filters are fitted on a bounded sample
of labelled rows; wrong labels don't matter, since a language only keeps an n-gram that is about as frequent under its
label as under any other, and a second fit leaves out the rows that the first one finds in another language. Everything else is one scan without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LANGUAGES = ("en", "de", "fr", "es", "pt", "nl", "ru")

#: Frequent function words, so that a language with few labelled rows isn't unknown.
SEEDS = {
    "en": "the of and in to for with that from are is by under which these this between when not among",
    "de": "der die das und von mit für ist nicht auf den dem eine einer des zwischen ohne unter bei nach über",
    "fr": "le la les des et une dans pour avec que sur par est sous aux entre sans après cette du pendant",
    "es": "el la los las del y una con para por que en bajo sin entre tras su durante cuando se más",
    "pt": "o a os as do da dos das e uma com para por que em sob sem entre após no na não durante quando",
    "nl": "de het een van en met voor op dat niet wordt onder zonder tussen bij na over tijdens wanneer",
    "ru": "и в на с по при между без для от из что как не этой под после модель работа",
}


@dataclass(frozen=True)
class LanguageConfig:
    """``sample_rows``: labelled rows for each language that the filters are fitted on, about; the one bounded sample here.
    ``n``: letters of an n-gram. ``slot_bits``: the filters have 2 to this power slots. ``keep_ratio``: a language keeps an
    n-gram that has at least this part of the rate it has under its most frequent label (``strict_ratio`` in the first of
    the two fits). ``switch_cost``: n-grams that a
    change of language must win. ``least_margin``: n-grams by which a field's language must lead, else the rest of the row
    decides. ``chunk_chars``: characters worked at once."""

    languages: tuple[str, ...] = LANGUAGES
    sample_rows: int = 1500
    n: int = 4
    slot_bits: int = 21
    hashes: int = 2
    strict_ratio: float = 0.6
    keep_ratio: float = 0.15
    least_rows: int = 2
    switch_cost: float = 10.0
    least_margin: float = 3.0
    chunk_chars: int = 1_000_000


_KEYS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
_BREAKS = np.zeros(0x10000, bool)
_BREAKS[[ord(c) for c in ".;:!?()[]{}=|/\n\r—–\"«»“”„\x00\x01"]] = True
_LETTERS = np.array([chr(c).isalpha() for c in range(0x10000)])


def _grams(texts: list[str], config: LanguageConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """N-grams of texts joined, the unit each lies in, and the first unit of each text. A unit is a stretch between breaks."""
    joined = "".join("\x00 " + t.lower() + " " for t in texts)
    codes = np.minimum(np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32), 0xFFFF)
    breaks, letters = _BREAKS[codes], _LETTERS[codes]
    unit = np.cumsum(breaks, dtype=np.int32) - 1
    first = unit[codes == 0]
    kept = letters | np.concatenate([[True], letters[:-1]]) | breaks
    codes, unit = np.where(letters, codes, 32)[kept].astype(np.uint64), unit[kept]
    if len(codes) < config.n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32), first
    grams = codes[: len(codes) - config.n + 1].copy()
    for k in range(1, config.n):
        grams = (grams << np.uint64(16)) | codes[k : len(codes) - config.n + 1 + k]
    whole = unit[: len(grams)] == unit[config.n - 1 :]
    return grams[whole], unit[: len(grams)][whole], first


@dataclass(frozen=True)
class LanguageFilters:
    """``slots``: bitmask of languages in each slot. ``chance``: for each language, the chance that an unknown n-gram is found."""

    config: LanguageConfig
    slots: np.ndarray = field(repr=False)
    chance: np.ndarray

    @classmethod
    def fit(cls, rows: list[tuple[str, str]], config: LanguageConfig = LanguageConfig()) -> LanguageFilters:
        """From ``(label, text)`` rows; labels outside the languages are left out.

        Fitted twice: strictly on all rows, then on the rows whose text those filters find in one language, the labelled one.
        """
        rows = [(k, t) for k, t in rows if k in config.languages and t and t.strip()]
        strict = cls._fit(rows, config, config.strict_ratio)
        found = strict.segments([t for _, t in rows]) if rows else []
        sure = [r for r, s in zip(rows, found) if [config.languages.index(r[0])] == [x for x, _ in s]]
        return cls._fit(sure, config, config.keep_ratio)

    @classmethod
    def _fit(cls, rows: list[tuple[str, str]], config: LanguageConfig, keep_ratio: float) -> LanguageFilters:
        rates: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for label in config.languages:
            texts = [t for k, t in rows if k == label and t]
            grams, unit, first = _grams(texts, config) if texts else (np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32))
            text = np.searchsorted(first, unit, side="right")
            order = np.lexsort((text, grams))
            grams, text = grams[order], text[order]
            once = np.ones(len(grams), bool)
            once[1:] = (grams[1:] != grams[:-1]) | (text[1:] != text[:-1])
            found, counts = np.unique(grams[once], return_counts=True)
            enough = counts >= min(config.least_rows, max(1, len(texts)))
            rates[label] = found[enough], counts[enough] / max(1, len(texts))
        every = np.unique(np.concatenate([g for g, _ in rates.values()]))
        table = np.zeros((len(config.languages), len(every)))
        for k, (g, r) in enumerate(rates.values()):
            table[k, np.searchsorted(every, g)] = r
        keep = (table > 0) & (table >= keep_ratio * table.max(axis=0, initial=0))
        slots = np.zeros(1 << config.slot_bits, np.uint32)
        for k, label in enumerate(config.languages):
            seeds, _, _ = _grams([SEEDS.get(label, "")], config)
            for at in _slots_of(np.concatenate([every[keep[k]], seeds]), config):
                slots[at] |= np.uint32(1 << k)
        chance = np.array([(np.count_nonzero(slots & np.uint32(1 << k)) / len(slots)) ** config.hashes for k in range(len(config.languages))])
        small = np.uint8 if len(config.languages) <= 8 else np.uint32
        return cls(config, slots.astype(small), chance)

    def unit_counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each unit the corrected count of n-grams in each language and the number of n-grams; the first unit of each text."""
        grams, unit, first = _grams(texts, self.config)
        n_units = int(max(unit.max(initial=-1), first.max(initial=-1))) + 1
        masks = None
        for at in _slots_of(grams, self.config):
            masks = self.slots[at] if masks is None else masks & self.slots[at]
        size = np.bincount(unit, minlength=n_units)
        ends = np.cumsum(size)
        counts = np.zeros((n_units, len(self.chance)))
        for k in range(len(self.chance)):
            running = np.concatenate([[0], np.cumsum((masks >> k) & 1, dtype=np.int32)]) if len(grams) else np.zeros(1, np.int32)
            hits = running[ends] - running[ends - size]
            counts[:, k] = np.maximum(0, (hits - size * self.chance[k]) / (1 - self.chance[k]))
        return counts, size, first

    def segments(self, texts: list[str]) -> list[list[tuple[int, float]]]:
        """For each text its segments in order, as ``(language, confidence)``; none for a text without letters.

        ``confidence`` is 0 to 1: what part of the evidence for the language no other one has. Language -1 is undecided.
        """
        counts, _, first = self.unit_counts(texts)
        ends = np.append(first[1:], len(counts))
        running = np.concatenate([np.zeros((1, counts.shape[1])), np.cumsum(counts, axis=0)])
        total = running[ends] - running[first]
        best = np.concatenate([[0.0], np.cumsum(counts.max(axis=1))])
        bound = best[ends] - best[first]
        winner = total.argmax(axis=1)
        one = bound - total.max(axis=1, initial=0) < self.config.switch_cost
        top = np.sort(total, axis=1)
        confidence = np.where(top[:, -1] > 0, 1 - top[:, -2] / np.maximum(top[:, -1], 1e-9), 0.0)
        out: list[list[tuple[int, float]]] = []
        for k, text in enumerate(texts):
            if not text.strip():
                out.append([])
            elif one[k]:
                out.append([(int(winner[k]) if top[k, -1] - top[k, -2] >= self.config.least_margin else -1, float(confidence[k]))])
            else:
                out.append(self._path(counts[first[k] : ends[k]]))
        return out

    def _path(self, counts: np.ndarray) -> list[tuple[int, float]]:
        """The languages of successive units that hold the most n-grams, less the cost of each change."""
        n, m = counts.shape
        score, back = counts[0].copy(), np.zeros((n, m), np.int64)
        for u in range(1, n):
            leap = score.max() - self.config.switch_cost
            back[u] = np.where(score >= leap, np.arange(m), score.argmax())
            score = np.maximum(score, leap) + counts[u]
        state, path = int(score.argmax()), []
        for u in range(n - 1, -1, -1):
            path.append(state)
            state = int(back[u, state])
        path.reverse()
        out, start = [], 0
        for u in range(1, n + 1):
            if u == n or path[u] != path[start]:
                total = np.sort(counts[start:u].sum(axis=0))
                out.append((path[start], float(1 - total[-2] / total[-1]) if total[-1] > 0 else 0.0))
                start = u
        return out


def _slots_of(grams: np.ndarray, config: LanguageConfig) -> Iterator[np.ndarray]:
    for k in range(config.hashes):
        mixed = grams * _KEYS[k]
        mixed ^= mixed >> np.uint64(29)
        yield ((mixed * _KEYS[(k + 1) % len(_KEYS)]) >> np.uint64(64 - config.slot_bits)).astype(np.int64)


def fit_filters(df: DataFrame, label_col: str, text_cols: list[str], id_col: str, config: LanguageConfig = LanguageConfig()) -> LanguageFilters:
    """Filters from about ``sample_rows`` rows of each label, chosen by the hash of their id; only those reach the driver."""
    label = F.lower(F.trim(F.col(f"`{label_col}`")))
    rows = df.select(label.alias("label"), F.col(f"`{id_col}`").alias("id"), F.concat_ws("\n", *(F.col(f"`{c}`").cast("string") for c in text_cols)).alias("text"))
    rows = rows.where(F.col("label").isin(*config.languages))
    held = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    part = F.create_map(*(F.lit(x) for k, n in held.items() for x in (k, min(1.0, config.sample_rows / n)))) if held else None
    if part is None:
        return LanguageFilters.fit([], config)
    draw = F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 1_000_003.0
    chosen = rows.where(draw < F.element_at(part, F.col("label"))).select("label", "text").limit(2 * config.sample_rows * len(held))
    return LanguageFilters.fit([(r["label"], r["text"]) for r in chosen.collect()], config)


def text_languages(df: DataFrame, filters: LanguageFilters, id_col: str, text_cols: list[str], label_col: str) -> DataFrame:
    """``(id, field_name, seg_no, lang, confidence, n_langs, label)``: every segment of every row.

    ``n_langs`` counts the languages of the row's fields together; ``label`` is the delivered one, in lower case, null if it
    names none of the languages. A blank or null field has no segments. A field whose letters say nothing takes the
    language of the row's other fields, else its label, else the first language, with confidence 0. Repeated rows are
    given each; null ids are kept.
    """
    config = filters.config
    source = df.select(F.col(f"`{id_col}`").alias("_id"), F.lower(F.trim(F.col(f"`{label_col}`").cast("string"))).alias("_label"), *(F.col(f"`{c}`").cast("string").alias(f"_t{k}") for k, c in enumerate(text_cols)))
    sent = df.sparkSession.sparkContext.broadcast(filters)  # 2 ** slot_bits bytes
    names = list(config.languages)
    schema = f"_id {source.schema['_id'].dataType.simpleString()}, field_name string, seg_no int, lang string, confidence double, n_langs int, label string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            at, n = 0, batch.num_rows
            while at < n:
                upto, size = at, 0
                while upto < n and (upto == at or size < config.chunk_chars):
                    size += sum(len(c[upto] or "") for c in columns[2:])
                    upto += 1
                yield chunk(batch, columns, at, upto)
                at = upto

    def chunk(batch: pa.RecordBatch, columns: list[list], at: int, upto: int) -> pa.RecordBatch:
        width = len(text_cols)
        texts = [columns[2 + k][r] or "" for r in range(at, upto) for k in range(width)]
        found = sent.value.segments(texts)
        rows, fields, numbers, langs, sure, several, labels = [], [], [], [], [], [], []
        for r in range(at, upto):
            mine = found[(r - at) * width : (r - at + 1) * width]
            known = [s for f in mine for s in f if s[0] >= 0]
            label = columns[1][r] if columns[1][r] in names else None
            fallback = max(known, key=lambda s: s[1])[0] if known else names.index(label) if label else 0
            count = len({s[0] if s[0] >= 0 else fallback for f in mine for s in f})
            for k, f in enumerate(mine):
                for number, (lang, confidence) in enumerate(f, 1):
                    rows.append(r)
                    fields.append(text_cols[k])
                    numbers.append(number)
                    langs.append(names[lang if lang >= 0 else fallback])
                    sure.append(confidence)
                    several.append(count)
                    labels.append(label)
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(fields, pa.string()), pa.array(numbers, pa.int32()), pa.array(langs, pa.string()), pa.array(sure, pa.float64()), pa.array(several, pa.int32()), pa.array(labels, pa.string())],
            names=["_id", "field_name", "seg_no", "lang", "confidence", "n_langs", "label"],
        )

    return source.mapInArrow(run, schema).withColumnRenamed("_id", id_col)


def wrong_labels(segments: DataFrame) -> DataFrame:
    """The segments of rows whose label names no language, or another one than the text, or that hold several."""
    return segments.where(F.col("label").isNull() | (F.col("n_langs") > 1) | (F.col("label") != F.col("lang")))
