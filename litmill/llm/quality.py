"""Per-document text statistics and fixed-threshold rules that tell prose from lists, tables and junk.

One scan, no shuffle. All statistics are made by Arrow and NumPy kernels over whole batches: the texts are split to words,
lines and sentences once, distinct words are judged once, and counts come back to the documents by sums over segments
(built-in higher-order functions over lines and words were measured at about ten times the CPU). Two sets of rules leave
their reasons: those of published filters for web text, with their published thresholds, and rules on typed lines
(bullet, table row, rule, dump, log, code), since one stray line must not decide a document. Each has a kind; the
first rule that fires decides it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Frequent function words of en, de, fr, es, pt, nl and ru.
COMMON_WORDS = frozenset(
    (
        "the of and to in is a an for by with that are on as at from be this which it we or not if has have was were "
        "der die das und den dem des ein eine einer einen mit von zu auf für ist im nicht sich bei über unter nach zwischen "
        "le la les un une du et en dans par pour sur avec ce cette au aux sous après entre sans que qui pendant "
        "el los las del y una por con sin se al bajo tras cuando su como este "
        "o os do da dos das e em uma no na nos nas sob ao à são "
        "de het een van op met voor door te aan dat niet wanneer onder tussen zonder "
        "и в на с по при между без для от из что как не к под о об за после или это"
    ).split()
)

#: Fixed thresholds of the rules on typed lines and on words in several languages, which published filters do not have.
RULES = {
    "nonprose_share": 0.5,  # of a text's visible characters
    "common_share": 0.06,  # natural prose of these languages has at least this share of function words
    "common_words_from": 12,  # words a text must have for that rule
    "symbol_share": 0.25,
    "broken_share": 0.04,  # characters that wrong decoding leaves
    "single_letter_share": 0.6,
    "repeated_share": 0.6,  # of the sentences, copies of earlier ones
    "repeated_from": 5,
    "odd_word_share": 0.3,
    "entry_words": 6.0,  # words between two separators
    "entries_from": 6,
    "cells_distinct": 0.5,  # of the cells of one line; menus repeat theirs
    "bullet_sentence": 160,  # characters from which a bulleted sentence counts as text
}

#: Fixed thresholds of published filters: Rae et al. 2021 (MassiveText: words, lines, repetition), Raffel et al. 2020 (C4: marks
#: at line ends, placeholder text and braces). Rules that a short abstract, a list inside a text or a language without
#: these stop words breaks too only record a reason; they decide no kind. Of each: the test and the kind, None for no kind.
PUBLISHED = {
    "few_words": (50, None),
    "many_words": (100_000, None),
    "short_mean_word": (3.0, None),
    "long_mean_word": (10.0, "junk"),
    "symbols_per_word": (0.1, None),
    "bullet_lines": (0.9, "list"),
    "ellipsis_lines": (0.3, None),
    "alphabetic_words": (0.8, None),
    "stop_words": (2, None),
    "repeated_lines": (0.3, None),
    "unmarked_lines": (0.0, None),
    "placeholder": (0, None),
}

_L = r"[\p{L}\p{N}\p{M}_]"  # a word character
_NUMERIC = r"(?:[-+]?[\d.,]+%?|n\.s\.|-|n/?a)"
# Patterns of a line, for the engine of Arrow; all but the first stand for the whole line or its beginning.
_PATTERNS = {
    "ends": r"[.!?…。]['\"»”’)\]\s]*$",
    "sentence": r"^\s*\p{L}{3,}\s+\p{L}+(?:\s|$)",
    "visible": r"[\p{L}\p{N}\p{M}]",
    "tag": rf"</?{_L}+[^>]*>|&{_L}+;",
    "bullet": r"^\s*(?:[-*•‣▪◦·–—]|\(?\d{1,3}[.)]|\(?[a-zA-Z][.)]|\(?[ivx]{1,4}[.)]|\[\d{1,3}\]|\d+(?:\.\d+)+)\s+\S",
    "reference": r"^\s*(?:\[\d{1,3}\]|\d{1,3}[.)])\s+\S",
    "contents": r"(?:\.{3,}|(?:\s\.){3,})\s*\d+\s*$",
    "index": r"^[^\d\s][^.!?]*?\s+\d{1,4}(?:\s*[,–-]\s*\d{1,4})*\s*$",
    "named": rf"^\s*{_L}(?:{_L}|[ .()/%-]){{0,40}}?\s*(?:=|:)\s*(?:{_NUMERIC}|\S+)\s*$",
    "columns": r"\S {2,}\S.*\S {2,}\S",
    "separated": rf"^(?:[^,;]{{1,40}}(?:[,;]\s*{_NUMERIC}\s*){{2,}}$|[^,;\s]+(?:[,;][^,;\s]*){{2,}}$)",
    "dump": r"^(?:\s*(?:0x)?[0-9a-fA-F]{4,}:?(?:\s+[0-9a-fA-F]{2,4}){3,}|(?:[0-9a-fA-F]{2}\s+){6,})",
    "log": r"^(?:.*\b\d{2}:\d{2}:\d{2}\b.*\b(?:DEBUG|INFO|WARN|WARNING|ERROR|FATAL|TRACE)\b|\s*(?:Traceback|at \S+\(|File \"|\[?(?:DEBUG|INFO|WARN|ERROR)\b))",
    "code": rf"^(?:.*[{{}};]\s*$|\s*(?:def |class |import |from \S+ import|return\b|for\s*\(|for {_L}+ in .*:|if\s*\(|if .*:\s*$|else\s*[:{{]|elif |while\b.*[:({{]|#include|public |private |static |var |const |function\b|try:|except\b"
    rf"|to \S+\s*$|end\s*$|ask \S+ \[|set \S+ \S+|let \S+ )|.*{_L}\(.*\)\s*[;{{:]?\s*$|\s*(?:{_L}|[.\[\]])+\s*[-+*/]?=\s*\S.*|\s*[{{}}\])]+)",
}
_BROKEN = re.compile(r"[ÃÂâÐÑ€œžŸ¶§½¿¤¬¡¢£¥¦¨©ª®¯°±²³´µ¸¹º¼¾�]")
_ODD = re.compile(r"[bcdfghjklmnpqrstvwxz]{5,}|[bcdfghjklmnpqrstvwxz]{3,}$|^[bcdfghjklmnpqrstvwxz]{4,}|(.)\1\1")
#: Bytes of text measured at once, or one text.
BATCH_BYTES = 16 << 20
KINDS = ("text", "list", "table", "junk")
TEXT, LIST, TABLE, JUNK = range(4)


def _numbers(values: pa.Array) -> np.ndarray:
    return values.to_numpy(zero_copy_only=False)


def _segments(lists: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    """The values of a list array, and of each the row it stands in."""
    sizes = _numbers(pc.list_value_length(lists)).astype(np.int64)
    return lists.flatten(), np.repeat(np.arange(len(sizes)), sizes)


def line_kinds(lines: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kind of each line (places of ``KINDS``), whether it is a bulleted or listed line, and whether it closes with a sentence mark."""
    n = len(lines)
    is_ = {name: _numbers(pc.match_substring_regex(lines, p)) for name, p in _PATTERNS.items() if name in ("ends", "sentence", "visible", "bullet")}
    words = _numbers(pc.list_value_length(pc.utf8_split_whitespace(pc.utf8_trim_whitespace(lines))))
    size = _numbers(pc.utf8_length(lines))
    pipes, tabs = _numbers(pc.count_substring(lines, "|")), _numbers(pc.match_substring(pc.utf8_trim_whitespace(lines), "\t"))
    angle, score = _numbers(pc.match_substring(lines, "<")), _numbers(pc.match_substring(lines, "_"))
    kind, left = np.full(n, TEXT, np.int8), np.ones(n, bool)
    listed = np.zeros(n, bool)

    def settle(test: np.ndarray, as_: int) -> None:
        nonlocal left
        hit = left & test
        kind[hit] = as_
        left &= ~hit

    def among(test: np.ndarray, name: str) -> np.ndarray:
        """A pattern tried only on the open lines that pass a cheaper test."""
        at = np.flatnonzero(left & test)
        out = np.zeros(n, bool)
        if len(at):
            out[at] = _numbers(pc.match_substring_regex(lines.take(pa.array(at)), _PATTERNS[name]))
        return out

    ends = is_["ends"]
    every = np.ones(n, bool)
    settle((words > 7) & ends & is_["sentence"] & (pipes == 0) & ~tabs & ~angle, TEXT)
    settle(~is_["visible"] & (pipes > 0) & ~score & _numbers(pc.match_substring(lines, "-")), TABLE)
    settle(~is_["visible"], JUNK)
    marked = among(angle | _numbers(pc.match_substring(lines, "&")), "tag")
    if marked.any():
        at = np.flatnonzero(marked)
        rest = _numbers(pc.utf8_length(pc.replace_substring_regex(lines.take(pa.array(at)), _PATTERNS["tag"], "")))
        bare = np.zeros(n, bool)
        bare[at] = rest < 0.6 * size[at]
        settle(bare, JUNK)
    menus = np.zeros(n, bool)
    at = np.flatnonzero(left & (pipes > 7))  # menus: cells that repeat, without a bar at the beginning
    for k, line in zip(at.tolist(), lines.take(pa.array(at)).to_pylist() if len(at) else []):
        cells = [c.strip() for c in line.strip().strip("|").split("|")]
        menus[k] = not line.lstrip().startswith("|") and len(cells) > 8 and len(set(cells)) < RULES["cells_distinct"] * len(cells)
    settle(menus, JUNK)
    settle(pipes > 1, TABLE)
    long_ = ends & (size > RULES["bullet_sentence"])
    bullets = left & is_["bullet"] & ~(long_ & ~among(is_["bullet"] & long_, "reference"))
    listed |= bullets
    settle(bullets, LIST)
    settle(among(ends & (words > 7), "log"), JUNK)
    settle(ends & (words > 7), TEXT)
    wide = left & (words > 7) & ~tabs & ~_numbers(pc.match_substring(lines, "  "))
    if wide.any():
        at = np.flatnonzero(wide)
        parts, row = _segments(pc.utf8_split_whitespace(pc.utf8_trim_whitespace(lines.take(pa.array(at)))))
        alpha = np.bincount(row, _numbers(pc.utf8_is_alpha(parts)), len(at))
        wide[at] = alpha > 0.7 * words[at]
    settle(wide, TEXT)
    settle(among(every, "dump"), JUNK)
    settle(among(every, "log"), JUNK)
    contents = among(every, "contents")
    listed |= contents
    settle(contents, LIST)
    amps = _numbers(pc.count_substring(lines, " & "))
    settle((amps > 1) | (amps > 0) & _numbers(pc.match_substring_regex(lines, r"\\\\\s*$")) | tabs, TABLE)
    for name in ("named", "columns", "separated"):
        settle(among(every, name), TABLE)
    settle(among(every, "index"), LIST)
    settle(among(every, "code"), JUNK)
    return kind, listed, ends


_FIELDS = [
    ("n_chars", pa.int64()), ("n_words", pa.int64()), ("n_lines", pa.int64()), ("mean_word_len", pa.float64()), ("symbol_ratio", pa.float64()),
    ("digit_ratio", pa.float64()), ("punct_line_share", pa.float64()), ("bullet_share", pa.float64()), ("common_share", pa.float64()),
    ("list_share", pa.float64()), ("table_share", pa.float64()), ("junk_share", pa.float64()), ("repeated_share", pa.float64()),
    ("odd_word_share", pa.float64()), ("entry_words", pa.float64()), ("ellipsis_share", pa.float64()), ("alphabetic_share", pa.float64()),
    ("repeated_line_share", pa.float64()), ("reasons", pa.list_(pa.string())), ("text_kind", pa.string()),
]

_EDGES = ".,;:!?()[]\"'«»“”"
#: The stop words of the published rule.
STOP_WORDS = frozenset("the be to of and that have with".split())
COMMON, PLAIN, ODD, SINGLE, STOP, ALPHA, ENGLISH = (1 << k for k in range(7))


@lru_cache(200_000)
def _word_bits(written: str) -> int:
    """What is known of a written word, as bits."""
    word = written.strip(_EDGES)
    bits = COMMON * (word in COMMON_WORDS) | STOP * (written[-1] in ".!?" and len(written) > 3) | SINGLE * (len(written) == 1 and written.isalpha())
    bits |= ALPHA * any(map(str.isalpha, written)) | ENGLISH * (word in STOP_WORDS)
    if word.isascii() and word.isalpha():
        bits |= PLAIN | ODD * bool(_ODD.search(word))
    return bits


#: Character classes of the first plane: 1 visible, 2 digit, 4 sign, 8 left by wrong decoding.
_CLASSES = np.array(
    [
        0 if chr(c).isspace() else 1 | 2 * chr(c).isdigit() | 4 * (c == 95 or not (chr(c).isalnum() or c == 0x0301)) | 8 * bool(_BROKEN.match(chr(c)))
        for c in range(0x10000)
    ],
    np.uint8,
)


def character_counts(texts: list[str]) -> np.ndarray:
    """For each text the visible characters, digits, signs and characters left by wrong decoding, counted over the whole batch at once."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "replace"), np.uint32)
    classes = _CLASSES[np.minimum(codes, 0xFFFF)]
    ends = np.cumsum([len(t) for t in texts])
    out = np.zeros((len(texts), 4), np.int64)
    for k, bit in enumerate((1, 2, 4, 8)):
        total = np.concatenate([[0], np.cumsum((classes & bit) > 0, dtype=np.int32)])
        out[:, k] = total[ends] - total[ends - [len(t) for t in texts]]
    return out


def _repeated(values: pa.Array, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """How many values each row has, and what share of them are copies of earlier ones of the row."""
    codes = _numbers(values.dictionary_encode().indices).astype(np.int64)
    n = np.bincount(row, minlength=rows)
    once = np.bincount(np.unique(row * (codes.max(initial=0) + 1) + codes) // (codes.max(initial=0) + 1), minlength=rows) if len(row) else n
    return n, 1 - once / np.maximum(1, n)


def measure(texts: list[str | None]) -> tuple[dict[str, np.ndarray], list[list[str]], list[str]]:
    """The statistics of a batch, by name, the reasons that fired for each text, and its kind."""
    texts = [t or "" for t in texts]
    rows = len(texts)
    if not rows:
        return {name: np.zeros(0, np.float64 if pa.types.is_floating(t) else np.int64) for name, t in _FIELDS[:-2]}, [], []
    source = pa.array(texts, pa.string())
    counts = character_counts(texts)
    visible = np.maximum(counts[:, 0], 1)
    words, word_row = _segments(pc.utf8_split_whitespace(pc.utf8_trim_whitespace(pc.utf8_lower(source))))
    kept = _numbers(pc.not_equal(words, "")) if len(words) else np.zeros(0, bool)
    words, word_row = words.filter(pa.array(kept, pa.bool_())), word_row[kept]
    coded = words.dictionary_encode()
    bits = np.array([_word_bits(w) for w in coded.dictionary.to_pylist()], np.int64)[_numbers(coded.indices)] if len(words) else np.zeros(0, np.int64)
    n_words = np.bincount(word_row, minlength=rows)
    n = np.maximum(n_words, 1)
    having = lambda bit: np.bincount(word_row, (bits & bit) > 0, rows)
    common, plain, odd, single, stop, alpha, english = (having(b) for b in (COMMON, PLAIN, ODD, SINGLE, STOP, ALPHA, ENGLISH))

    lines, line_row = _segments(pc.split_pattern(source, "\n"))
    kept = _numbers(pc.not_equal(pc.utf8_trim_whitespace(lines), ""))
    lines, line_row = lines.filter(pa.array(kept)), line_row[kept]
    kind, listed, ends = line_kinds(lines)
    sizes = _numbers(pc.utf8_length(lines))
    held = np.stack([np.bincount(line_row, sizes * (kind == k), rows) for k in range(4)])
    shares = held / np.maximum(1, held.sum(axis=0))
    n_lines = np.bincount(line_row, minlength=rows)
    per_line = lambda test: np.bincount(line_row, test, rows) / np.maximum(1, n_lines)
    closed = pc.utf8_rtrim_whitespace(lines)
    ended, bullet_lines, ellipsis = per_line(ends), per_line(listed & (kind == LIST)), per_line(_numbers(pc.ends_with(closed, "…")) | _numbers(pc.ends_with(closed, "...")))
    _, repeated_lines = _repeated(lines, line_row, rows)
    # words of the lines that are text
    loose, loose_common = n_words.astype(float), common.copy()
    mixed = np.flatnonzero(shares[TEXT] < 1)
    if len(mixed):
        at = np.flatnonzero((kind == TEXT) & np.isin(line_row, mixed))
        some, some_row = _segments(pc.utf8_split_whitespace(pc.utf8_trim_whitespace(pc.utf8_lower(lines.take(pa.array(at))))))
        again = some.dictionary_encode()
        is_common = np.array([bool(w) and w.strip(_EDGES) in COMMON_WORDS for w in again.dictionary.to_pylist()], bool)[_numbers(again.indices)] if len(some) else np.zeros(0, bool)
        owner = line_row[at][some_row]
        loose[mixed], loose_common[mixed] = np.bincount(owner, minlength=rows)[mixed], np.bincount(owner, is_common, rows)[mixed]

    parted = source
    for mark in (". ", "! ", "? "):
        parted = pc.replace_substring(parted, mark, "\n")
    sentences, sentence_row = _segments(pc.split_pattern(parted, "\n"))
    kept = _numbers(pc.not_equal(sentences, ""))
    n_sentences, repeated = _repeated(sentences.filter(pa.array(kept)), sentence_row[kept], rows)
    few_common = (loose >= RULES["common_words_from"]) & (loose_common / np.maximum(1, loose) < RULES["common_share"])
    entries = sum(_numbers(pc.count_substring(source, mark)).astype(np.int64) for mark in ";,·•|") + 1
    few = np.flatnonzero(few_common)
    if len(few):  # line ends part the entries of a list too
        entries[few] = _numbers(pc.count_substring_regex(source.take(pa.array(few)), r"[;,·•|\n]\s*")) + 1
    per_entry = n_words / entries
    is_listed = (per_entry <= RULES["entry_words"]) & (entries >= RULES["entries_from"])
    half, symbols = RULES["nonprose_share"], counts[:, 2] / visible
    odd_share, mean_word = odd / np.maximum(1, plain), counts[:, 0] / n
    texty = shares[TEXT] > half
    per_word = sum(_numbers(pc.count_substring(source, mark)) for mark in ("#", "…", "...")) / n
    limit = {k: v[0] for k, v in PUBLISHED.items()}
    published = {
        "few_words": n_words < limit["few_words"], "many_words": n_words > limit["many_words"], "short_mean_word": mean_word < limit["short_mean_word"], "long_mean_word": mean_word > limit["long_mean_word"],
        "symbols_per_word": per_word > limit["symbols_per_word"], "bullet_lines": bullet_lines > limit["bullet_lines"], "ellipsis_lines": ellipsis > limit["ellipsis_lines"], "alphabetic_words": alpha / n < limit["alphabetic_words"],
        "stop_words": english < limit["stop_words"], "repeated_lines": repeated_lines > limit["repeated_lines"], "unmarked_lines": ended <= limit["unmarked_lines"],
        "placeholder": _numbers(pc.match_substring(source, "{")) | _numbers(pc.match_substring(pc.utf8_lower(source), "lorem ipsum")),
    }
    largest = np.argmax(held[1:], axis=0) + 1
    rules = [
        ("wrongly_decoded", JUNK, counts[:, 3] / visible > RULES["broken_share"]),
        ("single_letters", JUNK, (n_words > 20) & (single / n > RULES["single_letter_share"])),
        ("mostly_dump_log_code_or_rules", JUNK, shares[JUNK] > half),
        ("repeated", JUNK, (repeated > RULES["repeated_share"]) & (n_sentences >= RULES["repeated_from"]) & texty),
        ("odd_words", JUNK, (odd_share > RULES["odd_word_share"]) & (plain >= 5) & texty),
        ("mostly_table_rows", TABLE, shares[TABLE] > half),
        ("mostly_list_lines", LIST, shares[LIST] > half),
        ("entries_without_sentences", LIST, is_listed & (stop * 12 < n_words) & texty & (few_common | (per_entry <= 4))),
        ("words_without_sentences", JUNK, few_common & (ended < half) & (stop * 20 < n_words)),
        ("mostly_symbols", JUNK, (symbols > RULES["symbol_share"]) & texty),
        ("mostly_not_text", largest, 1 - shares[TEXT] > half),
        *((name, None if PUBLISHED[name][1] is None else KINDS.index(PUBLISHED[name][1]), test) for name, test in published.items()),
    ]
    filled = n_words > 0
    reasons: list[list[str]] = [[] for _ in texts]
    decided = np.full(rows, -1)
    for name, as_, test in rules:
        hit = np.flatnonzero(test & filled)
        for i in hit.tolist():
            reasons[i].append(name)
        if as_ is not None:
            open_ = hit[decided[hit] < 0]
            decided[open_] = as_[open_] if isinstance(as_, np.ndarray) else as_
    kinds = ["empty" if not f else "prose" if d < 0 else KINDS[d] for f, d in zip(filled.tolist(), decided.tolist())]
    stats = {
        "n_chars": _numbers(pc.utf8_length(source)).astype(np.int64), "n_words": n_words.astype(np.int64), "n_lines": n_lines.astype(np.int64), "mean_word_len": mean_word, "symbol_ratio": symbols, "digit_ratio": counts[:, 1] / visible,
        "punct_line_share": ended, "bullet_share": bullet_lines, "common_share": common / n, "list_share": shares[LIST], "table_share": shares[TABLE], "junk_share": shares[JUNK], "repeated_share": repeated,
        "odd_word_share": odd_share, "entry_words": per_entry, "ellipsis_share": ellipsis, "alphabetic_share": alpha / n, "repeated_line_share": repeated_lines,
    }
    blank = ~filled
    for name, values in stats.items():
        if name != "n_chars":
            values[blank] = 0
    return stats, reasons, kinds


def text_statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of statistics for each document, then the reasons that fired and ``text_kind``.

    ``text_kind`` is prose, list, table, junk, or empty for a null or blank text, whose statistics are 0. Whole texts are
    read. Repeated rows are judged each; null ids are kept; other columns are dropped, whatever their names.
    """
    source = df.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    id_type = source.schema["_id"].dataType.simpleString()
    names = [n for n, _ in _FIELDS]
    ddl = {pa.int64(): "bigint", pa.float64(): "double", pa.string(): "string"}
    schema = f"_id {id_type}, " + ", ".join(f"{n} {ddl.get(t, 'array<string>')}" for n, t in _FIELDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.cumsum(_numbers(pc.fill_null(pc.binary_length(batch.column(1)), 0)), dtype=np.int64)
            cuts = [0, *(np.flatnonzero(np.diff(size // BATCH_BYTES)) + 1).tolist(), batch.num_rows]  # long texts are worked by few at once
            for first, last in zip(cuts, cuts[1:]):
                part = batch.slice(first, last - first)
                stats, reasons, kinds = measure(part.column(1).to_pylist())
                arrays = [*(pa.array(stats[n], t) for n, t in _FIELDS[:-2]), pa.array(reasons, pa.list_(pa.string())), pa.array(kinds, pa.string())]
                yield pa.RecordBatch.from_arrays([part.column(0), *arrays], names=["_id", *names])

    return source.mapInArrow(run, schema).withColumnRenamed("_id", id_col)


def nonprose(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, text_kind)`` of every document most of whose text is a list, a table or junk."""
    return text_statistics(df, id_col, text_col).where(F.col("text_kind").isin("list", "table", "junk")).select(id_col, "text_kind")
