"""Licence scans with ordered signature rules.

Each text is lower-cased (A-Z), cut into words and joined again by single spaces.  One Aho-Corasick pass over the
joined words finds the keywords that occur; only the rules of those keywords run.  Detections are word intervals.
They are accepted in the order of priority, length and rule number, and a detection contained in an accepted one
is suppressed.  So "apache license version 2 0" reports the version and not the bare name as well.

The work is one pass over the texts without any shuffle; memory holds one Arrow batch.

Edge cases: null and empty texts have no words, no places, empty labels and score 0; very long texts are scanned whole;
detections of equal priority and length are taken in the order of the rules, then of the text; a null id stays null;
repeated rows are scanned each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import functools
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from hornfels.llm.common import texts
from hornfels.llm.license_rules import BASE, RULES

SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
SPANS = "doc_id long, label string, priority int, first_word long, n_words long"
_TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 0x80 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


@functools.cache
def _automaton():
    by_keyword: dict[str, list[int]] = {}
    for number, rule in enumerate(RULES):
        by_keyword.setdefault(rule.keyword, []).append(number)
    out = ahocorasick.Automaton()
    for keyword, numbers in by_keyword.items():
        out.add_word(keyword, numbers)
    for label, phrase in BASE:
        out.add_word(f" {phrase} ", [-1 - [p for _, p in BASE].index(phrase)])
    out.make_automaton()
    return out


def detections(joined: str) -> tuple[list[tuple[str, int]], list[tuple[int, int, int]]]:
    """Base places (label, first word) and accepted detections (first word, end, rule) of space-joined words."""
    padded = f" {joined} "
    rules: set[int] = set()
    base: list[tuple[str, int]] = []
    word, at = 0, 1  # number of the word that starts at this position
    for end, numbers in _automaton().iter(padded):
        if numbers[0] >= 0:
            rules.update(numbers)
        else:
            label, phrase = BASE[-1 - numbers[0]]
            start = end - len(phrase)
            word, at = word + padded.count(" ", at, start), start
            base.append((label, word))
    found = []
    for number in rules:
        word, at = 0, 0
        for m in RULES[number].pattern.finditer(joined):
            word, at = word + joined.count(" ", at, m.start()), m.start()
            found.append((word, word + m.group().count(" ") + 1, number))
    accepted: list[tuple[int, int, int]] = []
    cover: list[tuple[int, int]] = []
    for start, end, number in sorted(found, key=lambda f: (-RULES[f[2]].priority, f[0] - f[1], f[2], f[0])):
        if not _contained(cover, start, end):
            accepted.append((start, end, number))
            _add(cover, start, end)
    return base, accepted


def _contained(cover: list[tuple[int, int]], start: int, end: int) -> bool:
    k = bisect.bisect_right(cover, (start, float("inf")))
    return k > 0 and cover[k - 1][1] >= end


def _add(cover: list[tuple[int, int]], start: int, end: int) -> None:
    """Keep the intervals that no other contains, by start; their ends then ascend too."""
    k = bisect.bisect_left(cover, (start, end))
    while k < len(cover) and cover[k][1] <= end:
        del cover[k]
    cover.insert(k, (start, end))


def scan_text(text: bytes) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score, accepted)"""
    words = text.translate(_TO_WORDS).split()
    base, accepted = detections(b" ".join(words).decode("utf-8", "replace"))
    starts = [w for _, w in base]
    names = {label for label, _ in base}
    score = max((RULES[r].priority for _, _, r in accepted), default=0) / 100.0
    if base:
        score = max(score, 0.5)
    labels = names | {RULES[r].label for _, _, r in accepted}
    return len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(names)), ",".join(sorted(labels)), score, accepted


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64()]
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    for batch in batches:
        rows = [scan_text(t)[:7] for t in texts(batch.column(1))]
        columns = list(zip(*rows)) or [()] * 7
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *[pa.array(c, t) for c, t in zip(columns, types[1:])]], names)


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(d, RULES[r].label, RULES[r].priority, s, e - s) for d, t in zip(batch.column(0).to_pylist(), texts(batch.column(1))) for s, e, r in sorted(scan_text(t)[7])]
        columns = list(zip(*rows)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64()])], ["doc_id", "label", "priority", "first_word", "n_words"])


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: counts, first and last base place, labels and the score of the best detection."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(_scan, SCHEMA)


def license_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each accepted detection, with its place in words."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(_spans, SPANS)
