"""Sentence boundaries across languages and scripts (problem 10)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.llm.sentence_rules import BREAK, CLOSING, MARKS, Quotation, cascade

_BLANK_LINE = regex.compile(r"\r?\n[^\S\n]*(?:\n[^\S\n]*)+")
_LINE = regex.compile(r"[^\r\n]+")
_ITEM = regex.compile(r"[^\S\n]*(?:[-*•·–—▪◦‣]|\d{1,3}[.)、]|[（(]\d{1,3}[）)]|[a-z]\))[^\S\n]+")
#: a run of marks with what closes after it; a full stop before a digit or small letter is inside a number or name
_MARKED = rf"(?P<m>(?:[{MARKS.replace('.', '')}]|\.(?![0-9a-z]))+)(?P<c>(?:[{CLOSING}]|[   ]»)*)"
_CANDIDATE = regex.compile(_MARKED)
#: Thai: also a blank between two Thai words
_THAI = regex.compile("[ก-๛]")
_CANDIDATE_THAI = regex.compile(_MARKED + "|(?<=[ก-๛]\u200b?)(?P<t>\\s++)(?=\u200b?[ก-๛])")
_NOT_BLANK = regex.compile(r"\s*")
_WINDOW = 40


class Segmenter:
    """Cuts texts into sentence units; positions count code points."""

    def __init__(self):
        self.cascades: dict[str, dict] = {}

    def rules(self, language: str | None) -> dict:
        key = (language or "").strip().lower()[:2]
        if key not in self.cascades:
            self.cascades[key] = cascade(key)
        return self.cascades[key]

    def units(self, text: str | None, language: str | None = None) -> list[tuple[int, int]]:
        """``(start, end)`` of every unit, white space around it left out."""
        if not text or text.isspace():
            return []
        rules = self.rules(language)
        candidates = _CANDIDATE_THAI if _THAI.search(text) else _CANDIDATE
        out: list[tuple[int, int]] = []
        at = 0
        for gap in [*_BLANK_LINE.finditer(text), None]:
            end = gap.start() if gap else len(text)
            self._paragraph(text, at, end, rules, candidates, out)
            at = gap.end() if gap else end
        return out

    def _paragraph(self, text: str, lo: int, hi: int, rules: dict, candidates: regex.Pattern, out: list) -> None:
        """List items at the top of a paragraph are units; the rest is running text."""
        while lo < hi:
            line = _LINE.search(text, lo, hi)
            if not line:
                return
            if line.group().isspace():
                lo = line.end()
                continue
            if not _ITEM.match(text, line.start(), line.end()):
                break
            _add(text, line.start(), line.end(), out)
            lo = line.end()
        self._running(text, lo, hi, rules, candidates, out)

    def _running(self, text: str, lo: int, hi: int, rules: dict, candidates: regex.Pattern, out: list) -> None:
        open_ = Opening(text, lo)
        thai = candidates is _CANDIDATE_THAI
        for m in candidates.finditer(text, lo, hi):
            if thai and m.group("t"):
                _add(text, open_.start, m.start(), out)
                open_ = Opening(text, m.end())
                continue
            mark, end = text[m.end("m") - 1], m.end()
            if end == hi:
                break
            if text[end] == "“" and open_.low_quote(end):
                end += 1  # closes „
                if end == hi:
                    break
            elif m.group("c") == '"' and open_.straight_quotes(end) % 2:
                end -= 1  # a straight quote that opens the next sentence
            if mark == "." and end == m.end() and text[end].isalnum() and not (text[end].isupper() or text[end] > "⺀"):
                continue  # inside a number, a name or an abbreviation
            if _decide(rules[mark], text, open_, max(open_.start, m.start() - _WINDOW), end, hi):
                _add(text, open_.start, end, out)
                open_ = Opening(text, end)
        _add(text, open_.start, hi, out)


class Opening:
    """What is known of the sentence that is open; every sign of it is read once, however many marks it holds."""

    __slots__ = ("text", "start", "first", "counted", "quotes", "searched", "low", "high", "closed")

    def __init__(self, text: str, start: int):
        self.text, self.start = text, start
        self.first = self.closed = None
        self.counted, self.quotes = start, 0
        self.searched, self.low, self.high = start, -1, -1

    def straight_quotes(self, end: int) -> int:
        self.quotes += self.text.count('"', self.counted, end)
        self.counted = end
        return self.quotes

    def low_quote(self, end: int) -> bool:
        """Whether a „ is open."""
        self.low = max(self.low, self.text.rfind("„", self.searched, end))
        self.high = max(self.high, self.text.rfind("“", self.searched, end))
        self.searched = end
        return self.low > self.high

    def quotation(self, q: Quotation, end: int) -> bool:
        """Whether the sentence opens with a quotation whose closing mark stands before ``end``."""
        if self.text[end - 1] not in q.closing:
            return False
        if self.first is None:
            self.first = _NOT_BLANK.match(self.text, self.start).end()
        if self.first >= end - 1 or self.text[self.first] not in q.opening:
            return False
        if not q.whole:
            return True
        if self.closed is None:
            self.closed = min((at for c in q.closing if (at := self.text.find(c, self.first + 1, end)) >= 0), default=end - 1)
        return self.closed == end - 1


def _decide(groups: list, text: str, open_: Opening, near: int, end: int, hi: int) -> bool:
    """The verdict of the first rule that matches at ``end``."""
    for group in groups:
        if group.gate is not None and not group.gate.match(text, near, end):
            continue
        for rule in group.rules:
            if rule.opened is not None and not open_.quotation(rule.opened, end):
                continue
            if rule.before is not None and not rule.before.match(text, near, end):
                continue
            if rule.after is None or rule.after.match(text, end, hi):
                return rule.verdict is BREAK
    return False


def _add(text: str, lo: int, hi: int, out: list) -> None:
    while lo < hi and text[lo].isspace():
        lo += 1
    while lo < hi and text[hi - 1].isspace():
        hi -= 1
    if lo < hi:
        out.append((lo, hi))


def _batches(key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segmenter = Segmenter()
        for batch in batches:
            step = max(1, int(len(batch) * 4_000_000 / max(1, batch.nbytes)))
            for lo in range(0, len(batch), step):
                part = batch.slice(lo, step)
                found = [segmenter.units(t, g) for t, g in zip(part.column(1).to_pylist(), part.column(2).to_pylist())]
                counts = np.fromiter(map(len, found), np.int64, len(found))
                flat = np.array([p for units in found for p in units], np.int32).reshape(-1, 2)
                ids = part.column(0).take(pa.array(np.repeat(np.arange(len(found)), counts)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(flat[:, 0]), pa.array(flat[:, 1])], [key, "start_pos", "end_pos"])

    return run


def split_sentences(documents: DataFrame, key: str = "doc_id", text: str = "text", language: str = "lang") -> DataFrame:
    """``key, start_pos, end_pos``: one row per sentence unit of every document.

    A run of sentence marks, with the closing quotes and brackets after it, is a
    candidate; ordered break and no-break rules decide it, the first match counts.
    Blank lines always end a unit, list items are units, a single line break is
    white space, and between two Thai words a blank ends a sentence.  Null, empty
    and blank texts have no rows; repeated rows give repeated results; an unknown or
    null language is cut by the tables of all languages.  Documents are cut where
    they lie, without a shuffle, each as a whole.
    """
    schema = T.StructType([documents.schema[key], T.StructField("start_pos", T.IntegerType()), T.StructField("end_pos", T.IntegerType())])
    slim = documents.where(F.col(text).isNotNull()).select(F.col(key), F.col(text).alias("_t"), F.col(language).alias("_l"))
    return slim.mapInArrow(_batches(key), schema)
