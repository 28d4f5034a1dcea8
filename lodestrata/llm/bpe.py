"""Encoding of a corpus with a public byte-level BPE tokenizer (problem 8).

Merging works in batched numpy rounds: the symbols of many words lie in one flat
array, and the rank of every pair comes from a binary search over the sorted
pair keys.  A round merges the lowest-ranked pair of each word at once.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: the pattern that splits text before the merges of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NO_RANK = np.int32(2**31 - 1)
#: Characters handled at a time, and symbols kept of known words, per Python worker.
BATCH_CHARS, POOL_SYMBOLS = 1_000_000, 4_000_000


@dataclass
class Merges:
    """Tables of a vocabulary; their size is that of the vocabulary, whatever the data."""

    byte_ids: np.ndarray  # id of each single byte
    keys: np.ndarray  # sorted left * size + right
    ranks: np.ndarray  # rank of each key
    made: np.ndarray  # id made by the merge of each rank
    size: int
    twos: np.ndarray  # sorted two-byte strings that are a whole symbol
    threes: np.ndarray  # sorted three-byte strings inside any symbol


def _alphabet() -> dict[str, int]:
    """Character -> byte of the printable form in which the vocabulary file spells bytes."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def load_merges(path: str) -> Merges:
    """Read a ``byte_bpe`` vocabulary file (JSON with vocab and merges)."""
    model = json.loads(Path(path).read_text(encoding="utf-8"))["model"]
    vocab, spelled = model["vocab"], _alphabet()
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    left = np.array([vocab[a] for a, _ in pairs], np.int64)
    right = np.array([vocab[b] for _, b in pairs], np.int64)
    made = np.array([vocab[a + b] for a, b in pairs], np.int32)
    size = max(vocab.values()) + 1
    keys = left * size + right
    order = np.argsort(keys)
    byte_ids = np.zeros(256, np.int32)
    for char, byte in spelled.items():
        byte_ids[byte] = vocab[char]
    twos, threes = set(), set()
    for a, b in pairs:
        raw = bytes(spelled[c] for c in a + b)
        if len(raw) == 2:
            twos.add(raw[0] << 8 | raw[1])
        threes.update(raw[i] << 16 | raw[i + 1] << 8 | raw[i + 2] for i in range(len(raw) - 2))
    sort = lambda x: np.array(sorted(x), np.int32)
    return Merges(byte_ids, keys[order], order.astype(np.int32), made, size, sort(twos), sort(threes))


def _within(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    at = np.searchsorted(table, values)
    at[at == len(table)] = 0
    return table[at] == values


def _pair_ranks(m: Merges, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    key = left.astype(np.int64) * m.size + right
    at = np.searchsorted(m.keys, key)
    at[at == len(m.keys)] = 0
    return np.where(m.keys[at] == key, m.ranks[at], NO_RANK)


def merge_rounds(m: Merges, raw: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of words given as joined bytes: ``(flat ids, ids per word)``.

    Each round looks up only pairs that a merge of the round before has changed;
    words without a pair left leave the arrays.
    """
    n = len(lengths)
    count = np.zeros(n, np.int64)
    finished: list[tuple[np.ndarray, np.ndarray]] = []
    word = np.repeat(np.arange(n), lengths)
    sym = m.byte_ids[raw]
    rank = np.full(len(sym), NO_RANK, np.int32)
    if len(sym) > 1:
        rank[:-1] = np.where(word[1:] == word[:-1], _pair_ranks(m, sym[:-1], sym[1:]), NO_RANK)
    while len(sym):
        first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        span = np.diff(np.r_[first, len(sym)])
        best = np.repeat(np.minimum.reduceat(rank, first), span)
        over = best == NO_RANK
        if over.any():
            finished.append((word[over], sym[over]))
            keep = ~over
            word, sym, rank, best = word[keep], sym[keep], rank[keep], best[keep]
            if not len(sym):
                break
        hit = rank == best
        # of overlapping hits (one symbol repeated) every second one merges, from the left
        at = np.flatnonzero(hit)
        run = np.r_[True, np.diff(at) != 1]
        offset = np.arange(len(at)) - np.flatnonzero(run)[np.cumsum(run) - 1]
        at = at[offset % 2 == 0]
        sym[at] = m.made[rank[at]]
        keep = np.ones(len(sym), bool)
        keep[at + 1] = False
        now = at - np.arange(len(at))  # where the merged symbols lie after the removal
        word, sym, rank = word[keep], sym[keep], rank[keep]
        near = np.unique(np.r_[now, now[now > 0] - 1])
        inner = near[near < len(sym) - 1]
        rank[near] = NO_RANK
        same = inner[word[inner] == word[inner + 1]]
        rank[same] = _pair_ranks(m, sym[same], sym[same + 1])
    if not finished:
        return np.zeros(0, np.int32), count
    where = np.concatenate([w for w, _ in finished])
    ids = np.concatenate([s for _, s in finished])
    return ids[np.argsort(where, kind="stable")].astype(np.int32), np.bincount(where, minlength=n)


def gather(pool: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The pieces ``pool[start : start + length]``, joined."""
    total = int(length.sum())
    before = np.cumsum(length) - length
    return pool[np.repeat(start - before, length) + np.arange(total)]


class Encoder:
    """Encodes batches of texts; words met before are looked up, up to a bounded number of symbols."""

    def __init__(self, merges: Merges, pattern: str = PATTERN):
        self.m = merges
        self.split = regex.compile(pattern).findall
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.start = self.length = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.int32)

    def _learn(self, words: list[str]) -> None:
        """Encode new words.

        Long runs of letters, as in scripts without blanks, are first cut where no
        symbol of the vocabulary reaches across: a crossing symbol would be one of
        its two-byte symbols or hold one of its three-byte strings.  No merge crosses
        such a place, so the parts can be merged, and found again, on their own.
        """
        coded = [w.encode("utf-8", "replace") for w in words]
        raw = np.frombuffer(b"".join(coded), np.uint8)
        ends = np.cumsum(np.fromiter(map(len, coded), np.int64, len(coded)))
        v = raw.astype(np.int32)
        across = np.zeros(len(v) + 1, bool)  # across[i]: a symbol may reach over the border before byte i
        if len(v) > 1:
            across[1:-1] = _within(v[:-1] << 8 | v[1:], self.m.twos)
        if len(v) > 2:
            three = _within(v[:-2] << 16 | v[1:-1] << 8 | v[2:], self.m.threes)
            across[1:-2] |= three
            across[2:-1] |= three
        across[ends] = False
        cut = np.flatnonzero(~across[1:]) + 1
        text = raw.tobytes()
        parts = [text[a:b] for a, b in zip([0, *cut[:-1].tolist()], cut.tolist())]
        distinct = {p: i for i, p in enumerate(dict.fromkeys(parts))}
        which = np.fromiter(map(distinct.__getitem__, parts), np.int64, len(parts))
        sizes = np.fromiter(map(len, distinct), np.int64, len(distinct))
        ids, count = merge_rounds(self.m, np.frombuffer(b"".join(distinct), np.uint8), sizes)
        begin = np.cumsum(count) - count
        flat = gather(ids, begin[which], count[which])
        per_part = np.r_[0, np.cumsum(count[which])]
        last = per_part[np.searchsorted(cut, ends) + 1]
        length = np.diff(np.r_[0, last])
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words))))
        self.start = np.r_[self.start, last - length + len(self.pool)]
        self.length = np.r_[self.length, length]
        self.pool = np.r_[self.pool, flat]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts and the number of ids per text; null and empty have none."""
        flats, counts, group, chars = [], [], [], 0
        for text in texts:
            group.append(text or "")
            chars += len(group[-1])
            if chars >= BATCH_CHARS:
                self._encode(group, flats, counts)
                group, chars = [], 0
        self._encode(group, flats, counts)
        return np.concatenate(flats), np.concatenate(counts)

    def _encode(self, texts: list[str], flats: list, counts: list) -> None:
        words: list[str] = []
        bounds = [0]
        for text in texts:
            words += self.split(text)
            bounds.append(len(words))
        if len(self.pool) > POOL_SYMBOLS:
            self._forget()
        new = [w for w in dict.fromkeys(words) if w not in self.known]
        if new:
            self._learn(new)
        which = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        length = self.length[which]
        flats.append(gather(self.pool, self.start[which], length))
        counts.append(np.diff(np.r_[0, np.cumsum(length)][np.array(bounds)]))


@lru_cache(maxsize=2)
def default_vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Where the vocabulary file of the public tokenizers lies."""
    try:
        import public_tokenizers

        return public_tokenizers.path(name)
    except ImportError:
        return f"/opt/tokenizers/{name}"


def _batches(broadcast, column: str, key: list[str], lengths_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(broadcast.value)
        for batch in batches:
            text = batch.column(batch.schema.get_field_index(column))
            # a slice at a time, so that very long texts do not pile up as Python objects
            step = max(1, int(len(text) * BATCH_CHARS * 4 / max(1, text.nbytes)))
            for lo in range(0, len(text), step):
                part = batch.slice(lo, step)
                values = text.slice(lo, step).to_pylist()
                ids, count = encoder.encode(values)
                null = np.array([v is None for v in values], bool)
                if lengths_only:
                    result = pa.array(count.astype(np.int32), mask=null)
                else:
                    offsets = np.r_[0, np.cumsum(count)].astype(np.int32)
                    result = pa.ListArray.from_arrays(pa.array(offsets, mask=np.r_[null, False]), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(k)) for k in key] + [result], [*key, "ids"])

    return run


def _apply(documents: DataFrame, text: str, key: list[str], vocabulary: str | None, lengths_only: bool) -> DataFrame:
    spark = documents.sparkSession
    tables = spark.sparkContext.broadcast(load_merges(vocabulary or default_vocabulary()))  # size of the vocabulary
    kind = T.IntegerType() if lengths_only else T.ArrayType(T.IntegerType())
    schema = T.StructType([*(documents.schema[k] for k in key), T.StructField("ids", kind)])
    slim = documents.select(*key, F.col(text).alias("_text"))
    return slim.mapInArrow(_batches(tables, "_text", key, lengths_only), schema)


def encode_documents(documents: DataFrame, text: str = "text", key: tuple[str, ...] = ("doc_id",), vocabulary: str | None = None) -> DataFrame:
    """``key..., ids`` of every row: the token ids of its whole text, no special tokens.

    Empty text gives an empty list, null text gives null; the strings of special
    tokens are ordinary text.  Rows are encoded where they lie, without a shuffle;
    repeated rows stay repeated, other columns are not read.
    """
    return _apply(documents, text, list(key), vocabulary, False)


def count_tokens(documents: DataFrame, text: str = "text", key: tuple[str, ...] = ("doc_id",), vocabulary: str | None = None) -> DataFrame:
    """``key..., n_tokens``: the lengths of the lists of :func:`encode_documents`; null for null text."""
    return _apply(documents, text, list(key), vocabulary, True).withColumnRenamed("ids", "n_tokens")
