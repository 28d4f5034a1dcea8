"""Texts by their share of common character pairs or letters: exact, by matrix products of blocks.

Every text is a row of counts over a few hundred columns: frequent character pairs have
a column of their own, the others share some.  The product of two rows is at least the
number of their common pairs, so all that reach the share pass it, and the few that pass
are counted exactly.  So it is with letters, where matching blocks are sought.  Texts are never joined pair by pair: a block of two parts is one
task, and only its result leaves it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lodestrata.functions.matching_blocks import best_ratios

#: Columns of the product, rows of one product, character pairs with a bit of their own, pairs counted at once.
COLUMNS, TILE, BITS, CHUNK = 256, 2048, 1 << 14, 1 << 13


def _letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Every code point of the texts and the text that it is of."""
    length = np.fromiter(map(len, texts), np.int64, len(texts))
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64), np.repeat(np.arange(len(texts)), length)


def character_pairs(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """``(row, mark)``: the distinct character pairs of texts of at least two characters."""
    codes, row = _letters(texts)
    within = row[1:] == row[:-1]
    _, pair = np.unique((codes[:-1] << 21 | codes[1:])[within], return_inverse=True)
    kinds = int(pair.max()) + 1
    both = np.sort(row[1:][within] * kinds + pair)
    both = both[np.concatenate(([True], both[1:] != both[:-1]))]  # np.unique takes many times as long
    return both // kinds, both % kinds


def letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """``(row, mark)``: the letters of each text, the second of a kind another mark than the first, so that marks in common count letters."""
    codes, row = _letters(texts)
    key = np.sort(row << 21 | codes)
    at = np.arange(len(key))
    new = np.concatenate(([True], key[1:] != key[:-1]))
    which = at - np.maximum.accumulate(np.where(new, at, 0))
    _, mark = np.unique((key & (1 << 21) - 1) << 32 | which, return_inverse=True)
    return key >> 21, mark


class PairTexts:
    """The marks of texts, character pairs or letters, by rows in a given order."""

    def __init__(self, texts: list[str], order=None, marks=character_pairs, columns: int = COLUMNS, bits: int = BITS):
        row, pair = marks(texts)
        kinds = int(pair.max()) + 1
        seen = np.bincount(pair)
        rank = np.empty(kinds, np.int64)
        rank[np.argsort(-seen, kind="stable")] = np.arange(kinds)
        pair, seen = rank[pair], np.sort(seen)[::-1]
        n = np.bincount(row, minlength=len(texts))
        #: Position of each row in ``texts``, by number of marks or as given.
        self.order = np.argsort(n, kind="stable") if order is None else order(n)
        place = np.empty_like(self.order)
        place[self.order] = np.arange(len(texts))
        self.n, row = n[self.order], place[row]
        own = columns // 2
        self.counts = np.zeros((len(texts), columns), np.float32)
        np.add.at(self.counts, (row, np.where(pair < own, pair, own + pair % (columns - own))), 1)
        # what one text alone has is never common; the most frequent have a bit, the others are looked up
        common = seen[pair] > 1
        row, pair = row[common], pair[common]
        self.bits = np.zeros((len(texts), -(-min(kinds, bits) // 64)), np.uint64)
        some = pair < bits
        np.bitwise_or.at(self.bits, (row[some], pair[some] >> 6), np.uint64(1) << (pair[some] & 63).astype(np.uint64))
        self.kinds, self.rest = kinds, np.sort(row[~some] * kinds + pair[~some])
        self.starts = np.searchsorted(self.rest, np.arange(len(texts) + 1) * kinds)

    def common(self, r: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Number of common marks of rows ``r`` and ``c``."""
        out = np.empty(len(r), np.int64)
        for at in range(0, len(r), CHUNK):
            part = slice(at, at + CHUNK)
            out[part] = np.bitwise_count(self.bits[r[part]] & self.bits[c[part]]).sum(1, dtype=np.int64)
        if len(self.rest):
            many = self.starts[r + 1] - self.starts[r]
            which = np.repeat(np.arange(len(r)), many)
            key = self.rest[self.starts[r][which] + np.arange(len(which)) - np.repeat(many.cumsum() - many, many)]
            key = key % self.kinds + c[which] * self.kinds
            found = self.rest[np.minimum(np.searchsorted(self.rest, key), len(self.rest) - 1)] == key
            out += np.bincount(which[found], minlength=len(r))
        return out

    def tiles(self, left: np.ndarray | None, share: float, skip=None, tile: int = TILE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Candidates ``(r, c)``, a tile at a time: rows with ``left`` against the others, without it all against all, once each.

        Candidates may have ``share`` of the sum of their marks in common.  A tile whose
        numbers of marks are too far apart, or that ``skip`` names, is not multiplied.
        """
        inner = left is None
        x, y = (np.arange(len(self.n)),) * 2 if inner else (np.flatnonzero(left), np.flatnonzero(~left))
        least = share / (1 - share)
        slack = 0.01 + 1e-5 * float(self.n.max())
        end = lambda rows, own: np.column_stack((self.counts[rows], *((-share * self.n[rows], np.ones(len(rows))) if own else (np.ones(len(rows)), -share * self.n[rows])))).astype(np.float32)
        ends = [end(y[j : j + tile], False).T for j in range(0, len(y), tile)]
        for i in range(0, len(x), tile):
            a, own = x[i : i + tile], None
            for k, j in enumerate(range(0, min(i + tile, len(y)) if inner else len(y), tile)):
                b = y[j : j + tile]
                na, nb = self.n[a], self.n[b]
                if nb.max() < least * na.min() - 1e-6 or na.max() < least * nb.min() - 1e-6 or (skip and skip(a, b)):
                    continue
                own = end(a, True) if own is None else own
                r, c = np.divmod(np.flatnonzero(own @ ends[k] >= -slack), len(b))
                r, c = a[r], b[c]
                if inner:
                    r, c = r[r > c], c[r > c]
                if len(r):
                    yield r, c

    def near(self, r: np.ndarray, c: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Those of the candidates that reach the share, with it."""
        both = self.common(r, c)
        s = both / (self.n[r] + self.n[c] - both)
        good = s >= least
        return r[good], c[good], s[good]


def left_part(block: pa.Table, texts: PairTexts) -> np.ndarray | None:
    """Which rows are of part ``i``; None if the block is a part with itself."""
    i = block["i"][0].as_py()
    return None if i == block["j"][0].as_py() else block["p"].to_numpy()[texts.order] == i


def near_pairs(batches: Iterator[pa.RecordBatch], least: float, **sizes: int) -> Iterator[pa.RecordBatch]:
    """``(a, b, s)`` of one block of rows ``id, t, p, i, j``: part ``i`` against part ``j``, ``a`` smaller than ``b``."""
    block = pa.Table.from_batches(list(batches))
    texts = PairTexts(block["t"].to_pylist(), **sizes)
    found = (texts.near(r, c, least) for r, c in texts.tiles(left_part(block, texts), least / (1 + least)))
    yield from _rows(block, texts, found)


def near_sequences(batches: Iterator[pa.RecordBatch], least: float, **sizes: int) -> Iterator[pa.RecordBatch]:
    """As :func:`near_pairs`, with the ratio of matching blocks in the better order of two texts.

    A ratio of ``m`` letters needs as many in common, wherever they stand.
    """
    block = pa.Table.from_batches(list(batches))
    plain = block["t"].to_pylist()
    texts = PairTexts(plain, marks=letters, **sizes)
    plain = [plain[x] for x in texts.order]

    def found() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for r, c in texts.tiles(left_part(block, texts), least / 2):
            some = 2 * texts.common(r, c) >= least * (texts.n[r] + texts.n[c]) - 1e-9
            r, c = r[some], c[some]
            s = best_ratios(plain, r, c, least)
            yield r[s >= least], c[s >= least], s[s >= least]

    yield from _rows(block, texts, found())


def _rows(block: pa.Table, texts: PairTexts, found: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    ids = block["id"].combine_chunks().take(pa.array(texts.order))
    rank = np.empty(len(ids), np.int64)
    rank[pc.array_sort_indices(ids).to_numpy()] = np.arange(len(ids))
    first = block["id"].combine_chunks().dictionary_encode().indices.to_numpy()[texts.order]
    for r, c, s in found:
        other = first[r] != first[c]
        r, c, s = r[other], c[other], s[other]
        a, b = np.where(rank[r] < rank[c], r, c), np.where(rank[r] < rank[c], c, r)
        for at in range(0, len(a), CHUNK):
            part = slice(at, at + CHUNK)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(a[part])), ids.take(pa.array(b[part])), pa.array(s[part])], ["a", "b", "s"])


class Forest:
    """Labels of rows, from 0 below ``kinds``; rows that are united get the smallest of theirs."""

    def __init__(self, labels: np.ndarray, kinds: int):
        self.label, self.up = labels, np.arange(kinds)

    def unite(self, u: np.ndarray, v: np.ndarray) -> None:
        while len(u):
            a, b = self.label[u], self.label[v]
            apart = a != b
            u, v, a, b = u[apart], v[apart], a[apart], b[apart]
            np.minimum.at(self.up, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(self.up, above := self.up[self.up]):
                self.up = above
            self.label = self.up[self.label]

    def one(self, *rows: np.ndarray) -> bool:
        """Whether all rows have one label."""
        return all((self.label[x] == self.label[rows[0][0]]).all() for x in rows)


def grouped(batches: Iterator[pa.RecordBatch], least: float, large: int = TILE // 4, **sizes: int) -> Iterator[pa.RecordBatch]:
    """The rows of a block with ``top``, one id for all that a chain of pairs links.

    Rows of a part with itself begin alone, and come out with the smallest such id.  Of
    two parts, rows begin with the ``top`` they have, and each ``top`` that is united with
    another comes out as ``(id, top)``.  Pairs whose rows are linked already are not
    counted, tiles of rows that all are linked not multiplied.
    """
    block = pa.Table.from_batches(list(batches))
    inner = block["i"][0].as_py() == block["j"][0].as_py()
    tops = block["id" if inner else "top"].combine_chunks()
    names = pc.unique(tops)
    names = names.take(pc.array_sort_indices(names))
    begin = pc.index_in(tops, names).to_numpy().astype(np.int64)
    size = np.bincount(begin)[begin]
    big = size >= large
    texts = PairTexts(block["t"].to_pylist(), lambda n: np.lexsort((n, np.where(big, begin, 0), np.where(big, -size, 0))), **sizes)
    forest = Forest(begin[texts.order], len(names))
    for r, c in texts.tiles(left_part(block, texts), least / (1 + least), forest.one):
        apart = forest.label[r] != forest.label[c]
        r, c = r[apart], c[apart]
        for at in range(0, len(r), CHUNK):
            part = slice(at, at + CHUNK)
            a, b = r[part], c[part]
            apart = forest.label[a] != forest.label[b]
            forest.unite(*texts.near(a[apart], b[apart], least)[:2])
    if inner:
        yield from block.append_column("top", names.take(pa.array(forest.up[begin]))).drop_columns(["i", "j"]).combine_chunks().to_batches()
    else:
        moved = np.flatnonzero(forest.up != np.arange(len(names)))
        yield pa.RecordBatch.from_arrays([names.take(pa.array(moved)), names.take(pa.array(forest.up[moved]))], ["id", "top"])
