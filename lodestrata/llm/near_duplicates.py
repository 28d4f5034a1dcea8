"""Near-duplicate records with small edits (problem 7): LSH forest over character stretches."""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.operators.components import both_ways, minimum_labels
from lodestrata.session import Workspace

#: Characters of a stretch.
STRETCH = 5
#: Trees of the forest; a label has LEVELS values of BITS bits, a pair of similarity s shares d of them with chance s**d.
TREES, LEVELS, BITS = 14, 5, 12
#: Neighbours share a prefix of at least SHALLOW values; a region with more rows than REGION takes DEPTH values, and one
#: that still has more than BLOCK is compared block by block.  Depth never exceeds DEPTH, so crowding costs no recall.
SHALLOW, DEPTH, REGION, BLOCK = 2, 3, 1024, 4096
#: One in SAMPLE records is counted to find such regions; it decides depths only, every record is compared.
SAMPLE = 16
#: A sketch of 128 one-bit values must not be further below the threshold than this (3.5 standard deviations).
SKETCH_BITS, MARGIN = 128, 0.25
#: Classes of exact copies up to this size are expanded into all pairs, larger ones into pairs with their first member.
EXPAND = 200
#: Texts, and characters of texts, of a block whose pairs are checked together.
CHECKED, CHECKED_CHARS = 128, 1_000_000
_CHARS = 500_000
_NOT_WORD = re.compile(r"[\W_]+")
_EMPTY = np.uint32(0xFFFFFFFF)


def normal_text(title: str | None, body: str | None) -> str:
    """Title and body in lower case, runs of other characters than letters and digits as one blank."""
    return _NOT_WORD.sub(" ", f"{title or ''} {body or ''}".lower()).strip()


def stretches(text: str) -> frozenset[str]:
    """The distinct stretches of a normal text; none if it is too short."""
    return frozenset(text[i : i + STRETCH] for i in range(len(text) - STRETCH + 1))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _minima(hashes: np.ndarray, owner: np.ndarray, n: int, bins: int) -> np.ndarray:
    """One-permutation minima: the smallest low half of the hashes in each bin; empty bins borrow from others."""
    where = owner * bins + ((hashes >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    low = np.full(n * bins, _EMPTY, np.uint32)
    np.minimum.at(low, where, hashes.astype(np.uint32))
    low = low.reshape(n, bins)
    first, gaps = low.copy(), (low == _EMPTY) & (low != _EMPTY).any(1)[:, None]
    attempt = 0
    while gaps.any():
        attempt += 1
        source = (_mix(np.arange(bins, dtype=np.uint64) * np.uint64(2654435761) + np.uint64(attempt * 40503)) % np.uint64(bins)).astype(np.int64)
        lent = first[:, source]
        low = np.where(gaps, lent, low)
        gaps &= lent == _EMPTY
    return low


def signatures(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Labels ``(n, TREES)`` and sketches ``(n, 2)`` as 64-bit numbers."""
    n = len(texts)
    sizes = np.fromiter(map(len, texts), np.int64, n)
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(n), sizes)
    if len(code) < STRETCH:
        return np.zeros((n, TREES), np.int64), np.zeros((n, 2), np.int64)
    m = len(code) - STRETCH + 1
    rolled = code[:m].copy()
    for i in range(1, STRETCH):
        rolled = rolled * np.uint64(0x100000001B3) + code[i : m + i]
    inside = owner[:m] == owner[STRETCH - 1 :]
    hashed, owner = _mix(rolled[inside] + np.uint64(0x2545F4914F6CDD1D)), owner[:m][inside]
    values = _mix(_minima(hashed, owner, n, TREES * LEVELS).astype(np.uint64)) & np.uint64((1 << BITS) - 1)
    labels = np.zeros((n, TREES), np.uint64)
    for level in range(LEVELS):
        labels = labels << np.uint64(BITS) | values[:, level::LEVELS][:, :TREES]
    bits = _mix(_minima(_mix(hashed ^ np.uint64(0x5851F42D4C957F2D)), owner, n, SKETCH_BITS).astype(np.uint64)) & np.uint64(1)
    packed = np.packbits(bits.astype(np.uint8), axis=1).view(np.int64)
    return labels.astype(np.int64), packed


def _prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        step = max(1, int(len(batch) * _CHARS / max(1, batch.nbytes)))
        for lo in range(0, len(batch), step):
            part = batch.slice(lo, step)
            texts = [normal_text(t, b) for t, b in zip(part["title"].to_pylist(), part["body"].to_pylist())]
            labels, sketch = signatures(texts)
            digest = pa.array([blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest() for t in texts], pa.binary())
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, labels.size + 1, TREES, dtype=np.int32)), pa.array(labels.ravel()))
            columns = [part["no"], part["id"], part["info_type"], part["threshold"], digest, flat, pa.array(sketch[:, 0]), pa.array(sketch[:, 1]), pa.array(texts)]
            yield pa.RecordBatch.from_arrays(columns, ["no", "id", "info_type", "threshold", "digest", "labels", "s1", "s2", "text"])


def _runs(key: np.ndarray) -> np.ndarray:
    return np.r_[0, np.flatnonzero(key[1:] != key[:-1]) + 1, len(key)]


def _compare(key, s1, s2, no, limit, earlier) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows with equal key whose sketches are close enough; rows are sorted by key.

    ``earlier`` has the prefixes of the trees before, of rows in crowded regions: two rows that share one have met there.
    """
    left, right = [], []
    at = np.arange(len(key))
    step = 0
    while len(at):
        step += 1
        at = at[at + step < len(key)]
        at = at[key[at] == key[at + step]]
        other = at + step
        # unsigned: of a negative number numpy counts the bits of its absolute value
        apart = sum(np.bitwise_count((s[at] ^ s[other]).view(np.uint64)) for s in (s1, s2))
        near = (1 - 2 * apart.astype(np.float64) / SKETCH_BITS >= limit[at]) & (no[at] != no[other])
        x, y = at[near], other[near]
        fresh = ~(earlier[x] == earlier[y]).any(1)
        left.append(no[x[fresh]])
        right.append(no[y[fresh]])
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
    return np.minimum(a, b), np.maximum(a, b)


def _earlier(column: pa.ListArray, no: np.ndarray) -> np.ndarray:
    """The prefixes in rows of TREES places; a place without prefix is unlike that of any other record."""
    out = np.repeat((-1 - no)[:, None], TREES, 1)
    if column.null_count < len(column):
        sizes = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
        row = np.repeat(np.arange(len(no)), sizes)
        out[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = column.flatten().to_numpy()
    return out


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates among rows sorted by region; a region's rows may lie in several batches."""
    names = ["region", "s1", "s2", "no", "least"]
    rest = None
    for batch in batches:
        now = [batch[n].to_numpy() for n in names]
        now.append(_earlier(batch["earlier"], now[3]))
        if rest is not None:
            now = [np.concatenate(x) for x in zip(rest, now)]
        cut = _runs(now[0])[-2] if len(now[0]) else 0
        rest = [x[cut:] for x in now]
        if cut:
            a, b = _compare(*[x[:cut] for x in now])
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
    if rest is not None:
        a, b = _compare(*rest)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _shared(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of common stretches of all texts with each other, and of the stretches of each: one product of the
    matrix text x stretch, in columns that fit into memory."""
    place: dict[str, int] = {}
    columns = [np.fromiter({place.setdefault(x, len(place)) for x in stretches(t)}, np.int64) for t in texts]
    size = np.array([len(c) for c in columns])
    both = np.zeros((len(texts), len(texts)), np.float32)
    owner, flat = np.repeat(np.arange(len(texts)), size), np.concatenate(columns)
    for lo in range(0, len(place), 8192):
        inside = (flat >= lo) & (flat < lo + 8192)
        part = np.zeros((len(texts), min(8192, len(place) - lo)), np.float32)
        part[owner[inside], flat[inside] - lo] = 1
        both += part @ part.T
    return both, size


def _check(texts: dict[int, tuple[str, float]], pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = (np.array(x, np.int64) for x in zip(*pairs))
    if len(pairs) < 4 * len(texts):
        sets = {n: stretches(t) for n, (t, _) in texts.items()}
        both = np.array([len(sets[x] & sets[y]) for x, y in pairs])
        size_a, size_b = (np.array([len(sets[n]) for n in side]) for side in (a.tolist(), b.tolist()))
    else:  # many pairs of few texts
        row = {n: i for i, n in enumerate(texts)}
        i, j = (np.array([row[n] for n in side]) for side in (a.tolist(), b.tolist()))
        shared, size = _shared([t for t, _ in texts.values()])
        both, size_a, size_b = shared[i, j].astype(np.int64), size[i], size[j]
    least = np.array([texts[n][1] for n in a.tolist()])
    kept = (both > 0) & (both / np.maximum(size_a + size_b - both, 1) >= least)
    return pa.RecordBatch.from_arrays([pa.array(a[kept]), pa.array(b[kept])], ["a", "b"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact similarity of candidate pairs; rows come sorted by block, first the texts of a block, then its pairs."""
    at, texts, pairs = None, {}, []
    for batch in batches:
        for block, a, b, text, least in zip(*(batch[c].to_pylist() for c in ("block", "a", "b", "text", "threshold"))):
            if block != at:
                if pairs:
                    yield _check(texts, pairs)
                at, texts, pairs = block, {}, []
            if b is None:
                texts[a] = (text, least)
            else:
                pairs.append((a, b))
    if pairs:
        yield _check(texts, pairs)


def _verified(ws: Workspace, candidates: DataFrame, prepared: DataFrame) -> DataFrame:
    """The pairs of candidates that reach the threshold.

    Texts are not shipped once per pair: texts with the same smallest candidate form a
    family, families are cut into blocks, and a text goes once to each pair of blocks
    in which it has a pair.
    """
    ways = candidates.select(F.explode(F.array(F.struct(F.col("a").alias("no"), F.col("b").alias("other")), F.struct(F.col("b").alias("no"), F.col("a").alias("other")))).alias("x")).select("x.*")
    family = ws.save(ways.groupBy("no").agg(F.min("other").alias("m")).select("no", F.least("no", "m").alias("family")), "families")
    sized = family.join(prepared.select("no", F.length("text").alias("chars")), "no")
    cuts = sized.groupBy("family").agg(F.ceil(F.greatest(F.count(F.lit(1)) / CHECKED, F.sum("chars") / CHECKED_CHARS)).cast("int").alias("cuts"))
    placed = family.join(cuts, "family").select("no", F.xxhash64("family", F.pmod(F.xxhash64("no"), "cuts")).alias("place"))
    placed = ws.save(placed, "places")
    a, b = placed.toDF("a", "pa"), placed.toDF("b", "pb")
    pairs = ws.save(candidates.join(a, "a").join(b, "b").select(F.xxhash64(F.least("pa", "pb"), F.greatest("pa", "pb")).alias("block"), "a", "b"), "placed")
    wanted = pairs.select("block", F.explode(F.array("a", "b")).alias("no")).distinct()
    texts = prepared.select("no", "threshold", "text").join(wanted, "no").select("block", F.col("no").alias("a"), F.lit(None).cast("long").alias("b"), "text", "threshold")
    rows = texts.unionByName(pairs.select("block", "a", "b", F.lit(None).cast("string").alias("text"), F.lit(None).cast("double").alias("threshold")))
    return rows.repartition("block").sortWithinPartitions("block", F.col("b").asc_nulls_first(), "a").mapInArrow(_verify, "a long, b long")


def _region(depth: int) -> F.Column:
    return F.xxhash64("tree", "info_type", F.lit(depth), F.shiftright("label", BITS * (LEVELS - depth)))


def _place(ws: Workspace, rows: DataFrame) -> DataFrame:
    """Give every (record, tree) row its region: a shallow one where few rows share the prefix, a deeper one where many do.

    Regions that are too large at a depth are found on a sample; they are few, as
    each has many rows, and the join with them is broadcast only if Spark finds
    their table small.  Regions too large at full depth are cut into blocks, and
    each row goes to all pairs of blocks with its own, so that no pair is lost.
    """
    sampled = rows.where(F.pmod(F.xxhash64("no"), F.lit(SAMPLE)) == 0)
    depths = F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), _region(d).alias("region"), F.lit(most).alias("most")) for d, most in ((SHALLOW, REGION), (DEPTH, BLOCK))]))
    crowded = sampled.select(depths.alias("x")).select("x.*").groupBy("depth", "region", "most").agg((F.count(F.lit(1)) * SAMPLE).alias("n")).where(F.col("n") > F.col("most"))
    crowded = ws.save(crowded, "crowded")
    shallow = rows.withColumn("region", _region(SHALLOW)).withColumn("earlier", F.lit(None).cast("array<long>"))
    if crowded.isEmpty():
        return shallow
    deeper = crowded.where(F.col("depth") == SHALLOW).select("region", F.lit(True).alias("_full"))
    # rows that crowd know the prefixes of the trees before: a pair is given by the first tree in which it meets
    earlier = F.transform(F.slice("labels", F.lit(1), F.col("tree")), lambda x: F.shiftright(x, BITS * (LEVELS - DEPTH)))
    placed = shallow.join(deeper, "region", "left").withColumn("earlier", F.when(F.col("_full"), earlier)).withColumn("region", F.when(F.col("_full"), _region(DEPTH)).otherwise(F.col("region"))).drop("_full")
    last = crowded.where(F.col("depth") == DEPTH).select("region", F.ceil(F.col("n") / BLOCK).cast("int").alias("_blocks"))
    placed = placed.join(last, "region", "left").withColumn("_block", F.pmod(F.xxhash64("no", F.lit(7)), F.coalesce("_blocks", F.lit(1))).cast("int"))
    placed = placed.withColumn("_other", F.explode(F.sequence(F.lit(0), F.coalesce("_blocks", F.lit(1)) - 1)))
    blocks = F.xxhash64("region", F.least("_block", "_other"), F.greatest("_block", "_other"))
    return placed.withColumn("region", F.when(F.col("_blocks").isNotNull(), blocks).otherwise(F.col("region"))).drop("_blocks", "_block", "_other")


def prepare(ws: Workspace, records: DataFrame, checks: DataFrame) -> DataFrame:
    """Normal text, digest and signature of every record whose type has a threshold.

    ``checks`` has one row per type, a number that does not grow with the records,
    which is why it is broadcast.
    """
    least = checks.where("info_type is not null and threshold is not null").groupBy("info_type").agg(F.min("threshold").alias("threshold"))
    slim = records.where("id is not null").select(F.monotonically_increasing_id().alias("no"), "id", "info_type", "title", "body")
    rows = slim.join(F.broadcast(least), "info_type").select("no", "id", "info_type", "threshold", "title", "body")
    schema = "no long, id string, info_type string, threshold double, digest binary, labels array<long>, s1 long, s2 long, text string"
    return ws.save(rows.mapInArrow(_prepare, schema), "prepared")


def similar_classes(records: DataFrame, checks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Classes of equal texts, and the pairs of classes that are similar enough.

    Returns ``(no, id, class)`` for every record with a threshold, ``class`` being the
    smallest record number of its class, and ``(a, b)`` for pairs of classes.  Texts
    shorter than a stretch are similar to nothing: their class is null.

    LSH forest: a tree orders the records by a label of min-hash values, in which
    records with a long common prefix are neighbours.  Each tree is sorted by its
    labels, and all neighbours whose common prefix has the depth of their region are
    compared by their sketches: two values where few rows share them, three where
    many do.  Candidates are then checked exactly.  A pair of similarity s is missed
    with chance (1 - s**3) ** 14 at most, 0.3 % for s = 0.7, and less above and
    outside crowded regions, (1 - s**2) ** 14.
    """
    ws = Workspace(records.sparkSession, "near-duplicates")
    prepared = prepare(ws, records, checks)
    long_enough = F.length("text") >= STRETCH
    classes = prepared.where(long_enough).groupBy("info_type", "digest").agg(F.min("no").alias("class"), F.count(F.lit(1)).alias("n")).where("n > 1")
    copies = prepared.where(long_enough).select("no", "info_type", "digest").join(classes, ["info_type", "digest"]).select("no", "class")
    copies = ws.save(copies, "copies")
    members = prepared.join(copies, "no", "left").select("no", "id", F.when(long_enough, F.coalesce("class", "no")).alias("class"))

    firsts = prepared.where(long_enough).select("no", "info_type", "threshold", "labels", "s1", "s2").join(copies.where("no <> class"), "no", "left_anti")
    rows = firsts.select("no", "info_type", (F.col("threshold") - MARGIN).alias("least"), "s1", "s2", "labels", F.posexplode("labels").alias("tree", "label"))
    ordered = _place(ws, rows).select("region", "label", "s1", "s2", "no", "least", "earlier").repartition("region").sortWithinPartitions("region", "label")
    candidates = ws.save(ordered.mapInArrow(_neighbours, "a long, b long").distinct(), "candidates")
    return ws.save(members, "members"), ws.save(_verified(ws, candidates, prepared), "pairs")


def similar_pairs(records: DataFrame, checks: DataFrame, expand: int = EXPAND) -> DataFrame:
    """``(left_info_id, right_info_id)`` of the records that reach the threshold of their type.

    Pairs of classes are expanded to their members, and so are the classes
    themselves.  A class with more than ``expand`` copies appears by its first
    member, which is paired with each of its copies: no link between different
    texts is lost, and the pairs of copies follow from the membership.  Null texts
    count as empty, repeated ids (one id for equal texts) are not paired with
    themselves, and extra columns are not read.
    """
    members, pairs = similar_classes(records, checks)
    sizes = members.where("class is not null").groupBy("class").agg(F.count(F.lit(1)).alias("n"))
    several = sizes.where("n > 1")
    first = members.where("no = class").select("class", "id")
    within = members.join(several, "class").select("class", "id", "no", "n")
    huge, usual = within.where(F.col("n") > expand), within.where(F.col("n") <= expand)
    # members that stand for their class in pairs with other classes
    shown = members.where("class is not null").join(sizes, "class").where((F.col("n") <= expand) | (F.col("no") == F.col("class"))).select("class", "id")
    a = shown.select(F.col("class").alias("a"), F.col("id").alias("ia"))
    b = shown.select(F.col("class").alias("b"), F.col("id").alias("ib"))
    across = pairs.join(a, "a").join(b, "b").select("ia", "ib")
    u = usual.select("class", F.col("id").alias("ia"), F.col("no").alias("na"))
    v = usual.select("class", F.col("id").alias("ib"), F.col("no").alias("nb"))
    copies = u.join(v, "class").where("na < nb").select("ia", "ib")
    starred = huge.where(F.col("no") != F.col("class")).select("class", F.col("id").alias("ib")).join(first.withColumnRenamed("id", "ia"), "class").select("ia", "ib")
    found = across.unionByName(copies).unionByName(starred).where("ia <> ib")
    return found.select(F.least("ia", "ib").alias("left_info_id"), F.greatest("ia", "ib").alias("right_info_id")).distinct()


def similar_groups(records: DataFrame, checks: DataFrame) -> DataFrame:
    """``(info_id, class_id, group_id, n_links)``: one row per record.

    ``class_id`` is the first record with the same normal text, ``group_id`` that of
    the smallest class linked directly or indirectly, ``n_links`` the number of other
    classes that are similar to the record's.  Records too short to compare are
    groups of their own.
    """
    ws = Workspace(records.sparkSession, "groups")
    members, pairs = similar_classes(records, checks)
    arcs = ws.save(both_ways(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"))), "arcs")
    labels = minimum_labels(ws, arcs).select(F.col("node").alias("class"), F.col("label").alias("grp"))
    links = arcs.groupBy("src").agg(F.count(F.lit(1)).alias("n_links")).withColumnRenamed("src", "class")
    rows = members.withColumn("class", F.coalesce("class", "no")).join(labels, "class", "left").join(links, "class", "left")
    return rows.select(F.col("id").alias("info_id"), F.col("class").alias("class_id"), F.coalesce("grp", "class").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
