"""Variant spellings of names typed by people (problem 2): trie join with Levenshtein automata."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.name_forms import NICKNAMES, clean_ticker, forms, simple_signs
from lodestrata.operators.components import both_ways, minimum_labels
from lodestrata.session import Workspace

TYPES = ("company", "institution", "person")
#: Distinct names of a shard before it is cut into blocks.
SHARD = 4000
#: Up to so many copies of a record are expanded into all pairs, more into pairs with the first of them; also the rows of a block of a large entity.
EXPAND = 1000
#: Two edits are allowed for cores of this length if one of the spellings occurs in one record, copies of it aside.
LONG = 8
#: Two edits are allowed in surnames of this length.
SURNAME = 6
#: Parts of up to this many letters meet by what one letter less leaves.
SHORT = 4
#: Letters of a brief form (a surname, or a core without line of business) that may have an edit.
BRIEF = 5


class Trie:
    """Names as a tree of letters; a Levenshtein automaton walks down it."""

    def __init__(self, words: list[str]):
        self.root: dict = {}
        for word in words:
            node = self.root
            for letter in word:
                node = node.setdefault(letter, {})
            node[""] = word

    def within(self, word: str, most: int) -> Iterator[tuple[str, int]]:
        """Words at most ``most`` edits away; neighbours swapped count as one edit.

        A state of the automaton is the row of edit distances to the prefixes of
        ``word``; branches whose state has no entry within the bound are left.
        """
        start = list(range(len(word) + 1))
        stack = [(child, letter, "", start, None) for letter, child in self.root.items() if letter]
        while stack:
            node, letter, last, row, before = stack.pop()
            now = [row[0] + 1]
            for j, own in enumerate(word, 1):
                cost = row[j - 1] if own == letter else 1 + min(row[j - 1], row[j], now[j - 1])
                if before is not None and j > 1 and own == last and word[j - 2] == letter and before[j - 2] + 1 < cost:
                    cost = before[j - 2] + 1
                now.append(cost)
            if min(now) > most:
                continue
            for following, child in node.items():
                if following:
                    stack.append((child, following, letter, now, row))
                elif now[-1] <= most:
                    yield child, now[-1]


def _window(length: int, kind: str) -> int:
    """Letters of the ends of which one keeps all but one when a name of this length has two edits; 0 if two are not allowed."""
    if kind == "p":
        return min(4, length // 2) if length >= SURNAME else 0
    return 0 if length < LONG else 4 if length < 10 else 5


def shards(kind: str, cls: str, core: str) -> list[str]:
    """Tries a name goes into, so that all names within the allowed edits meet.

    One edit leaves the first or the last letters alone.  Of parts of up to four
    letters it may leave neither (kim and kym, chen and cehn); they also go by what is
    left when one letter is taken out, which any two of them one edit apart share, and
    which takes few names together.  Two edits leave at most one in the first letters
    or in the last ones: long names go by the first and by the last letters with each
    of them taken out in turn, in the window of the shorter of two names.

    Persons go by surname, with the given name where that has no edit: in short
    surnames and under two edits.  A class is part of the shard, since firms of
    another line of business are others.  Chinese cores of up to three signs take no
    replaced or swapped sign, so their ends suffice.
    """
    given, _, part = core.rpartition(" ")
    wide = ord(part[0]) >= 0x3400
    if wide:
        sizes = ([1] if len(part) <= 5 else []) + ([2] if len(part) >= 5 else [])
    else:
        sizes = ([2] if len(part) <= 7 else []) + ([3] if len(part) >= 6 and (kind == "p" or len(part) <= LONG) else [])
    keys = [f"{kind}|{cls}|{where}{n}|{piece}" for n in sizes for where, piece in (("<", part[:n]), (">", part[-n:]))]
    if wide:
        return keys
    if len(part) <= SHORT:
        keys += [f"{kind}|{cls}|-|{given}|{piece}" for piece in (part, *(part[:i] + part[i + 1 :] for i in range(len(part))))]
    for n in {_window(len(part) - less, kind) for less in range(3)} - {0}:
        first, last = part[:n], part[-n:]
        for i in range(n):
            keys.append(f"{kind}|{cls}|({n}|{given}|{first[:i]}{first[i + 1 :]}")
            keys.append(f"{kind}|{cls}|){n}|{given}|{last[:i]}{last[i + 1 :]}")
    return list(dict.fromkeys(keys))


def same_entity(kind: str, a: tuple, b: tuple, edits: int) -> bool:
    """The exact check of two spellings that a trie found.

    A spelling is ``(core, n, legal forms or middle initials, tickers)``, ``n`` being
    the number of records of different content, so that a row found again changes nothing.
    Tickers that contradict tell firms apart, and so do legal forms or middle initials.
    One edit suffices otherwise, of Chinese cores if one has at most two such records;
    two edits only for long cores, and long surnames, of which one has one.  Given names that
    are both well known are never variants of each other, and of Chinese cores of
    three signs none may be replaced.
    """
    (x, nx, lx, tx), (y, ny, ly, ty) = a, b
    clash = bool(lx) and bool(ly) and not set(lx) & set(ly)
    if tx and ty and not set(tx) & set(ty):
        return False
    if ord(x[-1]) >= 0x3400 and len(x) == len(y) < 4:
        return False
    if kind == "p":
        gx, gy = x.partition(" ")[0], y.partition(" ")[0]
        if gx != gy and gx in NICKNAMES and gy in NICKNAMES:
            return False
        if edits == 2 and (gx != gy or min(len(x.rpartition(" ")[2]), len(y.rpartition(" ")[2])) < SURNAME):
            return False
    if edits <= 1:
        return not clash and (min(nx, ny) <= 2 or ord(x[-1]) < 0x3400)
    return not clash and min(nx, ny) == 1 and min(len(x), len(y)) >= LONG and ord(x[-1]) < 0x3400


def same_brief(kind: str, a: tuple, b: tuple, edits: int) -> bool:
    """The check of two brief forms of which one is weak.

    No line of business or given name supports the link, so short parts are taken
    only as they are, and the initials of persons must agree.
    """
    x, y = a[0], b[0]
    if kind == "p" and x.partition(" ")[0] != y.partition(" ")[0]:
        return False
    if ord(x[-1]) < 0x3400 and min(len(x.rpartition(" ")[2]), len(y.rpartition(" ")[2])) < BRIEF:
        return False
    return same_entity(kind, a, b, edits)


def _forms(simple: dict[int, str]):
    names = ["id", "kind", "cls", "core", "legal", "weak", "orders", "ticker", "content"]
    types = [pa.bool_() if n == "weak" else pa.list_(pa.string()) if n == "orders" else pa.string() for n in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for i, name, kind, ticker, aliases in zip(*(batch[c].to_pylist() for c in ("id", "name", "node_type", "ticker", "aliases"))):
                code = clean_ticker(ticker) if kind != "person" else None
                content = blake2b(repr((name, kind, ticker, aliases)).encode("utf-8", "surrogatepass"), digest_size=12).hexdigest()
                rows += [(i, f.kind, f.cls, f.core, f.legal, f.weak, f.orders, code, content) for f in forms(name, aliases, kind, simple)]
                if code:
                    rows.append((i, "t", "", code, "", False, (), code, content))
            columns = zip(*rows) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names)

    return run


_SHARD = ("shard", "kind", "hub", "core", "n", "legal", "tickers", "word", "query")


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each name in all its shards: as a word of the trie and to be looked up, and in other orders of its words to be looked up."""
    for batch in batches:
        where, what, kinds, take = [], [], [], []
        for i, (k, c, x, others) in enumerate(zip(*(batch[n].to_pylist() for n in ("kind", "cls", "core", "orders")))):
            for query in (x, *(others or ())):
                for shard in shards(k, c, query):
                    where.append(shard)
                    what.append(query)
                    kinds.append(query is x)
                    take.append(i)
        rows = batch.take(pa.array(take, pa.int32()))
        columns = [pa.array(where, pa.string()), *(rows[n] for n in _SHARD[1:7]), pa.array(kinds, pa.bool_()), pa.array(what, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, list(_SHARD))


def _lookups(rows: list[tuple]) -> Iterator[tuple[tuple, tuple, str, int]]:
    """``(row, word's row, query, edits)`` of a shard: what each row's query finds in the trie of the words."""
    known: dict[str, tuple] = {r[3]: r for r in rows if r[7]}
    trie = Trie(list(known))
    for row in rows:
        kind, core, word, query = row[1], row[3], row[7], row[8]
        if word and kind == "P":
            continue  # whole names in their own order are found by given name and surname
        for other, edits in trie.within(query, _most(query)):
            if other != core:
                yield row, known[other], query, edits


def _join_shard(rows: list[tuple], out: list) -> None:
    if len(rows) < 2:
        return
    for row, found, query, edits in _lookups(rows):
        if (found[3] > row[3] or not row[7]) and same_entity(row[1], (query, *row[4:7]), (found[3], *found[4:7]), edits):
            out.append((row[2], found[2]))


def _join_brief_shard(rows: list[tuple], out: list) -> None:
    """Pairs of close brief forms, at least one of them weak; ``hub`` tells ``w`` for weak."""
    if len(rows) < 2 or all(r[2] != "w" for r in rows):
        return
    for row, found, query, edits in _lookups(rows):
        if (row[2] == "w" or found[2] == "w") and same_brief(row[1], (query, row[4], [], row[6]), (found[3], found[4], [], found[6]), edits):
            out += [(row[1] + row[3], row[1] + found[3]), (row[1] + found[3], row[1] + row[3])]


def _most(core: str) -> int:
    return 2 if len(core) >= LONG - 1 and ord(core[-1]) < 0x3400 else 1


def _join_tries(batches: Iterator[pa.RecordBatch], join=_join_shard) -> Iterator[pa.RecordBatch]:
    """Self-join of each shard; rows come sorted by shard."""
    rows: list[tuple] = []
    for batch in batches:
        out: list[tuple] = []
        for row in zip(*(batch[c].to_pylist() for c in _SHARD)):
            if rows and rows[-1][0] != row[0]:
                join(rows, out)
                rows = []
            rows.append(row)
        yield _links(out)
    out = []
    join(rows, out)
    yield _links(out)


def _links(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.string()), pa.array([b for _, b in out], pa.string())], ["src", "dst"])


def _blocks(ws: Workspace, spread: DataFrame) -> DataFrame:
    """Cut crowded shards into blocks; each name goes to all pairs of blocks with its own."""
    crowded = spread.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / SHARD).cast("int").alias("_k")).where("_k > 1")
    crowded = ws.save(crowded, "crowded")
    if crowded.isEmpty():
        return spread
    wide = spread.join(crowded, "shard", "left").withColumn("_k", F.coalesce("_k", F.lit(1)))
    wide = wide.withColumn("_b", F.pmod(F.xxhash64("core"), "_k").cast("int")).withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    cut = F.concat_ws("#", "shard", F.least("_b", "_o"), F.greatest("_b", "_o"))
    return wide.withColumn("shard", F.when(F.col("_k") > 1, cut).otherwise(F.col("shard"))).drop("_k", "_b", "_o")


def _close(ws: Workspace, spellings: DataFrame, join) -> DataFrame:
    """``(src, dst)`` links that ``join`` finds among spellings in the same shard."""
    shape = "shard string, kind string, hub string, core string, n long, legal array<string>, tickers array<string>, word boolean, query string"
    spread = ws.save(spellings.mapInArrow(_spread, shape), "spread")
    placed = _blocks(ws, spread).repartition("shard").sortWithinPartitions("shard")
    return placed.mapInArrow(join, "src string, dst string")


def _orders() -> F.Column:
    """The orders of the words of a core; those of one core differ only where it was written with other blanks."""
    return F.array_distinct(F.flatten(F.collect_set("orders"))).alias("orders")


def entity_groups(nodes: DataFrame) -> DataFrame:
    """``(node, label)`` for every record that has a variant: label is the smallest id of its entity.

    Every record is known by the forms of its name and aliases.  Records with an
    equal form, or an equal ticker, are linked through the smallest id among them;
    different spellings are linked by the trie join, in which the words of a name are
    also looked up in other orders.  Lines of business and legal forms are evidence:
    a name without any enters the tries too.  A weak form (no line of
    business, or initials for given names) is used only if the record has no other,
    and only if the records it fits, by an equal form or else by a close one, are of
    one entity.  Linked records form entities.

    Only rows of the types company, institution and person count; null or blank
    names, and aliases that are null, empty or repeated, give no form; rows with
    null id are left out.
    """
    ws = Workspace(nodes.sparkSession, "names")
    slim = nodes.where(F.col("node_type").isin(*TYPES) & F.col("id").isNotNull()).select("id", "name", "node_type", "ticker", "aliases")
    shape = "id string, kind string, cls string, core string, legal string, weak boolean, orders array<string>, ticker string, content string"
    found = slim.mapInArrow(_forms(simple_signs(nodes.sparkSession)), shape).distinct()
    found = ws.save(found, "forms")
    strong = found.where("not weak")
    key = ["kind", "cls", "core"]
    # per spelling: its smallest id stands for it; minima and counts are combined before the shuffle
    legal = F.collect_set(F.when(F.col("legal") != "", F.col("legal"))).alias("legal")
    spellings = ws.save(strong.groupBy(*key).agg(F.min("id").alias("hub"), (F.min("id") != F.max("id")).alias("several"), F.countDistinct("content").alias("n"), legal, F.collect_set("ticker").alias("tickers"), _orders()), "spellings")
    equal = strong.join(spellings.where("several and kind <> 'P'").select(*key, "hub"), key).select(F.col("hub").alias("src"), F.col("id").alias("dst"))

    spread = spellings.where("kind <> 't'").select("kind", "cls", "core", "hub", "n", "legal", "tickers", "orders")
    close = _close(ws, spread, _join_tries)
    links = ws.save(equal.unionByName(close).distinct(), "links")
    labels = minimum_labels(ws, ws.save(both_ways(links), "arcs"))
    return _attach_weak(ws, found, labels)


def _attach_weak(ws: Workspace, found: DataFrame, labels: DataFrame) -> DataFrame:
    """Add the records that have weak forms only, where these fit one entity.

    Weak records with equal brief form and equal legal form or second initial are one
    unit.  A unit goes to the entity whose strong forms have the same brief form, or,
    if there is none, one that the tries find close to it.  Units are linked with
    units of an equal or close form whose legal form or second initial does not
    contradict.  A unit is left alone if what it fits is of several entities, or of
    several legal forms.
    """
    entity = found.join(labels, F.col("id") == F.col("node"), "left").where("kind not in ('t', 'P')").select("id", "kind", "core", "legal", "weak", "orders", "ticker", "content", F.coalesce("label", "id").alias("label"))
    surname = F.substring_index("core", " ", -1)
    reduced = F.when((F.col("kind") == "p") & ~F.col("weak"), F.concat_ws(" ", F.substring("core", 1, 1), surname)).otherwise(F.col("core"))
    entity = ws.save(entity.withColumn("brief", reduced), "briefs")
    whole = entity.where("not weak").select("kind", "brief", "legal", "label").distinct()
    weak = entity.where("weak").select(F.col("id").alias("w"), "kind", "brief", F.col("legal").alias("mid"))
    unit = ["kind", "brief", "mid"]
    # weak records of one unit meet through its smallest id
    units = ws.save(weak.groupBy(*unit).agg(F.min("w").alias("hub")), "units")

    state = F.when(F.max("weak"), "w").otherwise("s").alias("hub")
    briefs = entity.groupBy("kind", F.lit("").alias("cls"), F.col("brief").alias("core")).agg(state, F.countDistinct("content").alias("n"), F.array().cast("array<string>").alias("legal"), F.collect_set("ticker").alias("tickers"), _orders())
    pairs = _close(ws, briefs.select("kind", "cls", "core", "hub", "n", "legal", "tickers", "orders"), partial(_join_tries, join=_join_brief_shard))
    near = ws.save(pairs.select(F.substring("src", 1, 1).alias("kind"), F.expr("substring(src, 2)").alias("brief"), F.expr("substring(dst, 2)").alias("other")).distinct(), "near")

    fits = F.col("kind").eqNullSafe("o") | (F.col("mid") == "") | (F.col("legal") == "") | (F.col("mid") == F.col("legal"))
    agrees = lambda other: (F.col("mid") == "") | (F.col(other) == "") | (F.col("mid") == F.col(other))
    span = (F.min("label").alias("label"), F.max("label").alias("most"))
    equal = ws.save(units.join(whole, ["kind", "brief"]).where(fits).groupBy(*unit).agg(*span), "equal")
    rest = units.join(equal, unit, "left_anti").join(near, ["kind", "brief"])
    close = rest.join(whole.withColumnRenamed("brief", "other"), ["kind", "other"]).where(agrees("legal")).groupBy(*unit).agg(*span)
    fitted = equal.unionByName(close)
    units = ws.save(units.join(fitted, unit, "left").select(*unit, "hub", "label", F.coalesce(F.col("label") != F.col("most"), F.lit(False)).alias("torn")), "fitted")

    # links between units: equal or close forms whose legal forms or second initials agree
    far = near.unionByName(units.select("kind", "brief", F.col("brief").alias("other")).distinct())
    second = units.select("kind", F.col("brief").alias("other"), F.col("mid").alias("mid2"), F.col("hub").alias("hub2"), F.col("label").alias("label2"), F.col("torn").alias("torn2"))
    met = units.join(far, ["kind", "brief"]).join(second, ["kind", "other"]).where(agrees("mid2"))
    met = ws.save(met.select("kind", "brief", "mid", "hub", "torn", "hub2", "mid2", "label2", "torn2"), "met")
    mids = F.when(F.col("mid2") != "", F.col("mid2"))
    bounds = [F.min("label2").alias("l1"), F.max("label2").alias("l2"), F.min(mids).alias("m1"), F.max(mids).alias("m2"), F.max("torn").alias("t")]
    clear = met.groupBy("hub").agg(F.max("torn").alias("own"), *bounds).where("not own and not t and (l1 is null or l1 = l2) and (m1 is null or m1 = m2)").select("hub")
    clear = ws.save(clear, "clear")
    linked = met.where("hub < hub2").join(clear, "hub", "left_semi").join(clear.withColumnRenamed("hub", "hub2"), "hub2", "left_semi").select(F.col("hub").alias("src"), F.col("hub2").alias("dst"))

    kept = units.select(*unit, F.when(~F.col("torn"), F.col("label")).alias("label"), "hub")
    placed = weak.join(kept, unit).select(F.col("w").alias("src"), F.explode(F.array_compact(F.array("label", "hub"))).alias("dst"))
    arcs = both_ways(placed.unionByName(linked).unionByName(labels.select(F.col("node").alias("src"), F.col("label").alias("dst"))))
    return minimum_labels(ws, ws.save(arcs, "all"))


def entity_members(nodes: DataFrame) -> DataFrame:
    """``(node_id, entity_id, copy_of)`` for every record that has a variant.

    ``entity_id`` is the smallest id of the entity, ``copy_of`` the smallest id of the
    entity's records with the same name, type, ticker and aliases.
    """
    content = F.md5(F.to_json(F.struct("name", "node_type", "ticker", "aliases")))
    contents = nodes.where(F.col("id").isNotNull()).select(F.col("id").alias("node"), content.alias("content")).groupBy("node").agg(F.min("content").alias("content"))
    ws = Workspace(nodes.sparkSession, "members")
    joined = ws.save(entity_groups(nodes).join(contents, "node"), "joined")
    firsts = joined.groupBy("label", "content").agg(F.min("node").alias("copy_of"))
    return joined.join(firsts, ["label", "content"]).select(F.col("node").alias("node_id"), F.col("label").alias("entity_id"), "copy_of")


def variant_pairs(nodes: DataFrame, expand: int = EXPAND) -> DataFrame:
    """``(left_node_id, right_node_id)`` of the records that denote the same entity.

    All records of an entity are paired with each other, however many there are;
    large entities are paired block by block.  Only exact copies of one record, if
    there are more than ``expand``, appear in these pairs by the first of them, which
    is also paired with each of its copies; ``entity_members`` has the membership.
    """
    ws = Workspace(nodes.sparkSession, "variants")
    members = ws.save(entity_members(nodes), "members")
    copies = members.groupBy("copy_of").agg(F.count(F.lit(1)).alias("copies"))
    sized = members.join(copies, "copy_of")
    shown = ws.save(sized.where((F.col("copies") <= expand) | (F.col("node_id") == F.col("copy_of"))).select("entity_id", "node_id"), "shown")
    blocks = shown.groupBy("entity_id").agg(F.ceil(F.count(F.lit(1)) / expand).cast("int").alias("k"))
    placed = shown.join(blocks, "entity_id").select("entity_id", "node_id", "k", F.pmod(F.xxhash64("node_id"), "k").cast("int").alias("p"))
    # a pair of ids is made where the block of the left one meets the block of the right one
    spread = F.explode(F.sequence(F.lit(0), F.col("k") - 1))
    a = placed.select("entity_id", F.col("node_id").alias("ia"), F.col("p").alias("i"), spread.alias("j"))
    b = placed.select("entity_id", F.col("node_id").alias("ib"), F.col("p").alias("j"), spread.alias("i"))
    pairs = a.join(b, ["entity_id", "i", "j"]).where("ia < ib").select("ia", "ib")
    star = sized.where((F.col("copies") > expand) & (F.col("node_id") != F.col("copy_of"))).select(F.col("copy_of").alias("ia"), F.col("node_id").alias("ib"))
    return pairs.unionByName(star).select(F.col("ia").alias("left_node_id"), F.col("ib").alias("right_node_id"))
