"""Exact n-gram Jaccard join in metric space.

The distance 1 - J of two sets of word n-grams is a metric; texts link at most ``1 - percent / 100`` apart.

1. Equal sets are one point (their texts are linked anyway). A set with more than ``100 - percent`` of a hundred of its n-grams
   in no other text is farther than the threshold from every other and leaves the search (``sift``); what is left is sifted again.
2. Two texts that have little in common are about 1 apart, and so is each from any pivot that is a text: with such
   pivots alone every window would reach over all regions. The first regions are therefore made in projections. The empty
   set as a pivot gives rings of sizes; by the triangle inequality a partner is at most ``percent`` times smaller, and points
   within that window are replicated to the next ring. In a ring, linked sets differ in at most h elements, so if all n-grams
   are dealt to more than h parts, two linked sets are at distance 0 in at least one part. A part's distinct contents are its
   pivots and a region holds the points at distance 0 from one. Parts without elements are no regions, unless a
   point has so few others that they are needed (then they are, and the guarantee holds).
3. Points tied through regions form families; all links lie within one. Each family is joined exactly: pivots far from each
   other make Voronoi regions, a point goes to every region whose pivot is at most twice the threshold farther than its own
   one, and regions are split again until they are small or no longer shrink. Families above a fixed weight are dealt to
   blocks, and pairs of blocks are joined, each in one task of bounded memory.
4. A join returns no more links than tie its points together; texts are labelled with the least key of their component.

Points are 64-bit hashes of n-grams; equal sets are recognised by two 64-bit sums and their size. Defined cases: a text with
fewer than ``n`` words has its words as its one n-gram; without words, or null, it has no set and links with nothing. Repeated
rows are linked as equal texts; null keys are kept and never serve as a component's key unless it has no other. Other columns
are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from saccadia.llm import arrays, storage
from saccadia.llm.components import components

WORDS = 5
PERCENT = 80
RING = 1.3
#: N-grams that one task holds; larger families are dealt to blocks of half of it.
WEIGHT = 3_000_000
LEAF, PIVOTS = 48, 6
#: In place of a set's fingerprint: several sets.
SEVERAL = np.int64(-1)
#: Rows of three numbers that are sent to all machines at most, about 50 MB.
FEW = 2_000_000


@functools.cache
def rings(largest: int) -> np.ndarray:
    """The least size of each ring, up to one above ``largest``."""
    edges = [1]
    while edges[-1] <= largest:
        edges.append(max(edges[-1] + 1, int(edges[-1] * RING)))
    return np.array(edges, np.int64)


def shingles(t: arrays.Texts, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each row's distinct n-grams, rows in order."""
    low = arrays.Texts(t.first, arrays.LOWER[t.data], t.bounds)
    w = arrays.words(low)
    h = arrays.span_hashes(low.data, w.starts, w.ends)
    row = w.row_of()
    at = np.flatnonzero(arrays.gram_starts(w.bounds, n))
    g = arrays.gram_hashes(h, n)[at] if len(at) else np.zeros(0, np.uint64)
    rows = row[at]
    size = np.diff(w.bounds)
    for r in np.flatnonzero((size > 0) & (size < n)).tolist():  # few words: all of them are the one n-gram
        one = arrays.gram_hashes(h[w.bounds[r]:w.bounds[r + 1]], int(size[r])) + arrays.mix(np.array([size[r]], np.uint64))
        rows, g = np.append(rows, r), np.append(g, one)
    if (size[size > 0] < n).any():
        order = np.argsort(rows, kind="stable")
        rows, g = rows[order], g[order]
    new = ~arrays.repeats(rows, g, g)[0]
    return rows[new], g[new]


def _differ(percent: int, total):
    """The most elements in which two linked sets with ``total`` elements together can differ."""
    return (100 - percent) * total // (100 + percent)


def _regions(rows: np.ndarray, g: np.ndarray, size: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, region) of every region that a row's set is in."""
    edges = rings(int(size.max(initial=1)) * 2)
    home = np.searchsorted(edges, size, "right") - 1
    out_rows, out = [], []
    mixed = arrays.mix(g ^ np.uint64(0x5851F42D4C957F2D))
    for step in itertools.count():  # the rings that may hold a larger partner
        ring = home + step
        ok = (size > 0) & (ring < len(edges) - 1)
        ring = np.minimum(ring, len(edges) - 2)
        if step:
            ok &= size * 100 >= percent * edges[ring]
        if not ok.any():
            break
        top = edges[ring + 1] - 1
        parts = np.where(ok, (_differ(percent, 2 * top) + 1) * 11 // 10 + 1, 0)
        first = np.cumsum(parts) - parts
        mine = ok[rows]
        r = rows[mine]
        at = first[r] + (mixed[mine] % parts[r].astype(np.uint64)).astype(np.int64)
        sums = np.zeros(int(parts.sum()), np.uint64)
        np.add.at(sums, at, arrays.mix(g[mine]))
        full = np.zeros(len(sums), bool)
        full[at] = True
        owner = np.repeat(np.arange(len(size)), parts)
        filled = np.bincount(owner[full], minlength=len(size))
        emit = full | (filled <= _differ(percent, size + top))[owner]
        owner, at = owner[emit], np.flatnonzero(emit)
        part = (at - first[owner]).astype(np.uint64)
        out_rows.append(owner)
        out.append(arrays.mix(sums[emit] ^ arrays.mix(part * np.uint64(1 << 20) + ring[owner].astype(np.uint64) + np.uint64(1))))
    return np.concatenate(out_rows or [np.zeros(0, np.int64)]), np.concatenate(out or [np.zeros(0, np.uint64)])


def _sums(g: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """Two fingerprints of each row's set."""
    out = []
    for salt in (0x9E6C63D0876A9A35, 0xD1B54A32D192ED03):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(arrays.mix(g ^ np.uint64(salt)), dtype=np.uint64)])
        out.append(arrays.signed(total[bounds[1:]] - total[bounds[:-1]]))
    return out


def points(rows: DataFrame, n: int) -> DataFrame:
    """(row, key, size, a, b) of each text; (a, b, size) tells sets apart."""
    def run(batches):
        for batch in batches:
            for t in arrays.texts(batch.column(2)):
                r, g = shingles(t, n)
                bounds = np.searchsorted(r, np.arange(t.rows + 1))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(t.first, t.rows), batch.column(1).slice(t.first, t.rows), pa.array(np.diff(bounds)),
                     *[pa.array(x) for x in _sums(g, bounds)]], names=["row", "key", "size", "a", "b"])

    schema = StructType([*rows.select("row", "key").schema.fields, *StructType.fromDDL("size long, a long, b long").fields])
    return rows.select("row", "key", "text").mapInArrow(run, schema)


def near_points(rows: DataFrame, n: int, percent: int) -> DataFrame:
    """Edges (a, b) between fingerprints ``a`` of sets that share a region: a star around the least one of each region.

    Regions that several sets of a batch share become stars there, and only their centres are sent on, so neither copies nor a
    part that very many sets have in common gather in one task. Regions are sent once and read as a sorted stream.
    """
    def emit(batches):
        for batch in batches:
            parts = []
            for t in arrays.texts(batch.column(0)):
                r, g = shingles(t, n)
                bounds = np.searchsorted(r, np.arange(t.rows + 1))
                owner, region = _regions(r, g, np.diff(bounds), percent)
                parts.append((region, _sums(g, bounds)[0][owner]))
            if not parts:
                continue
            region, node = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            order = np.lexsort((node, region))
            region, node = region[order], node[order]
            first = np.ones(len(region), bool)
            first[1:] = region[1:] != region[:-1]
            centre = node[np.flatnonzero(first)][np.cumsum(first) - 1] if len(node) else node
            tie = ~first & (node != centre)
            ties = np.unique(np.column_stack([node[tie], centre[tie]]), axis=0)
            # a tie travels as a region of its own, with two members
            own = arrays.mix(ties[:, 0].astype(np.uint64) ^ arrays.mix(ties[:, 1].astype(np.uint64)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(arrays.signed(np.concatenate([region[first], own, own]))), pa.array(np.concatenate([node[first], ties[:, 0], ties[:, 1]]))],
                names=["region", "node"])

    def stars(batches):
        region, centre = None, None
        for batch in batches:
            r, node = (batch.column(k).to_numpy() for k in range(2))
            if not len(r):
                continue
            first = np.ones(len(r), bool)
            first[1:] = r[1:] != r[:-1]
            if r[0] == region:
                first[0] = False
                head, at = np.concatenate([[centre], node[np.flatnonzero(first)]]), np.cumsum(first)
            else:
                head, at = node[np.flatnonzero(first)], np.cumsum(first) - 1
            around = head[at]
            region, centre = r[-1], around[-1]
            edges = np.unique(np.column_stack([node, around])[node != around], axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(edges[:, k])) for k in range(2)], names=["a", "b"])

    sent = rows.select("text").mapInArrow(emit, "region long, node long")
    return sent.repartition("region").sortWithinPartitions("region", "node").mapInArrow(stars, "a long, b long").distinct()


def _share(percent: int) -> float:
    """The part of all n-grams that the first sifting looks at: two and a half times what a linked set may have for itself."""
    return min(1.0, 2.5 * (100 - percent) / 100)


def lone_grams(rows: DataFrame, n: int, share: float) -> DataFrame:
    """(a, lone): how many n-grams of a set no other set has, among those with hashes in the given share of all.

    Texts with equal sets are one set, told by its fingerprint ``a``, so copies don't share their n-grams with each other. An n-gram
    that several sets of a batch have is sent once, without a set, so what very many texts share does not gather in one
    task. Hashes are sent with 48 bits: two n-grams that meet by chance count as shared, which never takes a set out.
    """
    def emit(batches):
        for batch in batches:
            grams, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for t in arrays.texts(batch.column(0)):
                r, g = shingles(t, n)
                sets = _sums(g, np.searchsorted(r, np.arange(t.rows + 1)))[0]
                g = arrays.mix(g ^ np.uint64(0x2545F4914F6CDD1D)) >> np.uint64(16)
                looked_at = g < np.uint64(share * (1 << 48))
                grams.append(g[looked_at])
                owners.append(sets[r[looked_at]])
            gram, owner = np.concatenate(grams), np.concatenate(owners)
            order = np.argsort(gram, kind="stable")
            first, heads = _owners(gram[order].astype(np.int64), owner[order])
            yield pa.RecordBatch.from_arrays([pa.array(first), pa.array(heads)], names=["gram", "a"])

    def lone(batches):
        gram, owner = np.zeros(0, np.int64), np.zeros(0, np.int64)  # the n-gram that the next batch may go on with
        for batch in batches:
            gram, owner = (np.concatenate([x, batch.column(k).to_numpy()]) for k, x in enumerate((gram, owner)))
            if not len(gram):
                continue
            gram, owner = _owners(gram, owner)
            yield found(owner[:-1])
            gram, owner = gram[-1:], owner[-1:]
        yield found(owner)

    def found(owner):
        sets, count = np.unique(owner[owner != SEVERAL], return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(sets), pa.array(count)], names=["a", "lone"])

    sent = rows.select("text").mapInArrow(emit, "gram long, a long")
    counted = sent.repartition("gram").sortWithinPartitions("gram").mapInArrow(lone, "a long, lone long")
    return counted.groupBy("a").agg(F.sum("lone").alias("lone"))


def _owners(gram: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of sorted n-grams, and the one set that has each, or ``SEVERAL``."""
    if not len(gram):
        return gram, owner
    first = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
    least, most = np.minimum.reduceat(owner, first), np.maximum.reduceat(owner, first)
    return gram[first], np.where(least == most, least, SEVERAL)


def sift(found: DataFrame, rows: DataFrame, n: int, percent: int) -> DataFrame:
    """The points (row, a, b, size) of ``found`` that can have a partner, one row of each.

    Linked sets x and y have ``100 |x & y| >= percent |x | y| >= percent |x|``, so x has at least ``percent`` of a hundred of its
    n-grams in common with others. The first pass looks at a share of all n-grams, the second at all n-grams of what is left,
    in one text of each set.
    """
    left = found.filter("size > 0").groupBy("a", "b", "size").agg(F.min("row").alias("row"))
    for share in dict.fromkeys((_share(percent), 1.0)):
        counted = left.select("row", "size", "a", "b").join(lone_grams(rows, n, share), "a", "left")
        left = storage.written(counted.filter(100 * F.coalesce("lone", F.lit(0)) <= (100 - percent) * F.col("size")).drop("lone"), "left")
        storage.let_go(rows.sparkSession)
        rows = with_few(rows, left.select("row"), "row")
    return left


def with_few(big: DataFrame, few: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """Join with a stored table: sent to all machines if it is counted and found to be at most ``FEW`` rows, else shuffled."""
    return big.join(F.broadcast(few) if few.count() <= FEW else few, on, how)


class Sets:
    """Sets of one task, joined region by region."""

    def __init__(self, ids: list[int], sets: list[np.ndarray], sides: list[int], percent: int):
        self.ids, self.percent, self.sides = ids, percent, np.array(sides)
        self.size = np.array([len(s) for s in sets], np.int64)
        distinct, self.elements = np.unique(np.concatenate(sets), return_inverse=True)
        self.stops = np.concatenate([[0], np.cumsum(self.size)])
        self.mark = np.zeros(len(distinct), bool)
        self.group = np.arange(len(ids))
        self.links: list[tuple[int, int]] = []
        self.two_sided = len(set(sides)) > 1

    def shared(self, x: int, others: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of one set with others."""
        mine = self.elements[self.stops[x]:self.stops[x + 1]]
        self.mark[mine] = True
        lengths = self.size[others]
        hits = self.mark[self.elements[arrays.expand(self.stops[others], lengths)]]
        self.mark[mine] = False
        return np.add.reduceat(hits, np.cumsum(lengths) - lengths, dtype=np.int64)

    def distance(self, x: int, others: np.ndarray) -> np.ndarray:
        both = self.shared(x, others)
        return 1 - both / (self.size[x] + self.size[others] - both)

    def exact(self, owners: np.ndarray, members: np.ndarray) -> None:
        """Compare each owner with the members that are not yet tied to it; a pair of owners is met once."""
        order = np.full(len(self.ids), len(owners))
        order[owners] = np.arange(len(owners))
        for k, x in enumerate(owners.tolist()):
            rest = members[(order[members] > k) & (self.group[members] != self.group[x])]
            if self.two_sided:
                rest = rest[self.sides[rest] != self.sides[x]]
            near = np.minimum(self.size[rest], self.size[x]) * 100 >= self.percent * np.maximum(self.size[rest], self.size[x])
            rest = rest[near]
            if not len(rest):
                continue
            both = self.shared(x, rest)
            for y in rest[100 * both >= self.percent * (self.size[x] + self.size[rest] - both)].tolist():
                if self.group[x] != self.group[y]:
                    self.group[self.group == self.group[y]] = self.group[x]
                    self.links.append((self.ids[x], self.ids[y]))

    def join(self, owners: np.ndarray, members: np.ndarray) -> None:
        """Link owners with members (which include them), by Voronoi regions while these shrink."""
        if len(members) <= LEAF or len(owners) <= 1:
            return self.exact(owners, members)
        pivots, dist = [int(owners[0])], [self.distance(int(owners[0]), members)]
        while len(pivots) < PIVOTS:
            far = np.min(dist, axis=0)
            k = int(far.argmax())
            if far[k] <= 0:
                break
            pivots.append(int(members[k]))
            dist.append(self.distance(pivots[-1], members))
        table = np.array(dist)
        home, least = table.argmin(axis=0), table.min(axis=0)
        window = 2 * (1 - self.percent / 100) + 1e-9
        owner = np.isin(members, owners)
        for k in range(len(pivots)):
            mine = members[owner & (home == k)]
            reach = members[table[k] <= least + window]
            if not len(mine):
                continue
            if len(reach) > 0.8 * len(members):
                self.exact(mine, reach)
            else:
                self.join(mine, reach)


def _join_groups(percent: int):
    def run(table: pa.Table) -> pa.Table:
        ids = table.column("row").to_pylist()
        sets = [np.frombuffer(x, "<u8") for x in table.column("elements").to_pylist()]
        s = Sets(ids, sets, table.column("side").to_pylist(), percent)
        everyone = np.arange(len(ids))
        s.join(everyone[s.sides == s.sides.min()] if s.two_sided else everyone, everyone)
        return pa.table({"a": pa.array([x[0] for x in s.links], pa.int64()), "b": pa.array([x[1] for x in s.links], pa.int64())})

    return run


def _elements(texts: DataFrame, n: int) -> DataFrame:
    """(row, family, blocks, elements) from (row, family, blocks, text)."""
    def run(batches):
        for batch in batches:
            for t in arrays.texts(batch.column(3)):
                r, g = shingles(t, n)
                stops = np.searchsorted(r, np.arange(t.rows + 1)).tolist()
                raw = [g[a:b].astype("<u8").tobytes() for a, b in zip(stops, stops[1:])]
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(k).slice(t.first, t.rows) for k in range(3)], pa.array(raw, pa.binary())], names=["row", "family", "blocks", "elements"])

    return texts.select("row", "family", "blocks", "text").mapInArrow(run, "row long, family long, blocks long, elements binary")


def links(found: DataFrame, rows: DataFrame, n: int, percent: int) -> DataFrame:
    """Links (a, b) that tie together all linked points of ``found``, as numbers of one row of each point."""
    classes = sift(found, rows, n, percent)
    near = near_points(with_few(rows, classes.select("row"), "row"), n, percent)
    family = components(near).select(F.col("node").alias("a"), F.col("component").alias("family"))
    family = classes.join(family, "a").select("row", "size", "family")
    weights = family.groupBy("family").agg(F.sum("size").alias("weight"))
    half = F.ceil(F.col("weight") / (WEIGHT // 2)).cast("long")
    weights = weights.select("family", F.when(F.col("weight") <= WEIGHT, 1).otherwise(half).cast("long").alias("blocks"))
    members = storage.written(family.join(weights, "family").select("row", "family", "blocks"), "members")
    storage.let_go(rows.sparkSession)
    sets = _elements(with_few(rows.select("row", "text"), members, "row"), n)
    # a point of block i meets every block j: groups (i, j) with i <= j; within a block only in (i, i)
    own = F.pmod(F.xxhash64("row"), F.col("blocks"))
    sets = sets.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    sets = sets.select(
        "family", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "row", "elements"
    )
    return sets.groupBy("family", "i", "j").applyInArrow(_join_groups(percent), "a long, b long")


def numbered(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return storage.numbered(docs, F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))


def join_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per text: ``row`` (its number in ``docs``), ``key``, ``n_shingles``, ``component_id`` and ``first``.

    ``component_id`` is the least key that links reach; ``first`` is the number of one text of the component, the same for all.
    """
    rows = numbered(storage.stable(docs), key, text)
    found = storage.written(points(rows, n), "points")
    label = components(links(found, rows, n, percent))
    # from texts to the class of equal sets, from there to its component
    classes = found.filter("size > 0").groupBy("a", "b", "size").agg(F.min("row").alias("rep"), F.min("key").alias("least"))
    classes = classes.join(label.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    least = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = classes.join(least, "component").select("a", "b", "size", F.col("component").alias("first"), "component_id")
    linked = found.filter("size > 0").select("row", "key", "size", "a", "b").join(classes, ["a", "b", "size"])
    linked = linked.select("row", "key", F.col("size").alias("n_shingles"), "component_id", "first")
    alone = found.filter("size = 0").select("row", "key", F.col("size").alias("n_shingles"), F.col("key").alias("component_id"), F.col("row").alias("first"))
    return linked.union(alone)


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one text of each component, and all texts without words; the columns stay."""
    docs = storage.stable(docs)
    labels = storage.written(join_texts(docs, key, text, n, percent).select("row", (F.col("row") != F.col("first")).alias("goes")), "labels")
    goes, stays = labels.filter("goes").select("row"), labels.filter("NOT goes").select("row")
    whole = storage.numbered(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    found = with_few(whole, goes, "row", "left_anti") if goes.count() <= stays.count() else with_few(whole, stays, "row", "left_semi")
    return found.select("doc.*")
