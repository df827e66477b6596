"""Approximate nearest neighbours on robust-pruned directed graphs.

Vectors are dealt to shards of about ``shard_rows`` by a hash. In each shard a graph is grown in batches: a greedy beam search
of the graph so far proposes neighbours for each new vector; robust pruning keeps the nearest one, drops those that it is
nearer to, by a factor ``alpha``, than the new vector is, and goes on with the nearest left; edges are added both ways and full
lists are pruned again. Queries go through every shard by beam search, and the nearest of all shards are scored exactly.

The largest inner product becomes the smallest distance by one more coordinate, which gives all vectors of a shard the same
length. A shard holds vectors of one band of lengths (the longest is at most 1.15 times the shortest), so that coordinate stays small
beside the others, and is scaled to length 1, so no square overflows.

Each shard is sent once for 65,536 queries, and blocks of queries stream past it in order; a task holds one shard and one batch of blocks.
A shard of at most ``SMALL`` vectors has no graph: all of it is scored.

Rows with equal vectors are one point of the graph, with their ``k + 1`` smallest ids (no query can need more), so copies
crowd no graph and no task. Defined cases: null vectors, zero vectors and those that hold null or a non-finite component
take no part, as candidate or query; neither do rows without an id. A repeated row counts once; an id with several vectors
is a candidate with each. A query meets vectors of its own length only. Ties go to the smaller id. Other columns are not
read. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from saccadia.llm import storage

SHARD_ROWS = 8192
#: The longest vector of a shard is at most so many times the shortest.
BAND = 1.15
DEGREE, BEAM, SEARCH_BEAM, ALPHA, BATCH = 32, 64, 128, 1.2, 512
#: Shards up to this size are searched in full.
SMALL = 256
#: Queries of a block, and blocks that pass one copy of a shard.
QUERY_BLOCK, LANE = 1024, 64


def beam_search(x: np.ndarray, graph: np.ndarray, start: int, queries: np.ndarray, beam: int, expand: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """The nearest points found for each query: (numbers, squared distances), nearest first; -1 where there are fewer."""
    m = len(queries)
    ids = np.full((m, beam), -1, np.int64)
    dist = np.full((m, beam), np.inf, np.float32)
    done = np.ones((m, beam), bool)
    ids[:, 0], done[:, 0] = start, False
    dist[:, 0] = ((queries - x[start]) ** 2).sum(1)
    active = np.arange(m)
    while len(active):
        todo = np.where(done[active], np.inf, dist[active])
        pick = np.argsort(todo, axis=1, kind="stable")[:, :expand]
        rows = np.arange(len(active))[:, None]
        fine = np.isfinite(todo[rows, pick])
        done[active[:, None], pick] |= fine
        near = graph[np.where(fine, ids[active[:, None], pick], 0)]
        near = np.where(fine[:, :, None], near, -1).reshape(len(active), -1)
        near = np.sort(near, axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        near[(near[:, :, None] == ids[active][:, None, :]).any(2)] = -1
        d = ((x[near] - queries[active][:, None, :]) ** 2).sum(2)
        d[near < 0] = np.inf
        all_ids = np.concatenate([ids[active], near], axis=1)
        all_dist = np.concatenate([dist[active], d], axis=1)
        all_done = np.concatenate([done[active], near < 0], axis=1)
        order = np.argsort(all_dist, axis=1, kind="stable")[:, :beam]
        ids[active], dist[active], done[active] = all_ids[rows, order], all_dist[rows, order], all_done[rows, order]
        ids[active] = np.where(np.isfinite(dist[active]), ids[active], -1)
        done[active] |= ids[active] < 0
        active = active[~done[active].all(axis=1)]
    return ids, dist


def robust_prune(x: np.ndarray, centres: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """For each centre, of its candidates (-1: none) those kept, nearest first, then the nearest others while there is room."""
    vectors = x[candidates]
    to_centre = ((vectors - x[centres][:, None, :]) ** 2).sum(2)
    left = (candidates >= 0) & (candidates != centres[:, None])
    norms = (vectors ** 2).sum(2)
    between = norms[:, :, None] + norms[:, None, :] - 2 * np.matmul(vectors, vectors.transpose(0, 2, 1))
    kept = np.full((len(centres), degree), -1, np.int64)
    rows = np.arange(len(centres))
    others = left.copy()
    for k in range(degree):
        near = np.where(left, to_centre, np.inf)
        pick = near.argmin(axis=1)
        open_ = np.isfinite(near[rows, pick])
        if not open_.any():
            break
        taken = candidates[rows, pick]
        kept[open_, k] = taken[open_]
        left &= ~((alpha * alpha * between[rows, pick] <= to_centre) & open_[:, None])
        left[rows, pick] = False
        others &= ~((candidates == taken[:, None]) & open_[:, None])
    room = (kept < 0).sum(1)
    for _ in range(int(room.max(initial=0))):
        near = np.where(others, to_centre, np.inf)
        pick = near.argmin(axis=1)
        open_ = np.isfinite(near[rows, pick]) & (room > 0)
        if not open_.any():
            break
        taken = candidates[rows, pick]
        kept[rows[open_], degree - room[open_]] = taken[open_]
        others &= ~(candidates == taken[:, None])
        room -= open_
    return kept


def _add_reverse(x: np.ndarray, graph: np.ndarray, new: np.ndarray, alpha: float) -> None:
    """Edges back to the new points; lists that overflow are pruned."""
    degree = graph.shape[1]
    source = np.repeat(new, degree)
    target = graph[new].reshape(-1)
    source, target = source[target >= 0], target[target >= 0]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    at = np.flatnonzero(np.append(True, target[1:] != target[:-1]))
    nodes, counts = target[at], np.diff(np.append(at, len(target)))
    have = (graph[nodes] >= 0).sum(1)
    width = int(min(counts.max(initial=0), 3 * degree))
    nth = np.arange(len(target)) - np.repeat(at, counts)
    d = ((x[source] - x[target]) ** 2).sum(1)
    nearest = np.lexsort((d, target))  # of very many incoming edges the nearest are looked at
    source, target = source[nearest], target[nearest]
    coming = np.full((len(nodes), width), -1, np.int64)
    ok = nth < width
    coming[np.repeat(np.arange(len(nodes)), counts)[ok], nth[ok]] = source[ok]
    merged = -np.sort(-np.concatenate([graph[nodes], coming], axis=1), axis=1)
    merged[:, 1:][merged[:, 1:] == merged[:, :-1]] = -1  # edges that were there
    fits = have + counts <= degree
    if fits.any():
        part = -np.sort(-merged[fits], axis=1)[:, :degree]
        graph[nodes[fits]] = part
    for chunk in np.array_split(np.flatnonzero(~fits), max(1, (~fits).sum() // BATCH)):
        if len(chunk):
            graph[nodes[chunk]] = robust_prune(x, nodes[chunk], merged[chunk], degree, alpha)


def _reached(graph: np.ndarray, start: int) -> np.ndarray:
    """Which points can be walked to."""
    seen = np.zeros(len(graph), bool)
    seen[start] = True
    edge = np.array([start])
    while len(edge):
        near = np.unique(graph[edge])
        edge = near[(near >= 0) & ~seen[near]]
        seen[edge] = True
    return seen


def _tie_in(x: np.ndarray, graph: np.ndarray, start: int, beam: int) -> np.ndarray:
    """The graph with columns of further edges, until every point can be walked to.

    A round gives each point that is left out an edge from the nearest point that its search finds and that has none new in this
    round; at least one point is tied in a round, and what it leads to with it.
    """
    while True:
        out = np.flatnonzero(~_reached(graph, start))
        if not len(out):
            return graph
        extra = np.full(len(graph), -1, np.int64)
        for part in np.array_split(out, -(-len(out) // BATCH)):
            found, _ = beam_search(x, graph, start, x[part], beam)
            for point, near in zip(part.tolist(), found):
                free = near[(near >= 0) & (extra[near] < 0)]
                if len(free):
                    extra[free[0]] = point
        graph = np.column_stack([graph, extra])


def build(x: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA, seed: int = 7) -> tuple[np.ndarray, int]:
    """The graph (a row of neighbours for each point, -1 for none) and the point where searches start.

    Points are put in by batches; then each is searched for once more in the whole graph and its list pruned again; then points
    that no walk from the start reaches are tied in.
    """
    n = len(x)
    start = int(((x - x.mean(0)) ** 2).sum(1).argmin())
    order = np.random.default_rng(seed).permutation(n)
    order = np.concatenate([[start], order[order != start]])
    graph = np.full((n, degree), -1, np.int64)
    done = min(n, 2 * degree)
    first = order[:done]
    graph[first] = robust_prune(x, first, np.broadcast_to(first, (done, done)).copy(), degree, alpha)
    while done < n:
        new = order[done:done + min(BATCH, done)]
        found, _ = beam_search(x, graph, start, x[new], beam)
        graph[new] = robust_prune(x, new, found, degree, alpha)
        _add_reverse(x, graph, new, alpha)
        done += len(new)
    for at in range(0, n, BATCH):
        again = order[at:at + BATCH]
        found, _ = beam_search(x, graph, start, x[again], beam)
        graph[again] = robust_prune(x, again, np.concatenate([found, graph[again]], axis=1), degree, alpha)
        _add_reverse(x, graph, again, alpha)
    return _tie_in(x, graph, start, beam), start


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda v: v.isNotNull() & (F.abs(v) < float("inf")) & ~F.isnan(v))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False)) & F.exists(vector, lambda v: v != 0)


def valid(table: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, vector as doubles, two hashes that stand for the vector), each once."""
    v = F.col("v")
    picked = table.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    picked = picked.filter(F.col("id").isNotNull() & usable(v)).withColumn("v", F.transform(v, lambda c: c + F.lit(0.0)))
    return picked.select("id", "v", F.xxhash64("v").alias("a"), F.xxhash64(F.lit(1), "v").alias("b"))


def members(points: DataFrame, k: int) -> DataFrame:
    """The k + 1 smallest ids of each distinct vector; the limit is applied before rows are sent as well as after."""
    ranked = points.select("a", "b", "id").withColumn("nth", F.dense_rank().over(Window.partitionBy("a", "b").orderBy("id")))
    return ranked.filter(F.col("nth") <= k + 1).select("a", "b", "id").distinct()


def _matrix(column: pa.Array) -> np.ndarray:
    return np.stack([np.frombuffer(x, "<f8") for x in column.to_pylist()])


def _scaled(v: np.ndarray) -> np.ndarray:
    """Vectors divided by the length of the longest."""
    u = v / np.abs(v).max()
    return u / np.sqrt((u * u).sum(1).max())


def _directions(v: np.ndarray) -> np.ndarray:
    """Vectors of length 1."""
    u = v / np.abs(v).max(1, keepdims=True)
    return u / np.sqrt((u * u).sum(1, keepdims=True))


def index(points: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per shard: its vectors, their hashes, the graph. Every distinct vector is in one shard."""
    distinct = points.groupBy("a", "b").agg(F.min("v").alias("v")).withColumn("dim", F.size("v")).withColumn("most", F.array_max(F.transform("v", F.abs)))
    squares = F.aggregate("v", F.lit(0.0), lambda s, c: s + (c / F.col("most")) * (c / F.col("most")))
    band = F.round((F.log2("most") + F.log2(squares) / 2) / np.log2(BAND).item()).cast("int")  # the length as a power of BAND
    distinct = storage.written(distinct.withColumn("band", band).drop("most"), "vectors")
    sizes = distinct.groupBy("dim", "band").agg(F.ceil(F.count("*") / shard_rows).cast("long").alias("shards"))  # a few rows
    before = F.coalesce(F.sum("shards").over(Window.partitionBy("dim").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.withColumn("first", before)
    shard = F.col("first") + F.pmod(F.col("a"), F.col("shards"))
    placed = distinct.join(sizes, ["dim", "band"]).withColumn("shard", shard).select("dim", "shard", "a", "b", "v")

    def grow(table: pa.Table) -> pa.Table:
        lists = table.column("v").combine_chunks()
        dim = table.column("dim")[0].as_py()
        v = lists.flatten().to_numpy().reshape(-1, dim)
        order = np.lexsort((table.column("b").to_numpy(), table.column("a").to_numpy()))
        v = v[order]
        u = _scaled(v)
        rest = np.sqrt(np.maximum(1 - (u * u).sum(1), 0))
        graph, start = build(np.column_stack([u, rest]).astype(np.float32)) if len(v) > SMALL else (np.zeros((0, 1), np.int64), 0)
        one = lambda x, kind: pa.array([np.ascontiguousarray(x).astype(kind).tobytes()], pa.binary())
        return pa.table({
            "dim": pa.array([dim], pa.int32()), "shard": table.column("shard").slice(0, 1).combine_chunks(), "start": pa.array([start], pa.int64()),
            "vectors": one(v, "<f8"), "rest": one(rest, "<f8"), "graph": one(graph, "<i4"),
            "a": one(table.column("a").to_numpy()[order], "<i8"), "b": one(table.column("b").to_numpy()[order], "<i8"),
        })

    schema = "dim int, shard long, start long, vectors binary, rest binary, graph binary, a binary, b binary"
    return storage.written(placed.groupBy("dim", "shard").applyInArrow(grow, schema), "graphs")


class _Shard:
    """A shard that blocks of queries are searched in."""

    def __init__(self, row: dict):
        self.dim = row["dim"]
        self.v = np.frombuffer(row["vectors"], "<f8").reshape(-1, self.dim)
        self.a, self.b = np.frombuffer(row["a"], "<i8"), np.frombuffer(row["b"], "<i8")
        if len(self.v) > SMALL:
            self.x = np.column_stack([_scaled(self.v), np.frombuffer(row["rest"], "<f8")]).astype(np.float32)
            self.graph = np.frombuffer(row["graph"], "<i4").reshape(len(self.v), -1).astype(np.int64)
            self.start = row["start"]

    def search(self, ids: bytes, queries: bytes, k: int, beam: int) -> pa.RecordBatch:
        v, ids, q = self.v, np.frombuffer(ids, "<i8"), np.frombuffer(queries, "<f8").reshape(-1, self.dim)
        if len(v) <= SMALL:
            found = np.broadcast_to(np.arange(len(v)), (len(q), len(v)))
        else:
            flat = np.column_stack([_directions(q), np.zeros(len(q))]).astype(np.float32)
            found, _ = beam_search(self.x, self.graph, self.start, flat, beam)
        with np.errstate(over="ignore", invalid="ignore"):
            score = np.einsum("qkd,qd->qk", v[found], q)
            if not np.isfinite(score).all():  # beyond the largest double: infinite, with the sign of the product
                signs = np.einsum("qkd,qd->qk", _directions(v)[found], _directions(q))
                score = np.where(np.isfinite(score), score, np.sign(signs) * np.inf)
        score[found < 0] = -np.inf
        take = np.argsort(-score, axis=1, kind="stable")[:, :k + 1]
        rows = np.arange(len(q))[:, None]
        found, score = found[rows, take], score[rows, take]
        ok = found >= 0
        n = np.repeat(ids[:, None], found.shape[1], axis=1)[ok]
        columns = [pa.array(n), pa.array(self.a[found[ok]]), pa.array(self.b[found[ok]]), pa.array(score[ok])]
        return pa.RecordBatch.from_arrays(columns, names=["query_id", "a", "b", "score"])


def search(shards: DataFrame, queries: DataFrame, k: int, beam: int = SEARCH_BEAM) -> DataFrame:
    """(query_id, a, b, score): the k + 1 best distinct vectors that each shard gives each query (id, v)."""
    counts = {r["dim"]: r["n"] for r in shards.groupBy("dim").agg((F.max("shard") + 1).alias("n")).collect()}
    wanted = queries.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"))
    blocks = {r["dim"]: max(1, -(-r["n"] // QUERY_BLOCK)) for r in wanted.collect()}  # a row per vector length

    def pick(counts: dict[int, int], dim: Column) -> Column:
        number = F.lit(0).cast("long")
        for d, n in counts.items():
            number = F.when(dim == d, F.lit(n).cast("long")).otherwise(number)
        return number

    def each(n: Column) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), n - 1))

    q = queries.withColumn("dim", F.size("v")).withColumn("block", F.pmod(F.xxhash64("id"), F.greatest(pick(blocks, F.col("dim")), F.lit(1).cast("long"))))
    packed = q.groupBy("dim", "block").applyInArrow(_pack_queries, "dim int, block long, ids binary, queries binary")
    packed = packed.withColumn("n", pick(counts, F.col("dim"))).filter("n > 0").withColumn("shard", each(F.col("n"))).drop("n")
    packed = packed.withColumn("lane", F.floor(F.col("block") / LANE))
    lanes = F.ceil(pick(blocks, F.col("dim")) / LANE)
    sent = shards.withColumn("n", lanes).filter("n > 0").withColumn("lane", each(F.col("n"))).withColumn("block", F.lit(-1).cast("long")).drop("n")
    # a shard comes first, then its blocks; one shard and lane is the work of one task
    work = sent.unionByName(packed, allowMissingColumns=True).repartition("dim", "shard", "lane").sortWithinPartitions("dim", "shard", "lane", "block")

    def run(batches):
        shard = None
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                if row["block"] < 0:
                    shard = _Shard(row)
                else:
                    yield shard.search(row["ids"], row["queries"], k, beam)

    return work.mapInArrow(run, "query_id long, a long, b long, score double")


def _pack_queries(table: pa.Table) -> pa.Table:
    dim = table.column("dim")[0].as_py()
    v = table.column("v").combine_chunks().flatten().to_numpy().reshape(-1, dim)
    order = np.argsort(table.column("id").to_numpy(), kind="stable")
    return pa.table({
        "dim": table.column("dim").slice(0, 1).combine_chunks(), "block": table.column("block").slice(0, 1).combine_chunks(),
        "ids": pa.array([table.column("id").to_numpy()[order].astype("<i8").tobytes()], pa.binary()),
        "queries": pa.array([v[order].astype("<f8").tobytes()], pa.binary()),
    })


def nearest(table: DataFrame, every: int = 20, k: int = 20, key: str = "vec_id", vector: str = "embedding", shard_rows: int = SHARD_ROWS,
            beam: int = SEARCH_BEAM) -> DataFrame:
    """For each row whose id is divisible by ``every``: (query_id, rank, vec_id, score) of its ``k`` nearest found."""
    points = valid(table, key, vector)
    found = search(index(points, shard_rows), points.filter(F.col("id") % every == 0).select("id", "v").distinct(), k, beam)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "a", "b")
    # more than k + 1 vectors can't be needed: each has a row, and one of them may be the query's own
    few = found.withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= 4 * (k + 1)).drop("nth")
    rows = few.join(members(points, k), ["a", "b"]).filter("id <> query_id").groupBy("query_id", "id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    ranked = rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias("vec_id"), "score")
