"""Approximate nearest neighbours by inner product (operator 11).

Method: NN-descent builds a neighbour graph. Each round joins every vector with a sample of its
neighbours and of those that it is a neighbour of; whoever meets in such a group is a neighbour's
neighbour, and better ones replace the worst kept. Queries use greedy graph search: a pool of the
best found so far, of which the best not yet followed are followed in each round, until nothing
better is left to follow.

The graph is over distinct vectors, as bytes of a direction, a length, and an added coordinate that
gives all of them one length, so that neighbours by angle serve search by inner product. Scores are
computed from the original vectors. Groups hold a fixed number of vectors each, and a vector that
very many have as a neighbour joins with a sample of them, so no task grows with such a vector.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftloom.llm.shared import Scratch, table
from driftloom.llm.vectors import finite_rows

#: Neighbours given, neighbours kept for each vector, and new or old ones that join in a round.
NEAREST, DEGREE, SAMPLED = 20, 32, 16
#: Best partners that a member of a group proposes; rounds at most, and share of new neighbours that ends them.
PROPOSED, ROUNDS, SETTLED = 8, 10, 0.03
#: Vectors of a first group (sorted by a random code), and how many such sorts.
RUN, SORTS, SPLITS = 512, 2, 16
#: Best found that a search keeps, those followed in a round, rounds at most, and those scored exactly.
POOL, FOLLOWED, SEARCH_ROUNDS, SCORED = 320, 144, 10, 96
#: Vectors whose groups are handled at once.
PART = 256
_MIX = np.uint64(0x9E3779B97F4A7C15)
STATE = "u long, dir binary, norm float, lift float, nbr array<long>, sim array<float>, new array<boolean>"


def _hash(*parts: np.ndarray | int) -> np.ndarray:
    out = np.uint64(0)
    for p in parts:
        p = p.astype(np.int64).view(np.uint64) if isinstance(p, np.ndarray) else np.uint64(p)
        out = (out ^ p) * _MIX
        out = out ^ (out >> np.uint64(29))
    return out * _MIX


def _place(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by (keys..), and each sorted row's place among those of the same first key."""
    order = np.lexsort(keys[::-1])
    first = keys[0][order]
    starts = np.flatnonzero(np.r_[True, first[1:] != first[:-1]]) if len(first) else np.zeros(0, np.int64)
    return order, np.arange(len(first)) - np.repeat(starts, np.diff(np.r_[starts, len(first)]))


def _flat(column) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of a list column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, np.int64)
    return np.repeat(np.arange(len(column)), sizes), column.flatten().to_numpy(zero_copy_only=False)


def _lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(values, kind))


def _numbers(t: pa.Table | pa.RecordBatch, name: str) -> np.ndarray:
    c = t.column(name)
    return (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c).to_numpy(zero_copy_only=False)


def _placed(t: pa.Table | pa.RecordBatch) -> np.ndarray:
    """Vectors of equal length, from their bytes, lengths and added coordinates."""
    raw = np.frombuffer(b"".join(t.column("dir").to_pylist()), np.int8).reshape(t.num_rows, -1).astype(np.float32)
    raw /= np.maximum(np.sqrt((raw * raw).sum(axis=1, keepdims=True)), 1e-30)
    return np.c_[raw * _numbers(t, "norm")[:, None], _numbers(t, "lift")].astype(np.float32)


def _part(node: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(node), F.lit(parts)).cast("int")


def encoded(distinct: DataFrame, width: int, longest: float, seed: int = 11) -> DataFrame:
    """(u, dir, norm, lift, code0, code1, ..) of distinct vectors (u, v): bytes of a direction, and a code for each first sort."""
    planes = np.random.default_rng(seed).standard_normal((SORTS, width, SPLITS))

    def encode(batches):
        for batch in batches:
            v = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, width)
            most = np.abs(v).max(axis=1, keepdims=True)
            v = v / most
            norm = np.sqrt((v * v).sum(axis=1)) * (most[:, 0] / longest)
            raw = np.rint(v * 127).astype(np.int8)
            codes = [((v @ p > 0) @ (1 << np.arange(SPLITS)[::-1])).astype(np.int32) for p in planes]
            dirs = pa.array([r.tobytes() for r in raw], pa.binary())
            parts = [batch.column(0), dirs, pa.array(norm.astype(np.float32)), pa.array(np.sqrt(np.maximum(0, 1 - norm * norm)).astype(np.float32))]
            yield pa.RecordBatch.from_arrays([*parts, *map(pa.array, codes)], ["u", "dir", "norm", "lift", *(f"code{i}" for i in range(SORTS))])

    return distinct.mapInArrow(encode, "u long, dir binary, norm float, lift float, " + ", ".join(f"code{i} int" for i in range(SORTS)))


def _proposals(u: np.ndarray, v: np.ndarray, sim: np.ndarray, most: int) -> pa.RecordBatch:
    """Flat (u, v, sim), the ``most`` best of each u."""
    order = np.lexsort((-sim, v, u))
    u, v, sim = u[order], v[order], sim[order]
    fresh = np.r_[True, (u[1:] != u[:-1]) | (v[1:] != v[:-1])] if len(u) else np.zeros(0, bool)
    u, v, sim = u[fresh], v[fresh], sim[fresh]
    order, place = _place(u, -sim)
    order = order[place < most]
    return pa.RecordBatch.from_arrays([pa.array(u[order]), pa.array(v[order]), pa.array(sim[order].astype(np.float32))], ["u", "v", "sim"])


def _first(batches):
    """Proposals among runs of ``RUN`` rows, which come sorted by a code."""

    def within(t: pa.Table) -> pa.RecordBatch:
        ids, x = _numbers(t, "u"), _placed(t)
        s = x @ x.T
        np.fill_diagonal(s, -9)
        k = min(DEGREE // SORTS, len(ids) - 1)
        best = np.argpartition(-s, k - 1, axis=1)[:, :k] if k > 0 else np.zeros((len(ids), 0), np.int64)
        return _proposals(np.repeat(ids, best.shape[1]), ids[best.ravel()], np.take_along_axis(s, best, axis=1).ravel(), DEGREE)

    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        while sum(b.num_rows for b in held) >= 2 * RUN:
            t = pa.Table.from_batches(held)
            yield within(t.slice(0, RUN))
            held = t.slice(RUN).to_batches()
    if held:
        yield within(pa.Table.from_batches(held))


def _taken(u: np.ndarray, v: np.ndarray, new: np.ndarray, turn: int) -> np.ndarray:
    """Which neighbours join in this round: of each vector ``SAMPLED`` new and as many old ones."""
    order, place = _place(u * 2 + new, _hash(u, v, turn))
    out = np.zeros(len(u), bool)
    out[order[place < SAMPLED]] = True
    return out


def _members(turn: int, batches):
    """(w, m, fresh, turnout): m joins the group of w, for each neighbour taken and the other way round."""
    for batch in batches:
        row, v = _flat(batch.column("nbr"))
        u, new = _numbers(batch, "u")[row], _flat(batch.column("new"))[1].astype(np.int64)
        take = _taken(row.astype(np.int64), v, new, turn)
        u, v, new = u[take], v[take], new[take]
        w, m, fresh = np.r_[u, v], np.r_[v, u], np.r_[new, new]
        back = np.r_[np.zeros(len(u), np.int64), np.ones(len(u), np.int64)]
        luck = (_hash(w, m, turn) >> np.uint64(34)).astype(np.int64)
        # Of those that a vector is a neighbour of, a task sends a sample.
        group = np.unique(w, return_inverse=True)[1].astype(np.int64) * 4 + 2 * back + fresh
        order, place = _place(group, luck)
        keep = order[(place < SAMPLED) | (back[order] == 0)]
        arrays = [pa.array(w[keep]), pa.array(m[keep]), pa.array(fresh[keep].astype(bool)), pa.array((back * (1 << 30) + luck)[keep])]
        yield pa.RecordBatch.from_arrays(arrays, ["w", "m", "fresh", "turnout"])


def _met(t: pa.Table) -> pa.Table:
    """Proposals of a part's groups: pairs with a new member that are better than the worst neighbour kept."""
    w, m, fresh, luck = (_numbers(t, c) for c in ("w", "m", "fresh", "turnout"))
    order = np.lexsort((luck, ~fresh, m, w))
    once = order[np.r_[True, (w[order][1:] != w[order][:-1]) | (m[order][1:] != m[order][:-1])]]
    owner = np.unique(w[once], return_inverse=True)[1].astype(np.int64)
    back = (luck[once] >> 30) & 1
    order, place = _place((owner * 2 + back) * 2 + fresh[once], luck[once])
    once = once[np.sort(order[place < SAMPLED])]
    x, ids, limit = _placed(t)[once], m[once], _numbers(t, "limit")[once]
    w, fresh = w[once], fresh[once]
    starts = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
    sizes = np.diff(np.r_[starts, len(w)])
    us, vs, sims = [], [], []
    for at in range(0, len(starts), 64):
        size = sizes[at : at + 64]
        wide = int(size.max())
        pad = np.minimum(starts[at : at + 64, None] + np.arange(wide), len(w) - 1)
        there = np.arange(wide) < size[:, None]
        s = x[pad] @ x[pad].transpose(0, 2, 1)
        f = fresh[pad]
        good = there[:, :, None] & there[:, None, :] & (f[:, :, None] | f[:, None, :]) & (s > limit[pad][:, :, None]) & (ids[pad][:, :, None] != ids[pad][:, None, :])
        s = np.where(good, s, np.float32(-9))
        k = min(PROPOSED, wide)
        best = np.argpartition(-s, k - 1, axis=2)[:, :, :k]
        value = np.take_along_axis(s, best, axis=2)
        g, i, j = np.nonzero(value > -9)
        us.append(ids[pad[g, i]])
        vs.append(ids[pad[g, best[g, i, j]]])
        sims.append(value[g, i, j])
    return pa.Table.from_batches([_proposals(np.concatenate(us), np.concatenate(vs), np.concatenate(sims), DEGREE)])


def _merged(turn: int, state: pa.Table, found: pa.Table) -> pa.Table:
    """The state of a part's vectors with the best of their neighbours and of what was proposed."""
    u = _numbers(state, "u")
    row, v = _flat(state.column("nbr"))
    sim, new = _flat(state.column("sim"))[1], _flat(state.column("new"))[1].astype(np.int64)
    if turn and len(row):
        new = np.where(_taken(row.astype(np.int64), v, new, turn), 0, new)
    by_id = np.argsort(u)
    more = by_id[np.searchsorted(u[by_id], _numbers(found, "u"))] if found.num_rows else np.zeros(0, np.int64)
    row, v = np.r_[row, more], np.r_[v, _numbers(found, "v")].astype(np.int64)
    sim, new = np.r_[sim, _numbers(found, "sim")].astype(np.float32), np.r_[new, np.ones(len(more), np.int64)]
    order = np.lexsort((new, v, row))
    order = order[np.r_[True, (row[order][1:] != row[order][:-1]) | (v[order][1:] != v[order][:-1])]] if len(order) else order
    row, v, sim, new = row[order], v[order], sim[order], new[order]
    order, place = _place(row, -sim, v)
    order = order[place < DEGREE]
    sizes = np.bincount(row[order], minlength=len(u))
    lists = [_lists(v[order], sizes, pa.int64()), _lists(sim[order], sizes, pa.float32()), _lists(new[order].astype(bool), sizes, pa.bool_())]
    return pa.table([*(state.column(c) for c in ("u", "dir", "norm", "lift")), *lists], names=["u", "dir", "norm", "lift", "nbr", "sim", "new"])


def neighbour_graph(points: DataFrame, count: int, scratch: Scratch, rounds: int = ROUNDS) -> DataFrame:
    """``STATE`` of encoded vectors: each with its nearest found, nearest first, by NN-descent."""
    parts = max(1, -(-count // PART))
    first = None
    for k in range(SORTS):
        dealt = points.select("u", "dir", "norm", "lift", f"code{k}").repartitionByRange(max(1, min(parts // 4, 4096)), f"code{k}", F.xxhash64("u"))
        found = dealt.sortWithinPartitions(f"code{k}", F.xxhash64("u")).drop(f"code{k}").mapInArrow(_first, "u long, v long, sim float")
        first = found if first is None else first.unionByName(found)
    empty = points.select("u", "dir", "norm", "lift", F.expr("cast(array() as array<bigint>)").alias("nbr"), F.expr("cast(array() as array<float>)").alias("sim"), F.expr("cast(array() as array<boolean>)").alias("new"))

    def merge(state: DataFrame, found: DataFrame, turn: int) -> DataFrame:
        sides = state.groupBy(_part(F.col("u"), parts)).cogroup(found.groupBy(_part(F.col("u"), parts)))
        return scratch.cut(sides.applyInArrow(partial(_merged, turn), STATE), f"graph-{turn}", release=True)

    state = merge(empty, first, 0)
    for turn in range(1, rounds + 1):
        members = state.mapInArrow(partial(_members, turn), "w long, m long, fresh boolean, turnout long")
        limit = F.when(F.size("sim") >= DEGREE, F.element_at("sim", -1)).otherwise(F.lit(-9.0)).cast("float").alias("limit")
        there = members.join(state.select(F.col("u").alias("m"), "dir", "norm", "lift", limit), "m")
        found = there.groupBy(_part(F.col("w"), parts)).applyInArrow(_met, "u long, v long, sim float")
        state = merge(state, found, turn)
        scratch.drop(f"graph-{turn - 1}")
        told = state.agg(F.sum(F.size(F.filter("new", lambda x: x))), F.sum(F.size("new"))).first()
        if not told[1] or told[0] <= SETTLED * told[1]:
            break
    return state


def search_index(state: DataFrame, parts: int) -> DataFrame:
    """(node, nbr, dirs, scale): a vector's links in both directions with the bytes and lengths of those they lead to.

    Of the links that lead to a vector, at most ``DEGREE`` are followed back, one for each value of a hash.
    """
    links = state.select("u", F.explode("nbr").alias("v"))
    slot = F.pmod(F.xxhash64("u", "v"), F.lit(DEGREE))
    back = links.groupBy(F.col("v").alias("node"), slot.alias("slot")).agg(F.max_by("u", F.xxhash64("v", "u")).alias("to")).select("node", "to")
    both = links.select(F.col("u").alias("node"), F.col("v").alias("to")).unionByName(back)
    there = both.join(state.select(F.col("u").alias("to"), "dir", "norm"), "to")

    def pack(t: pa.Table) -> pa.Table:
        node, to = _numbers(t, "node"), _numbers(t, "to")
        order = np.lexsort((to, node))
        order = order[np.r_[True, (node[order][1:] != node[order][:-1]) | (to[order][1:] != to[order][:-1])]]
        dirs = t.column("dir").to_pylist()
        starts = np.flatnonzero(np.r_[True, node[order][1:] != node[order][:-1]])
        sizes = np.diff(np.r_[starts, len(order)])
        joined = [b"".join([dirs[i] for i in order[a : a + n].tolist()]) for a, n in zip(starts.tolist(), sizes.tolist())]
        return pa.table([pa.array(node[order][starts]), _lists(to[order], sizes, pa.int64()), pa.array(joined, pa.binary()), _lists(_numbers(t, "norm")[order], sizes, pa.float32())], names=["node", "nbr", "dirs", "scale"])

    return there.groupBy(_part(F.col("node"), parts)).applyInArrow(pack, "node long, nbr array<long>, dirs binary, scale array<float>")


POOLS = "q long, qdir binary, ids array<long>, sims array<float>, done array<boolean>"


def _asks(batches):
    """(q, qdir, limit, node): the best of a pool that are not yet followed, one row each."""
    for batch in batches:
        row, ids = _flat(batch.column("ids"))
        sims, done = _flat(batch.column("sims"))[1], _flat(batch.column("done"))[1].astype(bool)
        sizes = np.bincount(row, minlength=batch.num_rows)
        limit = np.full(batch.num_rows, -np.inf, np.float32)
        ends = np.cumsum(sizes) - 1
        limit[sizes >= POOL] = sims[ends[sizes >= POOL]]
        todo = np.flatnonzero(~done)
        order, place = _place(row[todo], -sims[todo])
        todo = todo[order[place < FOLLOWED]]
        owner = pa.array(row[todo])
        yield pa.RecordBatch.from_arrays([batch.column("q").take(owner), batch.column("qdir").take(owner), pa.array(limit[row[todo]]), pa.array(ids[todo])], ["q", "qdir", "limit", "node"])


def _followed(asks: pa.Table, index: pa.Table) -> pa.Table:
    """(q, v, sim): neighbours of the asked nodes that may enter their query's pool."""
    if not asks.num_rows or not index.num_rows:
        return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float32())], names=["u", "v", "sim"])
    nodes = _numbers(index, "node")
    order = np.argsort(nodes)
    at = np.minimum(np.searchsorted(nodes[order], _numbers(asks, "node")), len(nodes) - 1)
    hit = np.flatnonzero(nodes[order][at] == _numbers(asks, "node"))
    at = order[at[hit]]
    row, nbr = _flat(index.column("nbr"))
    scale = _flat(index.column("scale"))[1]
    raw = np.frombuffer(b"".join(index.column("dirs").to_pylist()), np.int8).reshape(len(nbr), -1).astype(np.float32)
    raw *= (scale / np.maximum(np.sqrt((raw * raw).sum(axis=1)), 1e-30))[:, None]
    starts = np.searchsorted(row, np.arange(index.num_rows + 1))
    # Queries in the order of the table; each is scored against all neighbours of its nodes at once.
    q, limit = _numbers(asks, "q")[hit], _numbers(asks, "limit")[hit]
    by = np.argsort(q, kind="stable")
    firsts = np.flatnonzero(np.r_[True, q[by][1:] != q[by][:-1]]) if len(by) else np.zeros(0, np.int64)
    qdirs = asks.column("qdir").take(pa.array(hit[by[firsts]])).to_pylist()
    us, vs, sims = [], [], []
    for a, b, d in zip(firsts.tolist(), [*firsts[1:].tolist(), len(by)], qdirs):
        rows = np.concatenate([np.arange(starts[n], starts[n + 1]) for n in at[by[a:b]].tolist()])
        ids, pick = np.unique(nbr[rows], return_index=True)
        one = np.frombuffer(d, np.int8).astype(np.float32)
        s = raw[rows[pick]] @ (one / max(1e-30, float(np.sqrt((one * one).sum()))))
        good = s > limit[by[a]]
        us.append(np.full(int(good.sum()), q[by[a]]))
        vs.append(ids[good])
        sims.append(s[good])
    return pa.Table.from_batches([_proposals(np.concatenate(us or [np.zeros(0, np.int64)]), np.concatenate(vs or [np.zeros(0, np.int64)]), np.concatenate(sims or [np.zeros(0, np.float32)]), POOL)])


def _pooled(pools: pa.Table, found: pa.Table) -> pa.Table:
    """Pools with the best of what they hold and what was found; those that were asked for are done."""
    q = _numbers(pools, "q")
    row, ids = _flat(pools.column("ids"))
    sims, done = _flat(pools.column("sims"))[1], _flat(pools.column("done"))[1].astype(np.int64)
    todo = np.flatnonzero(done == 0)
    order, place = _place(row[todo], -sims[todo])
    done[todo[order[place < FOLLOWED]]] = 1
    by_id = np.argsort(q)
    more = by_id[np.searchsorted(q[by_id], _numbers(found, "u"))] if found.num_rows else np.zeros(0, np.int64)
    row, ids = np.r_[row, more], np.r_[ids, _numbers(found, "v")].astype(np.int64)
    sims, done = np.r_[sims, _numbers(found, "sim")].astype(np.float32), np.r_[done, np.zeros(len(more), np.int64)]
    order = np.lexsort((-done, ids, row))
    order = order[np.r_[True, (row[order][1:] != row[order][:-1]) | (ids[order][1:] != ids[order][:-1])]] if len(order) else order
    row, ids, sims, done = row[order], ids[order], sims[order], done[order]
    order, place = _place(row, -sims, ids)
    order = order[place < POOL]
    sizes = np.bincount(row[order], minlength=len(q))
    lists = [_lists(ids[order], sizes, pa.int64()), _lists(sims[order], sizes, pa.float32()), _lists(done[order].astype(bool), sizes, pa.bool_())]
    return pa.table([pools.column("q"), pools.column("qdir"), *lists], names=["q", "qdir", "ids", "sims", "done"])


def search(state: DataFrame, asked: DataFrame, count: int, scratch: Scratch) -> DataFrame:
    """``POOLS`` of the vectors in ``asked`` (column q, each in the graph): the best found, itself among them.

    A search starts at the query's own place in the graph and follows links in both directions.
    """
    parts = max(1, -(-count // PART))
    index = scratch.cut(search_index(state, parts), "index", release=True)
    own = lambda kind, value: F.array(F.lit(value).cast(kind))
    start = state.join(asked.withColumnRenamed("q", "u"), "u", "left_semi")
    pools = start.select(F.col("u").alias("q"), F.col("dir").alias("qdir"), F.array("u").alias("ids"), F.array(F.col("norm")).alias("sims"), own("boolean", False).alias("done"))
    pools = scratch.cut(pools, "pools-0", release=True)
    for turn in range(1, SEARCH_ROUNDS + 2):
        asks = pools.mapInArrow(_asks, "q long, qdir binary, limit float, node long")
        found = asks.groupBy(_part(F.col("node"), parts)).cogroup(index.groupBy(_part(F.col("node"), parts))).applyInArrow(_followed, "u long, v long, sim float")
        sides = pools.groupBy(_part(F.col("q"), parts)).cogroup(found.groupBy(_part(F.col("u"), parts)))
        pools = scratch.cut(sides.applyInArrow(_pooled, POOLS), f"pools-{turn}", release=True)
        scratch.drop(f"pools-{turn - 1}")
        if pools.filter(F.exists("done", lambda x: ~x)).isEmpty():
            break
    return pools


def nearest(df: DataFrame, queries: Column, scratch: Scratch, id_col: str = "vec_id", vector_col: str = "embedding", most: int = NEAREST) -> DataFrame:
    """(query_id, rank, id_col, score): for each row where ``queries`` (over ``id``) holds, the rows found with the largest inner products.

    All other rows are candidates. Vectors that are null, zero, or hold null or non-finite entries take
    no part, nor do rows without an id; shorter vectors are continued by zeros. Rows that agree in id
    and vector are one; a row with the query's id is never its neighbour. Ties go to the smaller id.
    With fewer candidates all that the graph reaches are given; an empty table gives no rows. Other
    columns are not read.
    """
    rows, width = finite_rows(df, id_col, vector_col)
    rows = rows.filter(F.col("id").isNotNull() & F.exists("v", lambda c: c != 0)).withColumn("id", F.col("id").cast("long")).distinct()
    # Copies are one vector in the graph: its least id. The most + 1 least ids of each are all that can be given.
    by_id = Window.partitionBy("v").orderBy("id")
    ranked = rows.withColumns({"n": F.row_number().over(by_id), "u": F.first("id").over(by_id.rowsBetween(Window.unboundedPreceding, Window.currentRow))})
    members = scratch.cut(ranked.filter(F.col("n") <= most + 1).select("u", "id", "v", "n"), "members", release=True)
    distinct = members.filter("n = 1").select("u", "v")
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c))
    told = distinct.agg(F.count("*"), F.max(length)).first()
    count, longest = told[0], told[1] or 1.0
    # A vector's least id need not be unique where rows of one id differ, so the graph numbers them apart.
    named = distinct.withColumn("node", F.xxhash64("u", "v"))
    points = scratch.cut(encoded(named.select("node", "v"), width, longest), "points") if count else None
    if not count:
        return df.sparkSession.createDataFrame([], f"query_id long, rank int, {id_col} long, score double")
    state = neighbour_graph(points, count, scratch)
    asks = rows.filter(queries).join(named.select("v", "node"), "v").select("id", F.col("node").alias("q"))
    asks = scratch.cut(asks, "asks")
    asked = asks.select("q").distinct()
    pools = search(state, asked, count, scratch)
    found = pools.select("q", F.posexplode(F.slice("ids", 1, SCORED)).alias("place", "node")).drop("place")
    vector = named.select("node", "v")
    pairs = found.join(vector, "node").join(vector.select(F.col("node").alias("q"), F.col("v").alias("qv")), "q")
    product = F.aggregate(F.zip_with("v", "qv", lambda a, b: a * b), F.lit(0.0), lambda a, c: a + c)
    scored = pairs.select("q", "node", product.alias("score"))
    copies = members.select(F.xxhash64("u", "v").alias("node"), "id")
    each = scored.join(copies, "node").withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))).filter(F.col("n") <= most + 1)
    best = each.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("n", "id", "score"))).alias("best"))
    given = asks.join(best, "q").select(F.col("id").alias("query_id"), F.posexplode(F.slice(F.filter("best", lambda b: b["id"] != F.col("id")), 1, most)).alias("at", "b"))
    return given.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.id").alias(id_col), F.col("b.score").alias("score"))


def op11_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 11 over all of ``embeddings``: the queries are the rows whose vec_id is divisible by 20."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, Scratch(spark, "neighbours"))


QUERIES = {"op11_neighbours": op11_neighbours}
ORACLES: dict[str, str] = {}
