"""Approximate nearest neighbours by NN-descent and greedy search of the graph it builds.

Rows of equal vectors are one node. Nodes get blocks of neighbouring places by a random projection tree, so that what a
block needs of others is fetched once for all its nodes. The graph starts from the leaves of several such trees and is
improved in rounds of Spark joins: a node's neighbours, in both directions, are neighbours' neighbours of each other and
are compared at that node; pairs compared before are not compared again. Rounds end when few lists change. A search
starts at a query's own node and at the nearest rows of a sample, and expands the best nodes met until none is left
unexpanded, all queries one hop a job.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillvec.llm import tasks
from quillvec.llm.common import small_batches
from quillvec.llm.tasks import mixed
from quillvec.session import settle

# Neighbours of a node; reverse neighbours a round joins at a node, of new and of old ones each, drawn by hash.
DEGREE = 24
REVERSE = 24
# Links of a node in the graph that is searched, in both directions.
MOST_LINKS = 48
# Rounds end once this share of list places changes no more.
CHANGES = 0.1
ROUNDS = 16
# Trees are fitted on a sample of so many rows and bytes at most, drawn by hash; all rows go through them.
TREES = 24
SAMPLE_ROWS, SAMPLE_BYTES = 16_384, 32 << 20
LEAF = 128
# Neighbours a row gets from a leaf.
LEAF_NEAR = 8
# Rows of a leaf that are compared with each other at once: larger leaves are dealt by hash.
LEAF_MOST = 512
# Nodes of a block, about.
BLOCK = 16_384
# Nodes a query keeps while it searches, and the nodes it starts from.
BEAM = 160
ENTRIES = 8
# Queries, of neighbouring blocks, that share what they fetch.
TOGETHER = 512
SHIFT = 32


# --- random projection trees -----------------------------------------------------------------------


@dataclass
class Tree:
    """Inner nodes compare a projection with an offset; a negative child -1 - i is leaf i, numbered from left to right."""

    normals: np.ndarray
    offsets: np.ndarray
    children: np.ndarray
    centers: np.ndarray

    def leaves(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), dtype=np.int64) if len(self.normals) else np.full(len(x), -1)
        live = np.flatnonzero(at >= 0)
        while len(live):
            here = at[live]
            right = np.einsum("ij,ij->i", x[live], self.normals[here]) > self.offsets[here]
            at[live] = self.children[here, right.astype(np.int64)]
            live = live[at[live] >= 0]
        return -1 - at


def grow(x: np.ndarray, leaf: int, seed: int) -> Tree:
    """A tree over the rows of `x`: each split at the median along the line through two rows."""
    draw = np.random.default_rng(seed)
    normals, offsets, children, centers = [], [], [], []
    # (rows, the inner node and side that lead here); right sides first, so leaves come out from left to right.
    stack = [(np.arange(len(x)), None, 0)]
    while stack:
        rows, parent, side = stack.pop()
        split = None
        if len(rows) > leaf:
            for _ in range(4):
                a, b = draw.choice(rows, 2, replace=False)
                normal = x[b] - x[a]
                along = x[rows] @ normal
                offset = np.median(along)
                if 0 < (right := along > offset).sum() < len(rows):
                    split = normal, offset, right
                    break
        if split is None:
            number = -1 - len(centers)
            centers.append(x[rows].mean(axis=0) if len(rows) else np.zeros(x.shape[1]))
        else:
            number = len(normals)
            normals.append(split[0])
            offsets.append(split[1])
            children.append([0, 0])
            stack += [(rows[split[2]], number, 1), (rows[~split[2]], number, 0)]
        if parent is not None:
            children[parent][side] = number
    d = x.shape[1]
    return Tree(
        np.array(normals, dtype=np.float32).reshape(-1, d), np.array(offsets, dtype=np.float32),
        np.array(children, dtype=np.int64).reshape(-1, 2), np.array(centers, dtype=np.float32),
    )


# --- in the tasks ----------------------------------------------------------------------------------


def matrix(column: pa.Array, dtype: str, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, d)


def blobs(rows: np.ndarray) -> pa.Array:
    size = rows.shape[1] * rows.itemsize
    data = rows.tobytes()
    return pa.array([data[i : i + size] for i in range(0, len(data), size)] if size else [b""] * len(rows), pa.binary())


def place_batches(tree: Tree, blocks: int, dtype: str) -> Callable:
    """Vectors as bytes, with the block their leaf lies in; blocks are runs of leaves, or parts of one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = tree.centers.shape[1]
        for batch in batches:
            x = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(-1, d)
            part = (batch.column("h").to_numpy() & 0xFFFFF) / float(1 << 20)
            block = ((tree.leaves(x.astype(np.float32)) + part) * blocks / len(tree.centers)).astype(np.int64)
            yield pa.record_batch(
                [pa.array(np.minimum(block, blocks - 1)), batch.column("h"), batch.column("members"), blobs(x)],
                names=["block", "h", "members", "v"],
            )

    return run


def leaf_codes(trees: list[Tree], bits: int, dtype: str) -> Callable:
    """Every node once per tree: tree, leaf, and beyond the sample's leaves the side of some planes through their center."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = trees[0].centers.shape[1]
        planes = np.random.default_rng(7).normal(size=(len(trees), d, bits)).astype(np.float32)
        for batch in batches:
            x = matrix(batch.column("v"), dtype, d).astype(np.float32)
            for t, tree in enumerate(trees):
                leaf = tree.leaves(x)
                sides = ((x - tree.centers[leaf]) @ planes[t] > 0).astype(np.int64) @ (1 << np.arange(bits))
                code = (t << 56) + (leaf << 40) + sides
                yield pa.record_batch([pa.array(code), batch.column("node"), batch.column("v")], names=["code", "node", "v"])

    return run


def nearest_in(nodes: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, neighbour, squared distance) of the k nearest among the rows given, but itself."""
    m = len(nodes)
    k = min(k, m - 1)
    if k < 1:
        return nodes[:0], nodes[:0], np.zeros(0, dtype=np.float32)
    c = x - x.mean(axis=0)
    size = np.einsum("ij,ij->i", c, c)
    far = size[:, None] + size[None, :] - 2 * (c @ c.T)
    np.fill_diagonal(far, np.inf)
    near = np.argpartition(far, k - 1, axis=1)[:, :k]
    return np.repeat(nodes, k), nodes[near.ravel()], squared(x, np.repeat(np.arange(m), k), near.ravel())


def squared(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.empty(len(a), dtype=np.float32)
    for i in range(0, len(a), 65536):
        gap = x[a[i : i + 65536]] - x[b[i : i + 65536]]
        out[i : i + 65536] = np.einsum("ij,ij->i", gap, gap)
    return out


UPDATE = "block long, target long, cand long, dist float"
UPDATE_ARROW = pa.schema([("block", pa.int64()), ("target", pa.int64()), ("cand", pa.int64()), ("dist", pa.float32())])


def updates(target: np.ndarray, cand: np.ndarray, dist: np.ndarray) -> list[pa.Array]:
    return [pa.array(target >> SHIFT), pa.array(target), pa.array(cand), pa.array(dist)]


def leaf_batches(dtype: str, d: int, most: int) -> Callable:
    """Neighbours within leaves that come one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, node, x = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros((0, d), dtype=np.float32)

        def joined(upto: int) -> pa.RecordBatch:
            cuts = np.flatnonzero(np.diff(code[:upto])) + 1
            bounds = np.concatenate([[0], cuts, [upto]])
            found = []
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                for p in range(a, b, LEAF_MOST):
                    q = min(p + LEAF_MOST, b)
                    found.append(nearest_in(node[p:q], x[p:q], most))
            return pa.RecordBatch.from_arrays(updates(*(np.concatenate(f) for f in zip(*found))), schema=UPDATE_ARROW)

        for batch in batches:
            code = np.concatenate([code, batch.column("code").to_numpy()])
            node = np.concatenate([node, batch.column("node").to_numpy()])
            x = np.concatenate([x, matrix(batch.column("v"), dtype, d).astype(np.float32)])
            # The last leaf may go on in the next batch, but in whole pieces only.
            begin = int(np.searchsorted(code, code[-1]))
            done = begin + (len(code) - begin) // LEAF_MOST * LEAF_MOST
            if done:
                yield joined(done)
                code, node, x = code[done:], node[done:], x[done:]
        if len(code):
            yield joined(len(code))

    return run


STATE = "block long, node long, v binary, ids binary, dists binary, fresh binary, radius float, changed int"


def first_of(keys: tuple[np.ndarray, ...], most: int) -> np.ndarray:
    """Places of rows that are among the first `most` of their group; `keys` as for lexsort, the last names the group."""
    order = np.lexsort(keys)
    group = keys[-1][order]
    head = np.concatenate([[True], group[1:] != group[:-1]]) if len(order) else np.zeros(0, dtype=bool)
    begin = np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))
    return order[np.arange(len(order)) - begin < most]


def best_lists(target: np.ndarray, cand: np.ndarray, dist: np.ndarray, fresh: np.ndarray, most: int) -> np.ndarray:
    """Places of the `most` nearest different candidates of each target, one after the other; known ones stay known."""
    order = np.lexsort((fresh, cand, target))
    t, c = target[order], cand[order]
    order = order[np.concatenate([[True], (t[1:] != t[:-1]) | (c[1:] != c[:-1])])] if len(order) else order
    return order[first_of((cand[order], dist[order], target[order]), most)]


def merge_lists(degree: int) -> Callable:
    def run(state: pa.Table, new: pa.Table) -> pa.Table:
        state = state.combine_chunks()
        if not state.num_rows:
            return pa.table({c: pa.array([], t) for c, t in STATE_TYPES})
        nodes = state["node"].to_numpy()
        ids, dists = (state[c].to_pylist() if c in state.column_names else [b""] * len(nodes) for c in ("ids", "dists"))
        sizes = np.array([len(i) // 8 for i in ids], dtype=np.int64)
        target = np.concatenate([np.repeat(nodes, sizes), new["target"].to_numpy()])
        cand = np.concatenate([np.frombuffer(b"".join(ids), "<i8"), new["cand"].to_numpy()])
        dist = np.concatenate([np.frombuffer(b"".join(dists), "<f4"), new["dist"].to_numpy()])
        fresh = np.arange(len(target)) >= sizes.sum()
        best = best_lists(target, cand, dist, fresh, degree)
        order = np.argsort(nodes, kind="stable")
        bounds = np.searchsorted(target[best], nodes[order], side="left"), np.searchsorted(target[best], nodes[order], side="right")
        place = np.empty(len(nodes), dtype=np.int64)
        place[order] = np.arange(len(nodes))
        begin, end = bounds[0][place].tolist(), bounds[1][place].tolist()
        c, f, g = cand[best], dist[best], fresh[best]
        rows = list(zip(begin, end))
        return pa.table({
            "block": state["block"], "node": state["node"], "v": state["v"],
            "ids": pa.array([c[a:b].tobytes() for a, b in rows], pa.binary()),
            "dists": pa.array([f[a:b].tobytes() for a, b in rows], pa.binary()),
            "fresh": pa.array([g[a:b].tobytes() for a, b in rows], pa.binary()),
            # Nearer than this gains a place.
            "radius": pa.array([float(f[b - 1]) if b - a == degree else float("inf") for a, b in rows], pa.float32()),
            "changed": pa.array([int(g[a:b].sum()) for a, b in rows], pa.int32()),
        })

    return run


STATE_TYPES = [
    ("block", pa.int64()), ("node", pa.int64()), ("v", pa.binary()), ("ids", pa.binary()), ("dists", pa.binary()), ("fresh", pa.binary()), ("radius", pa.float32()), ("changed", pa.int32()),
]
EDGE = "block long, at long, u long, fresh boolean, back boolean"


def edge_batches(turn: int, reverse: int) -> Callable:
    """Every link at both its ends. Of links back to one node only what can be drawn leaves the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids").to_pylist()
            u = np.frombuffer(b"".join(ids), "<i8")
            v = np.repeat(batch.column("node").to_numpy(), [len(i) // 8 for i in ids])
            fresh = np.frombuffer(b"".join(batch.column("fresh").to_pylist()), bool)
            back = drawn(u, v, fresh, turn, reverse)
            at, other = np.concatenate([v, u[back]]), np.concatenate([u, v[back]])
            yield pa.record_batch(
                [
                    pa.array(at >> SHIFT), pa.array(at), pa.array(other), pa.array(np.concatenate([fresh, fresh[back]])),
                    pa.array(np.arange(len(at)) >= len(v)),
                ],
                names=["block", "at", "u", "fresh", "back"],
            )

    return run


def drawn(at: np.ndarray, u: np.ndarray, fresh: np.ndarray, turn: int, most: int) -> np.ndarray:
    """Places of the links back to each node, of new and of old ones `most` each, that a hash of the link draws."""
    chance = mixed(at.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + mixed(u.astype(np.uint64) + np.uint64(turn)))
    return first_of((chance, at * 2 + fresh), most)


def lists_at(at: np.ndarray, u: np.ndarray, rows: int) -> np.ndarray:
    """Links, sorted by `at` in 0..rows-1, as a matrix with a row per node; -1 where there is none."""
    counts = np.bincount(at, minlength=rows)
    out = np.full((rows, max(int(counts.max(initial=0)), 1)), -1, dtype=np.int64)
    out[at, np.arange(len(at)) - np.repeat(np.cumsum(counts) - counts, counts)] = u
    return out


def compare_neighbours(dtype: str, d: int, degree: int, reverse: int, turn: int) -> Callable:
    """The local join: at each node its new neighbours are compared with all, and who gains a nearer one is told."""

    def run(edges: pa.Table, vectors: pa.Table) -> pa.Table:
        if not edges.num_rows:
            return UPDATE_ARROW.empty_table()
        at, u = edges["at"].to_numpy(), edges["u"].to_numpy()
        fresh, back = edges["fresh"].to_numpy(), edges["back"].to_numpy()
        # Links back came from several tasks: draw again.
        taken = np.flatnonzero(back)
        taken = np.concatenate([np.flatnonzero(~back), taken[drawn(at[taken], u[taken], fresh[taken], turn, reverse)]])
        order = taken[np.lexsort((~fresh[taken], u[taken], at[taken]))]
        order = order[np.concatenate([[True], (np.diff(at[order]) != 0) | (np.diff(u[order]) != 0)])]
        at, u, fresh = at[order], u[order], fresh[order]
        known = vectors["u"].to_numpy()
        by = np.argsort(known)
        known, x = known[by], matrix(vectors["v"].combine_chunks(), dtype, d).astype(np.float32)[by]
        radius = vectors["radius"].to_numpy()[by]
        u = np.searchsorted(known, u)
        _, row = np.unique(at, return_inverse=True)
        rows = int(row[-1]) + 1
        new, old = lists_at(row[fresh], u[fresh], rows), lists_at(row[~fresh], u[~fresh], rows)
        c = x - x.mean(axis=0)
        size = np.einsum("ij,ij->i", c, c)
        found: list[tuple[np.ndarray, ...]] = []
        held = 0
        step = max(1, (1 << 21) // (new.shape[1] * (new.shape[1] + old.shape[1])))

        def reduce() -> None:
            nonlocal found, held
            t, a, f = (np.concatenate(p) for p in zip(*found))
            best = best_lists(t, a, f, np.zeros(len(t), dtype=bool), degree)
            found = [(t[best], a[best], f[best])]
            held = len(best)

        for i in range(0, rows, step):
            a, b = new[i : i + step], np.concatenate([new[i : i + step], old[i : i + step]], axis=1)
            dots = np.matmul(c[a], c[b].transpose(0, 2, 1))
            near = size[a][:, :, None] + size[b][:, None, :]
            slack = near * np.float32(1e-6)
            near -= 2 * dots
            real = (a >= 0)[:, :, None] & (b >= 0)[:, None, :] & (a[:, :, None] != b[:, None, :])
            near -= slack
            # Towards the first of a pair, and, where the other is old, towards that one; new ones meet both ways round.
            one = np.nonzero(real & (near < radius[a][:, :, None]))
            two = np.nonzero((real & (near < radius[b][:, None, :]))[:, :, a.shape[1] :])
            t = np.concatenate([a[one[0], one[1]], b[two[0], a.shape[1] + two[2]]])
            w = np.concatenate([b[one[0], one[2]], a[two[0], two[1]]])
            f = squared(x, t, w)
            better = f < radius[t]
            found.append((t[better], w[better], f[better]))
            held += int(better.sum())
            if held > 1 << 22:
                reduce()
        reduce()
        t, w, f = found[0]
        return pa.Table.from_arrays(updates(known[t], known[w], f), schema=UPDATE_ARROW)

    return run


# --- the graph -------------------------------------------------------------------------------------


@dataclass
class Graph:
    """`nodes`: node and members (its smallest ids); `links`: node, v (its vector as bytes) and ids (of its neighbours)."""

    nodes: DataFrame
    links: DataFrame
    dtype: str
    dimension: int
    sample: np.ndarray
    sample_nodes: np.ndarray
    rounds: int
    blocks: int


def usable(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """vec_id and embedding of the rows that take part: with an id, and a vector that is finite and not zero."""
    kind = vectors.schema[vector].dataType.elementType.simpleString()
    v = F.col(vector).cast(f"array<{kind if kind == 'float' else 'double'}>")
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("embedding")).where(
        F.col("vec_id").isNotNull() & F.coalesce(F.size("embedding") > 0, F.lit(False)) & finite & F.exists("embedding", lambda c: c != 0)
    )


def smallest_members(rows: DataFrame, most: int) -> DataFrame:
    """Each distinct vector with its `most` smallest different ids; what ranks beyond is dropped before the shuffle."""
    ranked = rows.distinct().withColumn("_rank", F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id")))
    return ranked.where(F.col("_rank") <= most).groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("members"))


def round_of(state: DataFrame, dtype: str, d: int, degree: int, reverse: int, turn: int) -> DataFrame:
    """One round: links at both ends, the vectors each block needs, comparisons, merged lists."""
    edges, ends = (state.mapInArrow(edge_batches(turn, reverse), EDGE) for _ in range(2))
    vectors = state.select(F.col("node").alias("u"), "v", "radius")
    # A block holds its own nodes; those of others that it needs are fetched once.
    foreign = ends.where(F.shiftright("u", SHIFT) != F.col("block")).select("block", "u").distinct().join(vectors, "u")
    own = state.select("block", F.col("node").alias("u"), "v", "radius")
    needed = foreign.select(own.columns).unionByName(own)
    found = edges.groupBy("block").cogroup(needed.groupBy("block")).applyInArrow(compare_neighbours(dtype, d, degree, reverse, turn), UPDATE)
    return state.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(merge_lists(degree), STATE)


def back_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each link from its other end."""
    for batch in batches:
        ids = batch.column("ids").to_pylist()
        target = np.frombuffer(b"".join(ids), "<i8")
        cand = np.repeat(batch.column("node").to_numpy(), [len(i) // 8 for i in ids])
        dist = np.frombuffer(b"".join(batch.column("dists").to_pylist()), "<f4")
        best = first_of((cand, dist, target), MOST_LINKS)
        yield pa.RecordBatch.from_arrays(updates(target[best], cand[best], dist[best]), schema=UPDATE_ARROW)


def both_ways(state: DataFrame) -> DataFrame:
    """The graph that is searched: links in both directions, of each node the MOST_LINKS shortest."""
    back = state.mapInArrow(back_links, UPDATE)
    return state.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(merge_lists(MOST_LINKS), STATE).select("node", "v", "ids")


def drawn_sample(rows: DataFrame, key: Column, columns: list[str], most: int) -> list:
    """The `most` rows of smallest hash; only their columns reach the driver."""
    return rows.select(*columns, key.alias("_h")).orderBy("_h").limit(most).collect()


def build(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", members: int = 11, degree: int = DEGREE) -> Graph | None:
    """The neighbour graph of `vectors`; None where no row takes part (see `usable`).

    Of several lengths of vectors the one of most rows counts (ties: the greater). A node keeps its `members` smallest
    ids: more can't be among the nearest of a search for one less.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, vec_id, vector)
    found = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if found is None:
        return None
    d = found["d"]
    dtype = "<f4" if rows.schema["embedding"].dataType.elementType.simpleString() == "float" else "<f8"
    with small_batches(spark):
        distinct = settle(smallest_members(rows.where(F.size("embedding") == d), members), "vectors")
        n = distinct.count()
        most = max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * d)))
        sample = np.array([r["embedding"] for r in drawn_sample(distinct, F.xxhash64("embedding"), ["embedding"], most)], dtype=np.float32)
        leaf = max(8, LEAF * len(sample) // n)
        trees = [grow(sample, leaf, seed) for seed in range(TREES)]
        bits = max(0, int(np.ceil(np.log2(n / (LEAF * len(trees[0].centers))))))
        blocks = -(-n // BLOCK)
        placed = distinct.select("embedding", "members", F.xxhash64("embedding").alias("h")).mapInArrow(
            place_batches(trees[0], blocks, dtype), "block long, h long, members array<long>, v binary"
        )
        inside = F.row_number().over(Window.partitionBy("block").orderBy("h", "members")).cast("long")
        nodes = settle(placed.select("block", (F.shiftleft("block", SHIFT) + inside).alias("node"), "members", "v"), "nodes")
        near = nodes.mapInArrow(leaf_codes(trees, bits, dtype), "code long, node long, v binary").repartition("code").sortWithinPartitions("code", F.hash("node"))
        first = near.mapInArrow(leaf_batches(dtype, d, LEAF_NEAR), UPDATE)
        state = settle(nodes.select("block", "node", "v").groupBy("block").cogroup(first.groupBy("block")).applyInArrow(merge_lists(degree), STATE), "graph")
        turns = 0
        while turns < ROUNDS and state.agg(F.sum("changed")).first()[0] > CHANGES * n * degree:
            turns += 1
            state = settle(round_of(state, dtype, d, degree, REVERSE, turns), "graph")
        links = settle(both_ways(state), "links")
        entries = drawn_sample(nodes, F.xxhash64("v"), ["node", "v"], most)
    return Graph(
        nodes.select("node", "members"), links, dtype, d,
        np.frombuffer(b"".join(bytes(r["v"]) for r in entries), dtype).reshape(-1, d).astype(np.float32),
        np.array([r["node"] for r in entries], dtype=np.int64), turns, blocks,
    )


# --- greedy search ---------------------------------------------------------------------------------

SEARCH = "block long, q binary, ask binary, seen binary, beam binary, far binary"
SEARCH_TYPES = [("block", pa.int64())] + [(c, pa.binary()) for c in ("q", "ask", "seen", "beam", "far")]


def entry_batches(shared, dtype: str, d: int, entries: int, blocks: int, groups: int) -> Callable:
    """The state of each query before its first hop: it asks for its own node and the nearest of the sample.

    `block` is its group here: the blocks the queries start in, cut into `groups` runs of them, or parts of one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample, nodes = shared.value
        size = np.einsum("ij,ij->i", sample, sample)
        for batch in batches:
            x = matrix(batch.column("q"), dtype, d).astype(np.float32)
            own = batch.column("own").to_pylist()
            rows = []
            for i in range(0, len(x), 256):
                far = size[None, :] - 2 * (x[i : i + 256] @ sample.T)
                k = min(entries, len(sample))
                near = np.argpartition(far, k - 1, axis=1)[:, :k]
                rows += list(nodes[near])
            ask = [np.unique([*r, *([] if o is None else [o])]).astype("<i8") for r, o in zip(rows, own)]
            part = tasks.mixed(x.view(np.uint32).sum(axis=1, dtype=np.uint64)) / 2.0**64
            home = np.array([int(r[0] if o is None else o) >> SHIFT for r, o in zip(rows, own)], dtype=np.int64)
            home = np.minimum((home + part) * groups / blocks, groups - 1).astype(np.int64)
            data, none = [a.tobytes() for a in ask], [b""] * len(ask)
            yield pa.record_batch([pa.array(home), batch.column("q"), *(pa.array(c, pa.binary()) for c in (data, data, none, none))], names=[c for c, _ in SEARCH_TYPES])

    return run


def ask_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        asks = batch.column("ask").to_pylist()
        u = np.frombuffer(b"".join(asks), "<i8")
        block = np.repeat(batch.column("block").to_numpy(), [len(a) // 8 for a in asks])
        yield pa.record_batch([pa.array(block), pa.array(u)], names=["block", "u"])


def hop(dtype: str, d: int, beam: int) -> Callable:
    """Queries of a block take in the nodes they asked for, and ask for all neighbours of those now among the nearest."""

    def run(state: pa.Table, nodes: pa.Table) -> pa.Table:
        known = nodes["u"].to_numpy()
        by = np.argsort(known)
        known, ids = known[by], nodes["ids"].to_pylist()
        x = matrix(nodes["v"].combine_chunks(), dtype, d)[by].astype(np.float64)
        out = []
        for row in state.to_pylist():
            asked, seen = (np.frombuffer(row[c], "<i8") for c in ("ask", "seen"))
            at = np.searchsorted(known, asked)
            gap = x[at] - np.frombuffer(row["q"], dtype).astype(np.float64)
            kept = np.concatenate([np.frombuffer(row["beam"], "<i8"), asked])
            far = np.concatenate([np.frombuffer(row["far"], "<f8"), np.sqrt((gap * gap).sum(axis=1))])
            order = np.lexsort((kept, far))[:beam]
            entered = at[order[order >= len(kept) - len(asked)] - (len(kept) - len(asked))]
            ask = np.setdiff1d(np.concatenate([np.frombuffer(ids[by[i]], "<i8") for i in entered] or [seen[:0]]), seen)
            data = (a.tobytes() for a in (ask, np.concatenate([seen, ask]), kept[order], far[order]))
            out.append((row["block"], row["q"], *data))
        return pa.table([pa.array(c, t) for c, (_, t) in zip(list(zip(*out)) or [[]] * len(SEARCH_TYPES), SEARCH_TYPES)], names=[c for c, _ in SEARCH_TYPES])

    return run


def beam_batches(most: int) -> Callable:
    """(q, node, score) of the `most` nearest nodes of each query, and of those as near as the last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q, node, far = [], [], []
            for row in batch.to_pylist():
                f = np.frombuffer(row["far"], "<f8")
                n = int(np.searchsorted(f, f[min(most, len(f)) - 1], side="right")) if len(f) else 0
                q += [row["q"]] * n
                node.append(np.frombuffer(row["beam"], "<i8")[:n])
                far.append(f[:n])
            flat = [np.concatenate(c) if c else np.zeros(0) for c in (node, far)]
            yield pa.record_batch([pa.array(q, pa.binary()), pa.array(flat[0].astype(np.int64)), pa.array(flat[1].astype(np.float64))], names=["q", "node", "score"])

    return run


def vector_bytes(dtype: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(dtype) + 0.0
            yield pa.record_batch([batch.column("query_id"), blobs(x.astype(dtype).reshape(len(batch.column("query_id")), -1))], names=["query_id", "q"])

    return run


FOUND = "query_id long, rank int, vec_id long, score double"


def search(graph: Graph, queries: DataFrame, k: int, query_id: str = "query_id", vector: str = "embedding", beam: int = BEAM) -> DataFrame:
    """The k nearest rows found for each row of `queries`, but the query's own (same id, same vector), as FOUND.

    Repeated rows are one, also as queries; an id on several vectors is a row on each. Vectors that can't take part (see `usable`), and those of another length than the graph's, find nothing. Equal queries
    are searched for once. Scores are exact; ties go to the smaller id.
    """
    spark, d, dtype = queries.sparkSession, graph.dimension, graph.dtype
    asked = usable(queries, query_id, vector).where(F.size("embedding") == d).select(F.col("vec_id").alias("query_id"), "embedding").distinct()
    with small_batches(spark):
        asked = settle(asked.mapInArrow(vector_bytes(dtype), "query_id long, q binary"), "queries")
        # Where the query is a row of the graph, it starts at itself too.
        own = graph.links.select(F.xxhash64("v").alias("key"), F.col("node").alias("own")).groupBy("key").agg(F.min("own").alias("own"))
        once = asked.select("q").distinct().withColumn("key", F.xxhash64("q")).join(own, "key", "left").select("q", "own")
        groups = -(-once.count() // TOGETHER) or 1
        shared = spark.sparkContext.broadcast((graph.sample, graph.sample_nodes))
        state = settle(once.mapInArrow(entry_batches(shared, dtype, d, ENTRIES, graph.blocks, groups), SEARCH), "search")
        while state.where(F.length("ask") > 0).limit(1).count():
            wanted = state.mapInArrow(ask_batches, "block long, u long").distinct()
            nodes = wanted.join(graph.links.withColumnRenamed("node", "u"), "u")
            state = settle(state.groupBy("block").cogroup(nodes.groupBy("block")).applyInArrow(hop(dtype, d, max(beam, k + 1)), SEARCH), "search")
        # k + 1: one may be the query itself.
        near = state.select("q", "beam", "far").mapInArrow(beam_batches(k + 1), "q binary, node long, score double")
        rows = near.join(graph.nodes, "node").select("q", "score", F.explode("members").alias("vec_id"))
        lists = rows.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("score", "vec_id"))).alias("near"))
        others = F.slice(F.filter("near", lambda n: (n["vec_id"] != F.col("query_id")) | (n["score"] > 0)), 1, k)
        return asked.join(lists, "q").select("query_id", F.posexplode(others).alias("at", "n")).select(
            "query_id", (F.col("at") + 1).alias("rank"), F.col("n.vec_id").alias("vec_id"), F.col("n.score").alias("score")
        )


def query(spark, sf: str) -> DataFrame:
    """The ten nearest of all other embeddings for each one whose vec_id is divisible by 100."""
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding")
    graph = build(vectors)
    if graph is None:
        return spark.createDataFrame([], FOUND)
    return search(graph, vectors.where(F.col("vec_id") % 100 == 0).withColumnRenamed("vec_id", "query_id"), 10)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
