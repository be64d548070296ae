"""Approximate nearest neighbours by inner product: one hierarchical navigable small-world
(HNSW) graph per shard, stored as flat neighbour arrays; shard results are merged.

Equal vectors are one node: they are gathered before sharding, and since ties go to smaller
identifiers a node needs only its ``k + 1`` smallest (``k`` besides a query's own).  Nodes are
hashed into shards of about ``shard_size``.  A shard's graph is built in bulk: levels are
drawn as in HNSW (from the vector's hash), each level's nodes get candidates from blocked
matrix products, neighbours by HNSW's diversity rule, and links in both directions up to
the level's degree.  Vectors get one more component that gives all of a shard the same
norm, so the graph is sound for inner products of unnormalised vectors too.

Search sends blocks of queries through every shard: per shard the graph comes first and the
query blocks follow in one sorted stream, so a task holds one graph and one block.  Each
block walks down the levels greedily and then keeps a beam of ``ef`` nodes on the lowest,
all queries of a block in step.  Scores are computed again in double precision on the
original vectors.  Every row is indexed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundeval.llm.common import cut_lineage, shuffle_partitions

PARTS = ["ids", "owner", "vectors", "nodes", "links", "levels"]


def diverse(sims: np.ndarray, cand: np.ndarray, vectors: np.ndarray, degree: int) -> np.ndarray:
    """HNSW's neighbour rule for rows of candidates sorted by falling similarity: take a
    candidate that is nearer to the node than to any neighbour taken before; then fill up
    with the nearest of the others.  Missing candidates and neighbours are -1."""
    n, c = cand.shape
    got = vectors[np.maximum(cand, 0)]
    mutual = got @ got.transpose(0, 2, 1)
    taken = np.zeros((n, c), dtype=bool)
    for j in range(c):
        near = np.where(taken, mutual[:, j, :], -np.inf).max(axis=1)
        taken[:, j] = (cand[:, j] >= 0) & (near < sims[:, j]) & (taken.sum(axis=1) < degree)
    rank = np.where(cand < 0, 2 * c, np.where(taken, 0, c) + np.arange(c))
    order = np.argsort(rank, axis=1, kind="stable")[:, :degree]
    return np.take_along_axis(cand, order, axis=1)


def link_level(vectors: np.ndarray, members: np.ndarray, degree: int, width: int) -> np.ndarray:
    """``len(members) x degree`` neighbours (numbers of nodes, -1 for none) of one level."""
    own = vectors[members]
    n = len(members)
    width = min(width, n - 1)
    out = np.full((n, degree), -1, dtype=np.int32)
    if width <= 0:
        return out
    forward = max(1, degree * 3 // 4)
    chosen = np.full((n, forward), -1, dtype=np.int64)
    for lo in range(0, n, 512):
        sims = own[lo : lo + 512] @ own.T
        sims[np.arange(len(sims)), np.arange(lo, lo + len(sims))] = -np.inf
        cand = np.argpartition(-sims, width - 1, axis=1)[:, :width] if width < n else np.argsort(-sims, axis=1)
        s = np.take_along_axis(sims, cand, axis=1)
        order = np.argsort(-s, axis=1, kind="stable")
        cand, s = np.take_along_axis(cand, order, axis=1), np.take_along_axis(s, order, axis=1)
        got = diverse(s, cand, own, forward)
        chosen[lo : lo + len(got), : got.shape[1]] = got
    # links both ways, each node's nearest kept
    a = np.repeat(np.arange(n), forward)
    b = chosen.ravel()
    a, b = a[b >= 0], b[b >= 0]
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    pair = np.unique(a * n + b)
    a, b = pair // n, pair % n
    sim = np.einsum("ij,ij->i", own[a], own[b])
    # a node's own choices come before links from others, then by similarity
    mine = (chosen[a] == b[:, None]).any(axis=1)
    order = np.lexsort((-sim, ~mine, a))
    a, b = a[order], b[order]
    first = np.searchsorted(a, np.arange(n))
    rank = np.arange(len(a)) - first[a]
    keep = rank < degree
    out[a[keep], rank[keep]] = members[b[keep]]
    return out


class Graph:
    """A shard: row identifiers, the node of each, node vectors, and per level its nodes and
    their neighbours (level 0 first), all flat."""

    def __init__(self, ids, owner, vectors, levels: list[tuple[np.ndarray, np.ndarray]]):
        self.ids, self.owner, self.vectors, self.levels = ids, owner, vectors, levels
        self.first = np.searchsorted(owner, np.arange(len(vectors) + 1))

    @classmethod
    def build(cls, ids: np.ndarray, owner: np.ndarray, vectors: np.ndarray, draw: np.ndarray, m: int, width: int) -> Graph:
        norm = np.einsum("ij,ij->i", vectors, vectors, dtype=np.float64)
        lift = np.sqrt(np.maximum(norm.max(initial=0.0) - norm, 0.0))
        even = np.concatenate([vectors, lift[:, None]], axis=1).astype(np.float32)
        level = np.floor(-np.log(np.maximum(draw, 1e-12)) / np.log(m)).astype(int)
        levels = []
        for at in range(level.max(initial=0) + 1):
            members = np.flatnonzero(level >= at)
            levels.append((members, link_level(even, members, 2 * m if at == 0 else m, width)))
        return cls(ids, owner, vectors, levels)

    def pack(self) -> dict[str, bytes]:
        sizes = [(len(a), b.shape[1]) for a, b in self.levels]
        return {
            "ids": self.ids.astype("<i8").tobytes(),
            "owner": self.owner.astype("<i4").tobytes(),
            "vectors": self.vectors.astype("<f4").tobytes(),
            "nodes": b"".join(a.astype("<i4").tobytes() for a, _ in self.levels),
            "links": b"".join(b.astype("<i4").tobytes() for _, b in self.levels),
            "levels": np.array(sizes, dtype="<i4").tobytes(),
        }

    @classmethod
    def unpack(cls, row: dict[str, bytes], dim: int) -> Graph:
        flat = {k: np.frombuffer(row[k], dtype="<i4") for k in ("owner", "nodes", "links", "levels")}
        levels, a, b = [], 0, 0
        for n, degree in flat["levels"].reshape(-1, 2).tolist():
            levels.append((flat["nodes"][a : a + n], flat["links"][b : b + n * degree].reshape(n, degree)))
            a, b = a + n, b + n * degree
        vectors = np.frombuffer(row["vectors"], dtype="<f4").reshape(-1, dim)
        return cls(np.frombuffer(row["ids"], dtype="<i8"), flat["owner"], vectors, levels)

    def search(self, queries: np.ndarray, ef: int, step: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """The beam of every query after the walk: node numbers (-1: none) and similarities."""
        nq, n = len(queries), len(self.vectors)
        sim = lambda nodes: np.einsum("qcd,qd->qc", self.vectors[nodes], queries)
        cur = np.full(nq, self.levels[-1][0][0], dtype=np.int64)
        best = sim(cur[:, None])[:, 0]
        for members, links in reversed(self.levels[1:]):
            slot = np.full(n, -1, dtype=np.int64)
            slot[members] = np.arange(len(members))
            while True:
                near = links[slot[cur]]
                s = np.where(near >= 0, sim(np.maximum(near, 0)), -np.inf)
                j = s.argmax(axis=1)
                top = s[np.arange(nq), j]
                better = top > best
                if not better.any():
                    break
                cur = np.where(better, near[np.arange(nq), j], cur)
                best = np.where(better, top, best)
        links = self.links0
        ef = min(ef, n)
        rows = np.arange(nq)[:, None]
        beam = np.full((nq, ef), -1, dtype=np.int64)
        score = np.full((nq, ef), -np.inf, dtype=np.float32)
        done = np.ones((nq, ef), dtype=bool)
        beam[:, 0], score[:, 0], done[:, 0] = cur, best, False
        seen = np.zeros((nq, n), dtype=bool)
        seen[rows[:, 0], cur] = True
        live = np.arange(nq)
        while len(live):
            open_ = np.where(done[live], -np.inf, score[live])
            pick = np.argpartition(-open_, min(step, ef) - 1, axis=1)[:, :step] if ef > step else np.argsort(-open_, axis=1)
            good = np.take_along_axis(open_, pick, axis=1) > -np.inf
            alive = good.any(axis=1)
            live, pick, good = live[alive], pick[alive], good[alive]
            if not len(live):
                break
            nodes = np.where(good, np.take_along_axis(beam[live], pick, axis=1), -1)
            sub = done[live]
            np.put_along_axis(sub, pick, True, axis=1)
            done[live] = sub
            near = np.where(nodes[:, :, None] >= 0, links[np.maximum(nodes, 0)], -1).reshape(len(live), -1)
            near = np.sort(near, axis=1)
            fresh = (near >= 0) & ~seen[live[:, None], np.maximum(near, 0)]
            fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
            q, c = np.nonzero(fresh)
            found = near[q, c]
            seen[live[q], found] = True
            s = np.full(near.shape, -np.inf, dtype=np.float32)
            s[q, c] = np.einsum("id,id->i", self.vectors[found], queries[live[q]])
            all_s = np.concatenate([score[live], s], axis=1)
            all_n = np.concatenate([beam[live], near], axis=1)
            all_d = np.concatenate([done[live], np.zeros(near.shape, dtype=bool)], axis=1)
            top = np.argpartition(-all_s, ef - 1, axis=1)[:, :ef]
            score[live] = np.take_along_axis(all_s, top, axis=1)
            beam[live] = np.where(score[live] > -np.inf, np.take_along_axis(all_n, top, axis=1), -1)
            done[live] = np.take_along_axis(all_d, top, axis=1) | (score[live] == -np.inf)
        return beam, score

    @property
    def links0(self) -> np.ndarray:
        return self.levels[0][1]

    def nearest(self, query_ids: np.ndarray, queries: np.ndarray, k: int, ef: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For every query its ``k`` nearest rows of this shard but its own, ties by id."""
        beam, _ = self.search(queries, max(ef, k + 1))
        for i, own in enumerate(query_ids.tolist()):
            nodes = beam[i][beam[i] >= 0]
            exact = self.vectors[nodes].astype(np.float64) @ queries[i].astype(np.float64)
            counts = self.first[nodes + 1] - self.first[nodes]
            at = np.repeat(self.first[nodes] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
            ids, scores = self.ids[at], np.repeat(exact, counts)
            other = ids != own
            ids, scores = ids[other], scores[other]
            order = np.lexsort((ids, -scores))[:k]
            yield own, ids[order], scores[order]


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(id, v)``: distinct rows whose vector is not null or zero and has finite components."""
    v = F.col(vector_col).cast("array<float>")
    flat = vectors.select(F.col(id_col).cast("bigint").alias("id"), v.alias("v")).where("id is not null and v is not null")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return flat.where(~bad & F.exists("v", lambda x: x != 0)).dropDuplicates(["id", "v"])


def build_graphs(rows: DataFrame, dim: int, k: int, shard_size: int, m: int, width: int) -> DataFrame:
    """``(shard, ids, owner, vectors, nodes, links, levels)``, one row per shard."""
    order = Window.partitionBy("v").orderBy("id")
    nodes = rows.withColumn("copy", F.row_number().over(order)).where(F.col("copy") <= k + 1)
    n = nodes.where("copy = 1").count()
    shards = max(1, -(-n // shard_size))
    dealt = nodes.withColumn("shard", F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int")).withColumn("draw", F.xxhash64("v", F.lit(1)))

    def build(key, group):
        v = np.array(group["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False), dtype=np.float32).reshape(-1, dim)
        ids, draw = group["id"].to_numpy(), group["draw"].to_numpy()
        _, first, owner = np.unique(v, axis=0, return_index=True, return_inverse=True)
        owner = owner.ravel()
        by = np.lexsort((ids, owner))
        u = (draw[first].astype(np.float64) + 2.0**63) / 2.0**64
        graph = Graph.build(ids[by], owner[by], v[first], u, m, width)
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), **{c: pa.array([x], pa.binary()) for c, x in graph.pack().items()}})

    schema = "shard int, " + ", ".join(f"{c} binary" for c in PARTS)
    return dealt.select("shard", "id", "v", "draw").groupBy("shard").applyInArrow(build, schema)


def nearest_neighbours(
    vectors: DataFrame,
    is_query: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 20,
    ef: int = 128,
    m: int = 16,
    width: int = 64,
    shard_size: int = 8192,
    query_block: int = 256,
) -> DataFrame:
    """``(query_id, rank, <id_col>, score)``: up to ``k`` rows per query, nearest first.

    Queries are the rows where ``is_query``, a condition on the column ``id``, holds, candidates all rows but those with the
    query's own identifier.  Vectors that are null, zero or hold null or non-finite
    components, and null identifiers, take no part; neither do vectors of another length
    than most have (ties: the longer).  Repeated rows count once.  Ties go to smaller
    identifiers.  No usable vector or no query gives an empty result; other columns are not
    read.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col)
    size = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    schema = f"query_id bigint, rank int, {id_col} bigint, score double"
    if size is None:
        return spark.createDataFrame([], schema)
    dim = size.dim
    rows = rows.where(F.size("v") == dim)
    graphs = cut_lineage(build_graphs(rows, dim, k, shard_size, m, width))
    shards = graphs.count()
    asked = rows.where(is_query)
    blocks = max(1, -(-asked.count() // query_block))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)))

    def gather(key, group):
        v = group["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype("<f4")
        return pa.table({"ids": pa.array([group["id"].to_numpy().astype("<i8").tobytes()], pa.binary()), "vectors": pa.array([v.tobytes()], pa.binary())})

    packed = asked.groupBy("block").applyInArrow(gather, "ids binary, vectors binary")
    sent = packed.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("kind", F.lit(1))
    stream = graphs.withColumn("kind", F.lit(0)).unionByName(sent, allowMissingColumns=True)
    stream = stream.repartition(min(shards, max(shuffle_partitions(spark), 1)), "shard").sortWithinPartitions("shard", "kind")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = None
        for b in batches:
            for i in range(b.num_rows):
                row = {c: b.column(b.schema.get_field_index(c))[i].as_py() for c in [*PARTS, "kind"]}
                if row["kind"] == 0:
                    graph = Graph.unpack(row, dim)
                    continue
                ids = np.frombuffer(row["ids"], dtype="<i8")
                queries = np.frombuffer(row["vectors"], dtype="<f4").reshape(-1, dim)
                got = list(graph.nearest(ids, queries, k, ef))
                counts = [len(g[1]) for g in got]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(np.array([g[0] for g in got], dtype=np.int64), counts)),
                        pa.array(np.concatenate([g[1] for g in got])),
                        pa.array(np.concatenate([g[2] for g in got])),
                    ],
                    names=["query_id", "id", "score"],
                )

    found = stream.mapInArrow(search, "query_id bigint, id bigint, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return found.select("query_id", "rank", F.col("id").alias(id_col), "score")
