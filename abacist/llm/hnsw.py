"""Embedding near-duplicates by navigable small-world graphs, one graph for each shard of a label."""

from __future__ import annotations

import heapq
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abacist.llm.graph import components
from abacist.session import settle

# Distinct vectors in a shard, about; bounds a task's memory (4096 * 768 doubles: 25 MB).
SHARD = 4096
# Parts of a shard that ask another shard, each in a task of its own.
PIECES = 4
LINKS, BEAM = 12, 48
# A beam this wide gives way to a scan of the shard, which is then the cheaper way.
WIDEST = 512
# Queries audited at a time and at most, and the number of true links, other than of a vector to
# itself, with which an audit is content.
AUDITED, AUDITED_MOST, LINKS_SEEN, RECALL = 128, 1024, 200, 0.99
_FOUND = "node long, n long, other long"
_SHARD_ROW = "number long, part int, shards int, graph binary"


class Graph:
    """A hierarchical navigable small-world graph over unit vectors; similarity is their product."""

    def __init__(self, vectors: np.ndarray, seed: int = 7):
        self.vectors = vectors
        n = len(vectors)
        heights = np.random.default_rng(seed).random(n)
        self.levels = np.minimum((-np.log(np.maximum(heights, 1e-12)) / math.log(LINKS)).astype(int), 8)
        top = int(self.levels.max(initial=0))
        self.near: list[dict[int, list[int]]] = [{} for _ in range(top + 1)]
        self.entry = -1
        self.seen, self.round = np.zeros(n, np.int64), 0
        for i in range(n):
            self._add(i)

    def _walk(self, query: np.ndarray, start: list[tuple[float, int]], beam: int, level: int) -> list[tuple[float, int]]:
        """The ``beam`` most similar nodes found on a level from ``start``, as (similarity, node), unordered."""
        self.round += 1
        seen, mark, near, vectors = self.seen, self.round, self.near[level], self.vectors
        for _, node in start:
            seen[node] = mark
        ahead = [(-s, v) for s, v in start]
        heapq.heapify(ahead)
        held = list(start)
        heapq.heapify(held)
        while ahead:
            s, node = heapq.heappop(ahead)
            if len(held) >= beam and -s < held[0][0]:
                break
            links = np.array(near[node], np.int64)
            links = links[seen[links] != mark]
            if not len(links):
                continue
            seen[links] = mark
            sims = vectors[links] @ query
            if len(held) >= beam:
                better = sims > held[0][0]
                links, sims = links[better], sims[better]
            for s, v in zip(sims.tolist(), links.tolist()):
                if len(held) < beam:
                    heapq.heappush(held, (s, v))
                elif s > held[0][0]:
                    heapq.heapreplace(held, (s, v))
                else:
                    continue
                heapq.heappush(ahead, (-s, v))
        return held

    def _down(self, query: np.ndarray, to: int) -> list[tuple[float, int]]:
        """The nearest node found by descending from the entry to the level above ``to``."""
        at = [(float(self.vectors[self.entry] @ query), self.entry)]
        for level in range(int(self.levels[self.entry]), to, -1):
            at = [max(self._walk(query, at, 1, level))]
        return at

    def _chosen(self, found: list[tuple[float, int]], most: int) -> list[int]:
        """Up to ``most`` of ``found``: those nearer to the node than to any chosen before, then the best of the rest."""
        found = sorted(found, reverse=True)
        nodes = np.array([v for _, v in found])
        own = self.vectors[nodes]
        between = own @ own.T
        kept, spare = [], []
        for k, (s, _) in enumerate(found):
            if len(kept) == most:
                break
            (kept if not kept or between[k, kept].max() < s else spare).append(k)
        return nodes[(kept + spare)[:most]].tolist()

    def _add(self, i: int) -> None:
        level, query = int(self.levels[i]), self.vectors[i]
        for k in range(level + 1):
            self.near[k][i] = []
        if self.entry < 0:
            self.entry = i
            return
        top = int(self.levels[self.entry])
        at = self._down(query, min(level, top))
        for k in range(min(level, top), -1, -1):
            at = self._walk(query, at, BEAM, k)
            most = LINKS * 2 if k == 0 else LINKS
            for v in self._chosen(at, LINKS):
                self.near[k][i].append(v)
                links = self.near[k][v]
                links.append(i)
                if len(links) > 2 * most:
                    sims = self.vectors[links] @ self.vectors[v]
                    self.near[k][v] = self._chosen(list(zip(sims.tolist(), links)), most)
        if level > top:
            self.entry = i

    def above(self, query: np.ndarray, threshold: float, beam: int) -> np.ndarray:
        """Nodes at ``threshold`` or more; the beam doubles while it holds nothing below it."""
        if self.entry < 0:
            return np.zeros(0, np.int64)
        at = self._down(query, 0)
        while beam < WIDEST:
            found = self._walk(query, at, beam, 0)
            if len(found) < beam or min(found)[0] < threshold:
                return np.array([v for s, v in found if s >= threshold], np.int64)
            beam *= 2
        return np.flatnonzero(self.vectors @ query >= threshold)


def audit(graph: Graph, queries: np.ndarray, low: float, own: np.ndarray | None = None) -> tuple[list, list]:
    """Some of ``queries``, and the nodes at ``low`` or more of each by comparison with every node.

    A spread of the queries, and further ones until :data:`LINKS_SEEN` true links are
    seen. ``own`` names the node that a query is itself, which is no link.
    """
    order = np.random.default_rng(11).permutation(len(queries))[:AUDITED_MOST]
    asked, true, seen = [], [], 0
    for at in range(0, len(order), AUDITED):
        for i in order[at : at + AUDITED].tolist():
            found = np.flatnonzero(graph.vectors @ queries[i] >= low)
            if own is not None:
                found = found[found != own[i]]
            asked.append(i)
            true.append(found)
            seen += len(found)
        if seen >= LINKS_SEEN:
            break
    return asked, true


def shard_links(graph: Graph, queries: np.ndarray, threshold: float, own: np.ndarray | None = None) -> list[np.ndarray]:
    """For each query the nodes at ``threshold`` or more.

    While the graph finds less than :data:`RECALL` of the links of an :func:`audit`,
    all beams widen, in the end to a scan.
    """
    # A little below, as the search counts in single precision; verified afterwards.
    low = threshold - 1e-5
    asked, true = audit(graph, queries, low, own)
    total, beam = sum(map(len, true)), BEAM
    while beam < WIDEST:
        got = [graph.above(queries[i], low, beam) for i in asked]
        if sum(len(np.intersect1d(g, t)) for g, t in zip(got, true)) >= RECALL * total:
            break
        beam *= 2
    return [graph.above(q, low, beam) for q in queries]


def _stored(frame: pd.DataFrame) -> bytes:
    """A shard: its nodes and their graph."""
    nodes, copies = frame["node"].to_numpy(), frame["copies"].to_numpy()
    exact = _unit(np.stack(frame["vector"].to_numpy()))
    graph = Graph(exact.astype(np.float32))
    return pickle.dumps((nodes, copies, exact, vars(graph)))


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _compare(shard: bytes, asking: pd.DataFrame, threshold: float, same: bool) -> pd.DataFrame:
    """Links found from ``asking`` to the vectors of ``shard``: how many each has, and enough of them to connect all."""
    ids, copies, exact, state = pickle.loads(shard)
    graph = Graph.__new__(Graph)
    vars(graph).update(state)
    ask_ids, ask_copies = asking["node"].to_numpy(), asking["copies"].to_numpy()
    asked = _unit(np.stack(asking["vector"].to_numpy()))
    own = None
    if same:
        order = np.argsort(ids)
        own = order[np.searchsorted(ids, ask_ids, sorter=order)]
    found = shard_links(graph, asked.astype(np.float32), threshold, own)
    a = np.repeat(np.arange(len(asked)), [len(f) for f in found])
    b = np.concatenate([*found, np.zeros(0, np.int64)]).astype(np.int64)
    right = np.einsum("ij,ij->i", asked[a], exact[b]) >= threshold if len(a) else np.zeros(0, bool)
    a, b = a[right], b[right]
    if same:
        # One graph: a link may be found from either end; it counts once for each.
        ends = own[a]
        pairs = np.stack([np.minimum(ends, b), np.maximum(ends, b)])[:, ends != b]
        pairs = np.unique(pairs, axis=1)
        one, two = ids[pairs[0]], ids[pairs[1]]
        one_copies, two_copies = copies[pairs[0]], copies[pairs[1]]
    else:
        one, two, one_copies, two_copies = ask_ids[a], ids[b], ask_copies[a], copies[b]
    who, at = np.unique(np.concatenate([one, two]), return_inverse=True)
    sums = np.bincount(at, np.concatenate([two_copies, one_copies]), len(who)).astype(np.int64)
    counts = pd.DataFrame({"node": who, "n": sums, "other": None})
    links = pd.DataFrame(_forest(list(zip(one.tolist(), two.tolist()))), columns=["node", "other"]).assign(n=0)
    parts = [p.astype("Int64") for p in (counts, links[["node", "n", "other"]]) if len(p)]
    return pd.concat(parts) if parts else _nothing()


def _nothing() -> pd.DataFrame:
    return pd.DataFrame(columns=["node", "n", "other"]).astype("Int64")


def _forest(links: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """As few of ``links`` as connect the same vectors."""
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = root[up]
            x = root[x]
        return x

    kept = []
    for a, b in links:
        x, y = top(a), top(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            kept.append((a, b))
    return kept


def _with_vectors(vectors: DataFrame) -> DataFrame:
    """``vec_id, label, vector, size, usable`` of every row: the vector in double precision, and whether it can link."""
    rows = vectors.select(
        F.col("vec_id").cast("long"), "label", F.col("embedding").cast("array<double>").alias("vector")
    )
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = (
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite & F.exists("vector", lambda x: x != 0)
    )
    return rows.select("*", F.size("vector").alias("size"), F.coalesce(usable, F.lit(False)).alias("usable"))


def near_links(vectors: DataFrame, threshold: float, shard: int) -> DataFrame:
    """``node, n, other``: numbers of links of nodes, and rows with ``other`` for links that connect them.

    ``vectors`` has ``label, size, node, copies, vector``. The graph of each shard is
    built once and stored; then its own and all later shards of the label ask it.
    """
    shards = F.ceil(F.count(F.lit(1)) / shard).cast("int").alias("shards")
    sizes = vectors.groupBy("label", "size").agg(shards).withColumn("number", F.monotonically_increasing_id())
    dealt = vectors.join(settle(sizes, "vector-labels"), ["label", "size"])
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("node"), "shards").cast("int"))
    dealt = dealt.select("number", "part", "shards", "node", "copies", "vector")

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"number": [key[0]], "part": [key[1]], "shards": [rows["shards"].iat[0]], "graph": [_stored(rows)]})

    graphs = settle(dealt.groupBy("number", "part").applyInPandas(build, _SHARD_ROW), "vector-graphs")
    # A shard asks itself as a whole, so a link found from either end is counted once.
    pieces = F.when(F.col("asks") == F.col("part"), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(PIECES - 1)))
    held = graphs.withColumn("asks", F.explode(F.sequence("part", F.col("shards") - 1)))
    held = held.withColumn("piece", F.explode(pieces)).drop("shards")
    asking = dealt.withColumnRenamed("part", "asks").withColumn("part", F.explode(F.sequence(F.lit(0), "asks")))
    own = F.when(F.col("asks") == F.col("part"), 0).otherwise(F.pmod(F.xxhash64("node", F.lit(1)), F.lit(PIECES)))
    asking = asking.withColumn("piece", own.cast("int")).drop("shards")
    key = ["number", "part", "asks", "piece"]

    def run(group: tuple, shard: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if shard.empty or rows.empty:
            return _nothing()
        return _compare(shard["graph"].iat[0], rows, threshold, same=int(group[1]) == int(group[2]))

    return held.groupBy(*key).cogroup(asking.groupBy(*key)).applyInPandas(run, _FOUND)


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, shard: int = SHARD) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors (vec_id, embedding, label)``.

    Two vectors link when their labels are equal and not NULL and their cosine, in
    double precision, is at least ``threshold``; links come from the graphs, and
    each is verified. Copies of one vector under one label are one node that counts as many.
    A vector that is NULL, zero, or holds a NULL or non-finite number links with
    nothing; neither does one whose length differs from the others of its label.
    A row without ``vec_id`` is returned unlinked, with NULL component. Rows that
    repeat an id are vectors of their own, each with the links of its own label and
    vector, whatever the others are; with the same label and vector they are copies.
    """
    rows = _with_vectors(vectors)
    # Copies fold before anything is compared; a node has a number of its own, as ids may repeat.
    per_class = rows.filter("usable").groupBy("label", "size", "vector")
    classes = per_class.agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("copies"))
    classes = settle(classes.withColumn("node", F.monotonically_increasing_id()), "vector-classes")
    found = settle(near_links(classes, threshold, shard), "vector-links")
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    links = found.filter("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b"))
    parts = components(links)
    least = parts.join(classes.select("node", "vec_id"), "node").groupBy("component").agg(F.min("vec_id").alias("least"))
    named = parts.join(least, "component").select("node", "least")
    nodes = classes.join(counts, "node", "left").join(named, "node", "left").select(
        "label",
        "size",
        "vector",
        (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("least", "vec_id").alias("component_id"),
    )
    linked = rows.filter("usable").join(nodes, ["label", "size", "vector"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter("not usable").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    both = linked.union(alone)
    return both.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
