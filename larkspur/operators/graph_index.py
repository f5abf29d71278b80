"""Approximate nearest neighbours by navigable small-world graphs, one for each part of the vectors.

Vectors are dealt to parts of a bounded size by hash. A task builds its part's graph, which is stored as rows of nodes
and their links, so an index is a table that is written once and read by any number of searches. A search takes its
stated queries to every part, walks each graph, and merges the parts' best; more vectors are more parts, never larger ones.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.operators.ranking import _matrix, in_blocks, top_k

#: Vectors of a part on average; links of a node on the upper levels (twice as many on the lowest); nodes kept open while
#: a graph is built and while it is searched.
PART, LINKS, BUILD, SEARCH = 50_000, 32, 100, 64
NODE = "part int, i long, iv array<double>, level int, links array<array<int>>"
FOUND = "q long, part int, i long, score double, visited long"


class Graph:
    """A hierarchy of links over unit vectors; nearness is the inner product. links[level][node] are places in vectors."""

    def __init__(self, vectors: np.ndarray, levels: np.ndarray, links: list[dict[int, list[int]]] | None = None, most: int = LINKS, build: int = BUILD):
        self.vectors, self.levels, self.most = vectors, levels, most
        self.visited = 0
        self.top = int(levels.argmax()) if len(levels) else -1
        self.links = links or [{} for _ in range(int(levels.max(initial=0)) + 1)]
        if links is None:
            self.top = -1
            for node in range(len(vectors)):
                self._insert(node, build)

    def _near(self, q: np.ndarray, nodes: list[int]) -> list[float]:
        self.visited += len(nodes)
        return (self.vectors[nodes] @ q).tolist()

    def _walk(self, q: np.ndarray, start: list[tuple[float, int]], keep: int, level: int) -> list[tuple[float, int]]:
        """The `keep` nearest nodes that a walk over a level finds, nearest first: the nearest open node is expanded until
        it is farther than all that are kept."""
        seen = {n for _, n in start}
        todo = [(-s, n) for s, n in start]
        best = list(start)
        heapq.heapify(todo)
        heapq.heapify(best)
        links = self.links[level]
        while todo:
            s, node = heapq.heappop(todo)
            if len(best) >= keep and -s < best[0][0]:
                break
            fresh = [n for n in links[node] if n not in seen]
            if not fresh:
                continue
            seen.update(fresh)
            for score, n in zip(self._near(q, fresh), fresh, strict=True):
                if len(best) < keep or score > best[0][0]:
                    heapq.heappush(todo, (-score, n))
                    heapq.heappush(best, (score, n))
                    if len(best) > keep:
                        heapq.heappop(best)
        return sorted(best, key=lambda x: (-x[0], x[1]))

    def _spread(self, found: list[tuple[float, int]], most: int) -> list[int]:
        """Of nodes, nearest first, those that are nearer to the new one than to any chosen before; then the nearest others."""
        chosen: list[int] = []
        rest: list[int] = []
        for score, n in found:
            if len(chosen) == most:
                break
            near = chosen and float((self.vectors[chosen] @ self.vectors[n]).max()) > score
            (rest if near else chosen).append(n)
        return chosen + rest[: most - len(chosen)]

    def _insert(self, node: int, build: int) -> None:
        level, q = int(self.levels[node]), self.vectors[node]
        for at in range(level + 1):
            self.links[at][node] = []
        if self.top < 0:
            self.top = node
            return
        start = self._descend(q, level)
        for at in range(min(level, int(self.levels[self.top])), -1, -1):
            start = self._walk(q, start, build, at)
            most = self.most * (2 if at == 0 else 1)
            self.links[at][node] = self._spread(start, self.most)
            for other in self.links[at][node]:
                held = self.links[at][other]
                held.append(node)
                if len(held) > most:
                    scores = (self.vectors[held] @ self.vectors[other]).tolist()
                    self.links[at][other] = self._spread(sorted(zip(scores, held, strict=True), key=lambda x: (-x[0], x[1])), most)
        if level > self.levels[self.top]:
            self.top = node

    def _descend(self, q: np.ndarray, level: int) -> list[tuple[float, int]]:
        start = [(self._near(q, [self.top])[0], self.top)]
        for at in range(int(self.levels[self.top]), level, -1):
            start = self._walk(q, start, 1, at)
        return start

    def search(self, q: np.ndarray, k: int, keep: int) -> list[tuple[float, int]]:
        if self.top < 0:
            return []
        return self._walk(q, self._descend(q, 0), max(keep, k), 0)[:k]


def build_graphs(items: DataFrame, links: int = LINKS, build: int = BUILD, part: int = PART) -> DataFrame:
    """The index of vectors (i, iv): a row a node (NODE). A node's highest level comes from a hash of its id, so a part's
    graph is the same whenever it is built. Zero vectors are nodes too; links are places in the part's order of ids."""
    parts = max(1, -(-items.count() // part))
    height = F.floor(-F.log((F.pmod(F.xxhash64("i", F.lit(1)), F.lit(1 << 40)) + 1) / float(1 << 40)) / float(np.log(max(links, 2)))).cast("int")
    rows = items.select(F.pmod(F.xxhash64("i"), F.lit(parts)).cast("int").alias("part"), F.col("i").cast("long").alias("i"), "iv", height.alias("level"))

    def built(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by("i")
        graph = Graph(_matrix(t["iv"], True), t["level"].to_numpy(), None, links, build)
        held = [[graph.links[at][n] for at in range(int(level) + 1)] for n, level in enumerate(graph.levels)]
        return pa.table([t["part"], t["i"], t["iv"], t["level"], pa.array(held, pa.list_(pa.list_(pa.int32())))], ["part", "i", "iv", "level", "links"])

    return rows.groupBy("part").applyInArrow(built, NODE)


def _loaded(t: pa.Table) -> tuple[np.ndarray, Graph]:
    t = t.sort_by("i")
    levels, every = t["level"].to_numpy(), t["links"].to_pylist()
    links: list[dict[int, list[int]]] = [{} for _ in range(int(levels.max()) + 1)]
    for n, own in enumerate(every):
        for at, x in enumerate(own):
            links[at][n] = x
    return t["i"].to_numpy(), Graph(_matrix(t["iv"], True), levels, links)


def _searched(index: DataFrame, k: int, keep: int) -> Callable[[np.ndarray, np.ndarray], DataFrame]:
    def run(ids: np.ndarray, matrix: np.ndarray) -> DataFrame:
        def search(key: tuple, t: pa.Table) -> pa.Table:
            items, graph = _loaded(t)
            q, i, score, visited = [], [], [], []
            for a, v in zip(ids.tolist(), matrix, strict=True):
                graph.visited = 0
                for s, n in graph.search(v, k, keep):
                    q.append(a)
                    i.append(int(items[n]))
                    score.append(round(s, 9))
                visited += [graph.visited] * (len(q) - len(visited))
            part = pa.array(np.full(len(q), key[0].as_py(), np.int32))
            return pa.table([pa.array(q, pa.int64()), part, pa.array(i, pa.int64()), pa.array(score, pa.float64()), pa.array(visited, pa.int64())], ["q", "part", "i", "score", "visited"])

        return index.groupBy("part").applyInArrow(search, FOUND)

    return run


def search_graphs(queries: DataFrame, index: DataFrame, k: int, keep: int = SEARCH, exclude_self: bool = True, block: int = 4096) -> DataFrame:
    """(q, i, score, rank, visited): near neighbours by cosine of stated queries (q, qv) in an index of build_graphs();
    visited counts the vectors that the query was compared with in all parts."""
    found = in_blocks(queries, block, _searched(index, k + exclude_self, keep), FOUND, unit=True)
    seen = found.groupBy("q", "part").agg(F.first("visited").alias("visited")).groupBy("q").agg(F.sum("visited").alias("visited"))
    best = top_k((found.where("q <> i") if exclude_self else found).select("q", "i", "score"), ["q"], "score", k, "i")
    return best.join(seen, "q").select("q", "i", "score", "rank", "visited")
