"""Near-duplicate vectors: a small-world graph per shard, every shard queried, cosine verified, components united.

Equal vectors are one class from the start. Classes are dealt into shards by a hash; each shard builds
a hierarchical navigable small-world graph once. A tile is two shards, or one with itself: the rows of each are searched for
in the graph of the other by a beam search in lockstep, and a link that either search finds counts for both ends. A query whose
whole beam still lies within the threshold is compared with all rows of the shard. In each search a sample of queries
is audited against all rows, some evenly spaced and some whose found cosines are nearest to the threshold: unless
the share of them with all their links and the recall of their nearest rows reach the target, the whole tile is computed by a blocked product,
which is exact and misses no row that the graph cuts off.

A tile keeps a count for each row and, of its links, a spanning forest; pairs pass by in pieces, so that a
dense group needs no memory for its pairs and sends none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import components, materialize, partitions, release
from corpusloom.llm.vectors import blocks, dots, norms, usable

SHARD_ROWS, SHARD_BYTES, LEAST_SHARDS = 32768, 64 << 20, 4
LOCKSTEP = 1024
DEGREE, BEAM, STRIDE = 24, 32, 4
THRESHOLD = 0.95
AUDITED, AUDITED_NEAR, AUDIT_RECALL, AUDIT_NEAREST = 48, 24, 0.995, 8
#: Cells of a piece of a product.
PRODUCT_CELLS = 1 << 21
#: Partitions of the tiles where there are more tiles than that.
MOST_PARTITIONS = 20_000
_UPPER = 16


class Graph:
    """Layers over unit rows `x` (float32): layer 0 holds all rows, each further one about a 16th of the rows below."""

    def __init__(self, x: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]], links: np.ndarray):
        self.x, self.layers, self.links = x, layers, links  # layers: (rows, neighbours as positions in rows), the top first

    @classmethod
    def build(cls, x: np.ndarray) -> Graph:
        """Rows are taken as in random order, so the first n / 16 ** l rows make layer l."""
        n = len(x)
        sizes, size = [], n // _UPPER
        while size >= 2:
            sizes.append(size)
            size //= _UPPER
        layers = []
        for size in reversed(sizes):
            part = x[:size]
            layers.append((np.arange(size), _grow(part, layers, cls)))
        return cls(x, layers, _grow(x, layers, cls))

    def entry(self, q: np.ndarray) -> np.ndarray:
        at = np.zeros(len(q), np.int64)
        for rows, links in self.layers:
            at = _descend(self.x, links, q, at, len(rows))
        return at

    def search(self, q: np.ndarray, beam: int, upto: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and cosines of the beams, best first; -1 and -inf where a beam is not full."""
        return _beam(self.x, self.links, q, self.entry(q), beam, len(self.x) if upto is None else upto)


def _descend(x, links, q, at, n):
    at = np.minimum(at, n - 1)
    best = np.einsum("bd,bd->b", q, x[at])
    going = np.arange(len(q))
    while len(going):
        near = links[at[going]]
        sims = np.einsum("bd,bkd->bk", q[going], x[np.maximum(near, 0)])
        sims[near < 0] = -np.inf
        k = sims.argmax(1)
        rows = np.arange(len(going))
        better = sims[rows, k] > best[going]
        moved = going[better]
        at[moved], best[moved] = near[rows, k][better], sims[rows, k][better]
        going = moved
    return at


def _beam(x, links, q, start, beam, n):
    out_ids, out_sims = np.full((len(q), beam), -1, np.int64), np.full((len(q), beam), -np.inf, np.float32)
    for lo in range(0, len(q), LOCKSTEP):
        part = q[lo : lo + LOCKSTEP]
        b = len(part)
        seen = np.zeros((b, n), bool)
        ids, sims, done = np.full((b, beam), -1, np.int64), np.full((b, beam), -np.inf, np.float32), np.ones((b, beam), bool)
        ids[:, 0] = start[lo : lo + b]
        sims[:, 0] = np.einsum("bd,bd->b", part, x[ids[:, 0]])
        done[:, 0] = False
        seen[np.arange(b), ids[:, 0]] = True
        going = np.arange(b)
        while len(going):
            d, i = done[going], ids[going]
            # the best STRIDE rows that have not been expanded
            rank = np.cumsum(~d, axis=1)
            take = ~d & (rank <= STRIDE)
            r, c = np.nonzero(take)
            near = np.full((len(going), STRIDE, links.shape[1]), -1, np.int64)
            near[r, rank[r, c] - 1] = links[i[r, c]]
            done[going[r], c] = True
            near = np.sort(near.reshape(len(going), -1), axis=1)
            fresh = near >= 0
            fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
            safe = np.maximum(near, 0)
            fresh &= ~seen[going[:, None], safe]
            width = int(fresh.sum(1).max()) if fresh.size else 0
            if width:
                order = np.argsort(~fresh, axis=1, kind="stable")[:, :width]
                safe, fresh = np.take_along_axis(safe, order, 1), np.take_along_axis(fresh, order, 1)
                gr, gc = np.nonzero(fresh)
                seen[going[gr], safe[gr, gc]] = True
                new = np.einsum("bd,bkd->bk", part[going], x[safe])
                new[~fresh] = -np.inf
                all_s = np.concatenate([sims[going], new], axis=1)
                all_i = np.concatenate([i, np.where(fresh, safe, -1)], axis=1)
                all_d = np.concatenate([done[going], ~fresh], axis=1)
                best = np.argsort(-all_s, axis=1, kind="stable")[:, :beam]
                ids[going], sims[going], done[going] = (np.take_along_axis(a, best, 1) for a in (all_i, all_s, all_d))
            going = going[~done[going].all(1)]
        out_ids[lo : lo + b], out_sims[lo : lo + b] = ids, sims
    return out_ids, out_sims


def _select(x, ids, sims, degree):
    """Of candidates sorted best first, up to `degree` that are nearer to the row than to any chosen one; the best others fill up."""
    b, c = ids.shape
    vectors = x[np.maximum(ids, 0)]
    among = np.einsum("bid,bjd->bij", vectors, vectors)
    chosen = np.zeros((b, c), bool)
    closest = np.full((b, c), -np.inf, np.float32)
    for k in range(c):
        ok = (ids[:, k] >= 0) & (sims[:, k] > closest[:, k]) & (chosen.sum(1) < degree)
        chosen[:, k] = ok
        closest = np.where(ok[:, None], np.maximum(closest, among[:, k]), closest)
    order = np.argsort(np.where(chosen, 0, np.where(ids >= 0, 1, 2)), axis=1, kind="stable")[:, :degree]
    out = np.take_along_axis(ids, order, 1)
    if out.shape[1] < degree:
        out = np.pad(out, ((0, 0), (0, degree - out.shape[1])), constant_values=-1)
    return out


def _candidates(ids, sims, c):
    """Best c of the candidates, each once."""
    order = np.lexsort((-sims, ids), axis=1)
    ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
    again = np.zeros(ids.shape, bool)
    again[:, 1:] = ids[:, 1:] == ids[:, :-1]
    sims = np.where(again | (ids < 0), -np.inf, sims)
    best = np.argsort(-sims, axis=1, kind="stable")[:, :c]
    sims = np.take_along_axis(sims, best, 1)
    return np.where(sims > -np.inf, np.take_along_axis(ids, best, 1), -1), sims


def _grow(x, layers, cls):
    """Neighbour lists over the rows of x, inserted in batches of at most as many rows as there are already."""
    n = len(x)
    links = np.full((n, DEGREE), -1, np.int64)
    at, wide = 0, 2 * DEGREE
    while at < n:
        end = min(n, max(64, min(2 * at, at + LOCKSTEP)))
        new = np.arange(at, end)
        sims = x[at:end] @ x[at:end].T
        np.fill_diagonal(sims, -np.inf)
        k = min(DEGREE, len(new) - 1)
        inside = np.argpartition(-sims, k - 1, axis=1)[:, :k] if k > 0 else np.zeros((len(new), 0), np.int64)
        ids, s = inside + at, np.take_along_axis(sims, inside, 1)
        if at:
            usable_layers = [(rows, l) for rows, l in layers if len(rows) <= at]
            found, fs = Graph(x, usable_layers, links).search(x[at:end], wide, at)
            ids, s = np.concatenate([found, ids], 1), np.concatenate([fs, s], 1)
        ids, s = _candidates(ids, s, wide)
        links[at:end] = _select(x, ids, s, DEGREE)
        # the reverse links; at most DEGREE new ones for a row, the nearest
        to = links[at:end].ravel()
        frm = np.repeat(new, DEGREE)
        frm, to = frm[to >= 0], to[to >= 0]
        sim = np.einsum("bd,bd->b", x[frm], x[to]).astype(np.float32)
        order = np.lexsort((-sim, to))
        frm, to, sim = frm[order], to[order], sim[order]
        first = np.searchsorted(to, to)
        rank = np.arange(len(to)) - first
        keep = rank < DEGREE
        frm, to, sim, rank = frm[keep], to[keep], sim[keep], rank[keep]
        rows, where = np.unique(to, return_inverse=True)
        for lo in range(0, len(rows), 2 * LOCKSTEP):
            part = rows[lo : lo + 2 * LOCKSTEP]
            mine = (where >= lo) & (where < lo + len(part))
            extra, es = np.full((len(part), DEGREE), -1, np.int64), np.full((len(part), DEGREE), -np.inf, np.float32)
            extra[where[mine] - lo, rank[mine]], es[where[mine] - lo, rank[mine]] = frm[mine], sim[mine]
            old = links[part]
            os_ = np.where(old >= 0, np.einsum("bd,bkd->bk", x[part], x[np.maximum(old, 0)]), -np.inf).astype(np.float32)
            ids, s = _candidates(np.concatenate([old, extra], 1), np.concatenate([os_, es], 1), wide)
            links[part] = _select(x, ids, s, DEGREE)
        at = end
    return links


class Shard:
    """Rows (doubles), their unit vectors (float32), norms, ids, sizes of their classes, and the graph over them."""

    def __init__(self, graph: Graph, x: np.ndarray, ids: np.ndarray, sizes: np.ndarray):
        self.graph, self.x, self.ids, self.sizes = graph, x, ids, sizes
        self.unit, self.norms = graph.x, norms(x)


def _slack(dim: int) -> float:
    """More than a float32 product of unit vectors can be off."""
    return max(1e-5, (dim + 8) * 6e-8)


class _Links:
    """Which of the pairs (row of a, row of b) have a cosine >= threshold in double precision."""

    def __init__(self, a, b, an, bn, threshold: float):
        self.a, self.b, self.an, self.bn, self.threshold = a, b, an, bn, threshold
        self.slack = _slack(a.shape[1])
        self.near = np.float32(threshold - self.slack)

    def verified(self, i: np.ndarray, j: np.ndarray, sims: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of pairs with their float32 cosines; those beyond doubt are not computed again."""
        keep = sims >= self.threshold + self.slack
        doubt = np.flatnonzero(~keep & (sims >= self.near))
        for at in range(0, len(doubt), 1 << 16):
            d = doubt[at : at + (1 << 16)]
            keep[d] = dots(self.a[i[d]], self.b[j[d]]) / (self.an[i[d]] * self.bn[j[d]]) >= self.threshold
        return i[keep], j[keep]


def _product(rows: np.ndarray, unit: np.ndarray, other: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The cosines of `rows` of `unit` with all rows of `other`, in pieces (rows, their matrix)."""
    step = max(1, PRODUCT_CELLS // max(1, len(other)))
    for lo in range(0, len(rows), step):
        part = rows[lo : lo + step]
        yield part, unit[part] @ other.T


def _pairs(part: np.ndarray, sims: np.ndarray, near: np.float32) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    i, j = np.nonzero(sims >= near)
    return part[i], j, sims[i, j]


class _Beams:
    """What beams find for the rows `unit` in a graph: pairs of cosine >= near, and which rows have full beams and need the product."""

    def __init__(self, graph: Graph, unit: np.ndarray, near: np.float32):
        self.ids, self.sims = graph.search(unit, BEAM)
        self.over = self.sims[:, -1] >= near
        self.i, k = np.nonzero((self.sims >= near) & ~self.over[:, None])
        self.j, self.s = self.ids[self.i, k], self.sims[self.i, k]


class _Audit:
    """True links and nearest cosines of a sample of queries, without the queries themselves, held against the beams."""

    def __init__(self, beams: _Beams, graph: Graph, x: np.ndarray, q: np.ndarray, unit: np.ndarray, near: np.float32):
        spaced = np.linspace(0, len(q) - 1, min(AUDITED, len(q))).astype(int)
        edge = np.argsort(np.abs(np.where(np.isfinite(beams.sims), beams.sims, -1) - near).min(axis=1), kind="stable")[:AUDITED_NEAR]
        at = np.unique(np.concatenate([spaced, edge]))
        sims = unit[at] @ graph.x.T
        i, j = np.nonzero(sims >= np.float32(1 - _slack(x.shape[1])))
        own = (x[j] == q[at[i]]).all(1)
        sims[i[own], j[own]] = -np.inf
        mine = set(zip(at[i[own]].tolist(), j[own].tolist(), strict=True))
        true = (sims >= near).sum(1)
        links = np.zeros(len(unit), np.int64)
        here = np.isin(beams.i, at)
        for i, j in zip(beams.i[here].tolist(), beams.j[here].tolist(), strict=True):
            links[i] += (i, j) not in mine
        links[beams.over] = np.iinfo(np.int64).max  # the product finds all
        self.true, self.found = int(true.sum()), int(np.minimum(links[at], true).sum())
        some = true > 0
        self.passes = not some.any() or (links[at] >= true)[some].mean() >= AUDIT_RECALL
        k, hit, wanted = min(AUDIT_NEAREST, len(x)), 0, 0
        nearest = -np.sort(np.partition(-sims, k - 1, axis=1)[:, :k], axis=1)
        for row, i in enumerate(at.tolist()):
            want = nearest[row][np.isfinite(nearest[row])]
            if len(want):
                other = np.array([j >= 0 and (i, j) not in mine for j in beams.ids[i].tolist()])
                wanted += len(want)
                hit += min(len(want), int((beams.sims[i][other] >= want[-1] - 1e-6).sum()))
        self.passes &= hit >= AUDIT_RECALL * wanted


def _searched(graph: Graph, x: np.ndarray, q: np.ndarray, unit: np.ndarray, near: np.float32) -> tuple[_Beams | None, tuple[int, int]]:
    """Beams for the queries if their audit passes, and the links of the audited queries: true ones and those found."""
    if BEAM * DEGREE >= len(x):
        return None, (0, 0)
    beams = _Beams(graph, unit, near)
    audit = _Audit(beams, graph, x, q, unit, near)
    return (beams, (audit.true, audit.found)) if audit.passes else (None, (audit.true, audit.true))


def links_within(graph: Graph, x: np.ndarray, q: np.ndarray, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, row) of cosine >= threshold in double precision, by beams if their audit passes, else by the product."""
    nq = norms(q)
    unit = (q / nq[:, None]).astype(np.float32)
    rule = _Links(q, x, nq, norms(x), threshold)
    beams, _ = _searched(graph, x, q, unit, rule.near)
    found = [] if beams is None else [rule.verified(beams.i, beams.j, beams.s)]
    for part, sims in _product(np.arange(len(q)) if beams is None else np.flatnonzero(beams.over), unit, graph.x):
        found.append(rule.verified(*_pairs(part, sims, rule.near)))
    return tuple(np.concatenate([f[k] for f in found] or [np.zeros(0, np.int64)]) for k in (0, 1))


def tile_links(a: Shard, b: Shard, threshold: float) -> tuple[Iterator[tuple[np.ndarray, np.ndarray]], list[int]]:
    """Links (row of a, row of b), each once, in pieces; where a is b, each as (smaller, greater). And the audited links: true ones, found ones."""
    alone = a is b
    rule = _Links(a.x, b.x, a.norms, b.norms, threshold)
    there, audited = _searched(b.graph, b.x, a.x, a.unit, rule.near)
    back = there
    if there is not None and not alone:
        back, more = _searched(a.graph, a.x, b.x, b.unit, rule.near)
        audited = (audited[0] + more[0], audited[1] + more[1])
    if there is None or back is None:
        there, audited = None, (audited[0], audited[0])

    def pieces():
        n, m = len(a.x), len(b.x)
        if there is None:
            for part, sims in _product(np.arange(n), a.unit, b.unit):
                i, j, s = _pairs(part, sims, rule.near)
                keep = i < j if alone else slice(None)
                yield rule.verified(i[keep], j[keep], s[keep])
            return
        i, j, s = np.concatenate([there.i, back.j]), np.concatenate([there.j, back.i]), np.concatenate([there.s, back.s])
        if alone:
            i, j = np.minimum(i, j), np.maximum(i, j)
        code, at = np.unique(i * m + j, return_index=True)
        i, j, s = i[at], j[at], s[at]
        covered = there.over[i] | back.over[j] | ((i == j) if alone else False)
        yield rule.verified(i[~covered], j[~covered], s[~covered])
        for part, sims in _product(np.flatnonzero(there.over), a.unit, b.unit):
            i, j, s = _pairs(part, sims, rule.near)
            if alone:
                keep = (i != j) & ~(there.over[j] & (i > j))  # two full beams meet once
                i, j, s = np.minimum(i, j)[keep], np.maximum(i, j)[keep], s[keep]
            yield rule.verified(i, j, s)
        if not alone:
            for part, sims in _product(np.flatnonzero(back.over), b.unit, a.unit):
                j, i, s = _pairs(part, sims, rule.near)
                keep = ~there.over[i]
                yield rule.verified(i[keep], j[keep], s[keep])

    return pieces(), list(audited)


def unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Puts a and b, pair by pair, into one component of `label`, where each node has its component's smallest."""
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label != label[label]).any():
            label[:] = label[label]


def _index(table: pa.Table) -> pa.Table:
    """The graph of one shard, beside its rows."""
    out = []
    for t in table.to_pylist():
        x = np.frombuffer(t["data"]).reshape(t["n"], t["dim"])
        order = np.random.default_rng(17).permutation(t["n"])
        x, ids, extra = x[order], np.frombuffer(t["ids"], np.int64)[order], np.frombuffer(t["extra"], np.int64)[order]
        graph = Graph.build((x / norms(x)[:, None]).astype(np.float32))
        upper = b"".join(l.astype(np.int32).tobytes() for _, l in graph.layers)
        sizes = np.array([len(r) for r, _ in graph.layers], np.int64).tobytes()
        out.append(t | {"ids": ids.tobytes(), "data": x.tobytes(), "extra": extra.tobytes(), "links": graph.links.astype(np.int32).tobytes(), "upper": upper, "sizes": sizes})
    return pa.Table.from_pylist(out, schema=_INDEX)


_INDEX = pa.schema([("dim", pa.int32()), ("block", pa.int32()), ("n", pa.int32()), ("ids", pa.binary()), ("data", pa.binary()), ("extra", pa.binary()), ("links", pa.binary()), ("upper", pa.binary()), ("sizes", pa.binary())])
_INDEX_DDL = "dim int, block int, n int, ids binary, data binary, extra binary, links binary, upper binary, sizes binary"


def _indexed(batches):
    for batch in batches:
        if batch.num_rows:
            yield from _index(pa.Table.from_batches([batch])).to_batches()


def _load(t: dict) -> Shard:
    x = np.frombuffer(t["data"]).reshape(t["n"], t["dim"])
    links = np.frombuffer(t["links"], np.int32).reshape(t["n"], DEGREE).astype(np.int64)
    upper, layers, at = np.frombuffer(t["upper"], np.int32).reshape(-1, DEGREE).astype(np.int64), [], 0
    for size in np.frombuffer(t["sizes"], np.int64):
        layers.append((np.arange(size), upper[at : at + size]))
        at += size
    graph = Graph((x / norms(x)[:, None]).astype(np.float32), layers, links)
    return Shard(graph, x, np.frombuffer(t["ids"], np.int64), np.frombuffer(t["extra"], np.int64))


_FOUND = "kind int, a long, b long"


def _found(a: Shard, b: Shard, threshold: float) -> pa.RecordBatch:
    """Of one tile: links a class has there (kind 0), a spanning forest (kind 1), audited links that are true and that were found (kind 2)."""
    alone, n = a is b, len(a.ids)
    ids = a.ids if alone else np.concatenate([a.ids, b.ids])
    found, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
    pieces, audited = tile_links(a, b, threshold)
    for i, j in pieces:
        np.add.at(found, i, b.sizes[j])
        other = j if alone else j + n
        np.add.at(found, other, a.sizes[i])
        unite(label, i, other)
    some, apart = np.flatnonzero(found), np.flatnonzero(label != np.arange(len(ids)))
    kind = np.concatenate([np.zeros(len(some), np.int32), np.ones(len(apart), np.int32), np.full(1, 2, np.int32)])
    left, right = np.concatenate([ids[some], ids[apart], audited[:1]]), np.concatenate([found[some], ids[label[apart]], audited[1:]])
    return pa.RecordBatch.from_arrays([pa.array(kind), pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["kind", "a", "b"])


def _search(threshold: float):
    """Tiles from rows (dim, i, j, block, index of that block) in their order: of a tile of two shards, block i comes first."""

    def run(batches):
        first = None
        for batch in batches:
            for k in range(batch.num_rows):
                (t,) = batch.slice(k, 1).to_pylist()
                shard = _load(t)
                if t["i"] == t["j"]:
                    yield _found(shard, shard, threshold)
                elif t["block"] == t["i"]:
                    first = (t["dim"], t["i"], t["j"]), shard
                elif first is not None and first[0] == (t["dim"], t["i"], t["j"]):
                    yield _found(first[1], shard, threshold)
                    first = None

    return run


def near_vectors(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD, audit: bool = False) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row; with `audit`, audited_recall too: the share of the audited queries' links that were found.

    A vector that is null, zero or holds a null or non-finite component links with nothing, as do vectors
    of different lengths with each other. Rows with the same id and vector count as links of each other; an id with several
    vectors has a row for each, with links of its own.
    A null id with a usable vector is left out of the groups: n_links 0, component_id null, kept. Other columns are ignored, whatever
    their names. An empty table gives an empty result. A shard that has no partner of its length in a tile makes no tile.
    """
    own = rows.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.when(F.col(f"`{vec_id}`").isNotNull() & usable(vector), F.col(f"`{vector}`")).alias("v"))
    classes = own.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("members"))
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "classes")  # an id may have several vectors
    total, dim = classes.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    shards = max(LEAST_SHARDS, -(-total // min(SHARD_ROWS, max(LOCKSTEP, SHARD_BYTES // (8 * (dim or 1))))))
    index = materialize(blocks(classes, "node", "v", shards, "members").repartition(shards, "dim", "block").mapInArrow(_indexed, _INDEX_DDL), "index")
    tiled = index.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    tiled = tiled.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("other")
    parts = min(2 * shards * (shards + 1), max(MOST_PARTITIONS, partitions(rows.sparkSession)))
    tiled = tiled.repartition(parts, "dim", "i", "j").sortWithinPartitions("dim", "i", "j", "block")
    found = materialize(tiled.mapInArrow(_search(threshold), _FOUND), "found")
    release(index)
    counts = found.where("kind = 0").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("others"))
    known = classes.join(counts, "node", "left").join(components(found.where("kind = 1").select("a", "b")), "node", "left")
    known = known.select("v", "rep", (F.coalesce("others", F.lit(0)) + F.col("members") - 1).alias("n"), F.coalesce("component", "node").alias("root"))
    least = known.groupBy("root").agg(F.min("rep").alias("c"))
    known = known.join(least, "root").select(F.col("v").alias("w"), "n", "c")
    joined = own.join(known, F.col("v") == F.col("w"), "left")
    component = F.when(F.col("v").isNull(), F.col("vec_id")).otherwise(F.col("c"))
    out = joined.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
    if not audit:
        return out
    true, seen = found.where("kind = 2").agg(F.coalesce(F.sum("a"), F.lit(0)), F.coalesce(F.sum("b"), F.lit(0))).first()
    return out.withColumn("audited_recall", F.lit(seen / true if true else 1.0))


def op6_hnsw(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE_HNSW = """
WITH RECURSIVE good AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
length AS (SELECT vec_id, v, sqrt(list_reduce(list_transform(v, lambda x: x * x), lambda a, b: a + b)) AS n FROM good),
links AS (
  SELECT p.vec_id AS a, q.vec_id AS b FROM length p JOIN length q ON p.vec_id <> q.vec_id AND len(p.v) = len(q.v)
  WHERE list_reduce(list_transform(list_zip(p.v, q.v), lambda z: z[1] * z[2]), lambda a, b: a + b) / (p.n * q.n) >= 0.95),
reach(vec_id, other) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, component_id = vec_id AS kept
FROM (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id) LEFT JOIN (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a) USING (vec_id)
"""
