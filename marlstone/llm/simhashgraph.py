"""Near-duplicate groups: SimHash, an exact join of sketches by their rarest slots, verified edges, union.

1. Each text gets a 128-bit SimHash of its words (a word weighs the root of its count) and a 128-slot one-permutation
   MinHash sketch of its word bigrams.
2. Texts with equal words are one node: exact copies join their first document without any search.
3. Two nodes are linked if their codes are within the radius and their sketches are similar enough. Of similar sketches
   each has more than a share of its filled slots in common with the other, so both have an equal slot among their
   rarest ones (prefix filter). Each node goes with its code to the shards of these slots, where it meets only nodes of
   an equal slot: no link is lost, and a node is not sent to every shard.
4. Nodes of an equal slot that are within the radius of each other are candidates. If they are many, they are a crowd:
   there each node is a candidate of one that stands for it, and the crowd is kept. Candidates are verified by the
   sketches' Jaccard similarity and united; then the pairs of each crowd that are not united yet are verified too, block
   by block, where the sketches are sent to, and only links come back.
5. ``candidate_edges`` is the approximate way by navigable small-world graphs over Hamming distance (``SmallWorld``): every
   node is a query in every shard, beams are audited against an exact scan, and crowds are scanned whole, which is
   quadratic. The operator does not use it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from marlstone.llm.common import NONWORD, U64, Grams, buffers, durable, fresh, lean, mix, plain, quoted, row_of, slices, word_hashes, word_spans

RADIUS, SIMILARITY = 22, 0.5
SHARDS, SHARD_POINTS = 8, 500_000
LINKS, ROOM, TREE, BEAM, ENTRIES = 8, 12, 6, 12, 512
ORDERS, SIDE, GATES = 16, 24, 128  # sorted orders of the codes, neighbours that each gives a query to start at, entries it tries besides
AUDIT, AUDIT_PAIRS, RECALL = 16_384, 500, 0.96  # queries scanned at most and pairs wanted, of own and of foreign queries each
SLOTS, EMPTY = 128, 0xFFFF
LAST, NODE = np.uint32(0xFFFFFFFF), np.uint32(0x7FFFFF)
MOST_POINTS = (1 << 23) - 1  # of one graph; its keys have no more bits for a node
RANKED = 60_000  # nodes whose slots are counted to tell rare from common ones; any order gives the same links
SHARD_SLOTS = 500_000  # slots of nodes that a shard of the join holds on average
CROWD = 4  # pairs within the radius for each node, from which nodes of an equal slot are a crowd
BLOCK = 2048  # nodes of a crowd that meet those of another block in one task
ENTRY = np.dtype([("slot", np.uint32), ("node", np.int64), ("code", np.uint64, 2)])
SIGNATURES = "node bigint, doc_id bigint, hi bigint, lo bigint, th bigint, sketch binary"


BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1) * 2.0 - 1.0


def simhashes(hashes: np.ndarray, weights: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """128-bit SimHashes (rows x 2) of weighted features: for each byte of a hash, the weights by its value."""
    total = np.zeros((rows, 128))
    for half, part in enumerate((hashes, mix(hashes ^ U64(0x2545F4914F6CDD1D)))):
        octets = part.view(np.uint8).reshape(-1, 8)
        for k in range(8):
            by_value = np.bincount(row * 256 + octets[:, k], weights, minlength=rows * 256).reshape(rows, 256)
            total[:, 64 * half + 8 * k : 64 * half + 8 * k + 8] = by_value @ BITS
    return np.packbits(total > 0, axis=1).view(np.uint64)


def signatures(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """By row: number of words, SimHash of the words (weight: root of the count), a hash of all words in order, and the
    sketch of the word bigrams (rows x SLOTS)."""
    starts, ends, woff = word_spans(raw, off, NONWORD)
    words = word_hashes(raw, starts, ends)
    grams = Grams(words)
    n = np.diff(woff)
    row = row_of(woff)
    order = np.argsort(mix(words + row.astype(np.uint64) * U64(0x9E3779B97F4A7C15)))  # brings a row's equal words together
    r, w = row[order], words[order]
    first = np.flatnonzero(np.concatenate([[True], (w[1:] != w[:-1]) | (r[1:] != r[:-1])])) if len(w) else order
    times = np.diff(np.concatenate([first, [len(w)]]))
    codes = simhashes(w[first], np.sqrt(times), r[first], len(n))
    feats = np.maximum(n - 1, np.minimum(n, 1))  # bigrams, or the one word
    foff = np.concatenate([[0], np.cumsum(feats)])
    row = np.repeat(np.arange(len(n)), feats)
    at = np.arange(foff[-1]) - foff[row] + woff[row]
    h = grams.at(at, np.where(n[row] == 1, 1, 2))
    sketch = np.full((len(n), SLOTS), EMPTY, np.uint16)
    value = np.minimum((h >> U64(40)) & U64(0xFFFF), U64(EMPTY - 1)).astype(np.uint16)
    np.minimum.at(sketch.ravel(), row * SLOTS + (h & U64(SLOTS - 1)).astype(np.int64), value)
    whole = np.zeros(len(n), np.int64)
    some = np.flatnonzero(n)
    whole[some] = grams.at(woff[:-1][some], n[some]).view(np.int64)
    return n, codes[:, 0].view(np.int64), codes[:, 1].view(np.int64), whole, sketch


def jaccard(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarity of sketches, row by row."""
    filled = (a != EMPTY) | (b != EMPTY)
    return ((a == b) & filled).sum(axis=1) / np.maximum(filled.sum(axis=1), 1)


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of codes, whose last axis holds the two halves."""
    c = np.bitwise_count(a ^ b)
    return (c[..., 0] + c[..., 1]).astype(np.uint32)


class SmallWorld:
    """A navigable small-world graph over distinct 128-bit codes, built and searched for many codes at a time.

    A key is distance << 24 | node << 1 | open; sorting keys sorts by distance, and puts a node that was expanded
    before the same node found again. A graph holds at most ``MOST_POINTS`` nodes.
    """

    def __init__(self, codes: np.ndarray):
        if len(codes) > MOST_POINTS:
            raise ValueError(f"{len(codes)} points in one graph; the most is {MOST_POINTS}")
        order = np.argsort(mix(codes[:, 0] ^ (codes[:, 1] << U64(1))), kind="stable")  # a random order gives long links
        self.codes, self.names = np.ascontiguousarray(codes[order]), order
        self.n = len(codes)
        self.links = np.full((self.n, LINKS + ROOM + TREE), -1, np.int32)  # own links, reverse links, links to children
        self.children = np.zeros(self.n, np.int64)
        self.near = np.full((self.n, ROOM), 255, np.uint8)  # distance of each reverse link
        self.orphans: list[int] = []  # nodes for which no parent had room; they are entries
        done = min(self.n, ENTRIES)
        self._insert(np.arange(done), 0)
        while done < self.n:
            new = np.arange(done, min(self.n, done + min(2048, done // 2)))
            self._insert(new, done)
            done = int(new[-1]) + 1
        self.orders = []  # (sorted windows, nodes)
        for w in self._windows(self.codes):
            by = np.argsort(w, kind="stable")
            self.orders.append((w[by], by.astype(np.int32)))

    @staticmethod
    def _windows(codes: np.ndarray) -> Iterator[np.ndarray]:
        """64 bits of each code from ``ORDERS`` places on, around the end. Codes that differ little often share the
        leading bits of some window, and then stand close to each other when sorted by it."""
        for k in range(ORDERS):
            a, b = (codes[:, 0], codes[:, 1]) if k < ORDERS // 2 else (codes[:, 1], codes[:, 0])
            shift = U64(128 // ORDERS * (k % (ORDERS // 2)))
            yield (a << shift) | (b >> (U64(64) - shift)) if shift else a

    def _starts(self, queries: np.ndarray) -> np.ndarray:
        """Keys of the nodes next to each query in the sorted orders, each once."""
        found = np.empty((len(queries), ORDERS, 2 * SIDE), np.int32)
        for k, (w, (listed, nodes)) in enumerate(zip(self._windows(queries), self.orders, strict=True)):
            at = np.searchsorted(listed, w)[:, None] + np.arange(-SIDE, SIDE)
            found[:, k] = nodes[np.clip(at, 0, self.n - 1)]
        found = np.sort(found.reshape(len(queries), -1), axis=1)
        keys = hamming(self.codes[found], queries[:, None]) << np.uint32(24) | found.astype(np.uint32) << np.uint32(1) | np.uint32(1)
        keys[:, 1:][found[:, 1:] == found[:, :-1]] = LAST
        return keys

    def _insert(self, new: np.ndarray, done: int) -> None:
        own = self.codes[new]
        keys = np.empty((len(new), min(LINKS, len(new))), np.uint32)
        for i in range(0, len(new), 256):
            block = hamming(own[i : i + 256, None], own[None]) << np.uint32(24) | new.astype(np.uint32)[None] << np.uint32(1)
            block[np.arange(len(block)), np.arange(i, i + len(block))] = LAST
            keys[i : i + 256] = np.partition(block, keys.shape[1] - 1, axis=1)[:, : keys.shape[1]]
        if done:
            walked = self._walk(own, BEAM, done)
            keys = np.concatenate([keys, np.where(walked == LAST, LAST, walked & ~np.uint32(1))], axis=1)
        keys = np.sort(keys, axis=1)
        if done:
            self._adopt(new, np.where(keys != LAST, keys >> 1 & NODE, self.n).astype(np.int64))
        keys = keys[:, :LINKS]
        there = keys != LAST
        node = np.where(there, keys >> 1 & NODE, 0).astype(np.int64)
        self.links[new, : node.shape[1]] = np.where(there, node, -1)
        self._reverse(node[there], np.repeat(new, there.sum(axis=1)), (keys[there] >> 24).astype(np.int64))

    def _adopt(self, new: np.ndarray, near: np.ndarray) -> None:
        """Gives each new node a parent: the nearest older node with room. These links are never dropped, so every node
        can be reached from the entries, and a crowd of close nodes cannot become an island."""
        left = np.arange(len(new))
        for k in range(near.shape[1]):
            older = near[left, k] < new[left]
            own, rest = left[older], left[~older]
            parent = near[own, k]
            order = np.argsort(parent, kind="stable")
            own, parent = own[order], parent[order]
            start = np.flatnonzero(np.concatenate([[True], parent[1:] != parent[:-1]])) if len(own) else own
            slot = self.children[parent] + np.arange(len(own)) - np.repeat(start, np.diff(np.concatenate([start, [len(own)]])))
            ok = slot < TREE
            self.links[parent[ok], LINKS + ROOM + slot[ok]] = new[own[ok]]
            np.add.at(self.children, parent[ok], 1)
            left = np.sort(np.concatenate([own[~ok], rest]))
            if not len(left):
                return
        self.orphans += new[left].tolist()

    def _reverse(self, at: np.ndarray, to: np.ndarray, distance: np.ndarray) -> None:
        """Adds links at -> to; where there is no room, the nearest stay."""
        order = np.lexsort((distance, at))
        at, to, distance = at[order], to[order], distance[order]
        start = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else at
        rank = np.arange(len(at)) - np.repeat(start, np.diff(np.concatenate([start, [len(at)]])))
        some = rank < ROOM
        at, to, distance, rank = at[some], to[some], distance[some], rank[some]
        nodes, slot = np.unique(at, return_inverse=True)
        d = np.concatenate([self.near[nodes].astype(np.int64), np.full((len(nodes), ROOM), 255)], axis=1)
        t = np.concatenate([self.links[nodes, LINKS : LINKS + ROOM], np.full((len(nodes), ROOM), -1, np.int32)], axis=1)
        d[slot, ROOM + rank], t[slot, ROOM + rank] = distance, to
        best = np.argsort(d, axis=1, kind="stable")[:, :ROOM]
        self.near[nodes] = np.take_along_axis(d, best, axis=1).astype(np.uint8)
        self.links[nodes, LINKS : LINKS + ROOM] = np.take_along_axis(t, best, axis=1)

    def _walk(self, queries: np.ndarray, beam: int, n: int, started: bool = False) -> np.ndarray:
        """Keys of the ``beam`` nearest nodes found among the first n, by query; ``started`` from the sorted orders too."""
        out = np.empty((len(queries), beam), np.uint32)
        gates = min(n, GATES if started else ENTRIES)
        entries = np.array([*range(gates), *(o for o in self.orphans if o >= gates)], np.int64)
        gates, names = self.codes[entries][None], entries.astype(np.uint32) << np.uint32(1) | np.uint32(1)
        wide, at_once = beam + 8, max(3, beam // 6)
        for i in range(0, len(queries), 256):
            q = queries[i : i + 256, None]
            keys = np.full((len(q), wide), LAST, np.uint32)
            first = hamming(gates, q) << np.uint32(24) | names
            if started:
                first = np.concatenate([first, self._starts(queries[i : i + 256])], axis=1)
                first.sort(axis=1)
                first[:, 1:][first[:, 1:] == first[:, :-1]] = LAST
            first = np.sort(np.partition(first, beam, axis=1)[:, :beam] if first.shape[1] > beam else first, axis=1)
            keys[:, : first.shape[1]] = first
            active = np.arange(len(q))
            own, mine = keys, q
            while True:
                fresh = own[:, :beam] & 1 == 1
                fresh &= own[:, :beam] != LAST
                order = np.cumsum(fresh, axis=1, dtype=np.int32)
                fresh &= order <= at_once
                busy = order[:, -1] > 0
                if not busy.all():
                    keys[active[~busy]] = own[~busy]
                    active, own, mine, fresh, order = active[busy], own[busy], mine[busy], fresh[busy], order[busy]
                    if not len(active):
                        break
                r, c = np.nonzero(fresh)
                picked = own[r, c]
                own[r, c] = picked & ~np.uint32(1)
                grid = np.full((len(own), at_once, self.links.shape[1]), -1, np.int32)
                grid[r, order[r, c] - 1] = self.links[(picked >> 1 & NODE).astype(np.int64)]
                grid = grid.reshape(len(own), -1)
                found = hamming(self.codes[grid], mine) << np.uint32(24) | grid.astype(np.uint32) << np.uint32(1) | np.uint32(1)
                found[(grid < 0) | (found >= own[:, beam - 1 : beam])] = LAST
                both = np.concatenate([own, found], axis=1)
                both.sort(axis=1)
                both = both[:, : 2 * wide]
                both[:, 1:][both[:, 1:] >> 1 == both[:, :-1] >> 1] = LAST
                both.sort(axis=1)
                own = both[:, :wide].copy()
            out[i : i + 256] = keys[:, :beam]
        return out

    def search(self, queries: np.ndarray, beam: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """All pairs (query, code) found within the radius. A query that meets BEAM matches stands in a crowd, whose
        parts may not be linked to each other: it is compared with all codes."""
        if not self.n or not len(queries):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        beam = min(beam, self.n)
        keys = self._walk(queries, beam, self.n, started=True)
        near = keys >> 24 <= radius
        full = (near.sum(axis=1) >= min(BEAM, beam)) & (beam < self.n)
        r, c = np.nonzero(near & ~full[:, None])
        qs, ps = [r], [(keys[r, c] >> 1 & NODE).astype(np.int64)]
        crowd = np.flatnonzero(full)
        for i in range(0, len(crowd), 32):
            for j in range(0, self.n, 1 << 15):
                q, p = np.nonzero(hamming(self.codes[None, j : j + (1 << 15)], queries[crowd[i : i + 32], None]) <= radius)
                qs.append(crowd[i + q])
                ps.append(p + j)
        return np.concatenate(qs), self.names[np.concatenate(ps)]

    def exact(self, queries: np.ndarray, radius: int) -> set[tuple[int, int]]:
        """The same pairs by a scan of all codes."""
        return {(q, int(self.names[p])) for q in range(len(queries)) for p in np.flatnonzero(hamming(self.codes, queries[q]) <= radius)}

    def truth(self, queries: np.ndarray, radius: int, pairs: int, most: int) -> list[tuple[np.ndarray, set[tuple[int, int]]]]:
        """Queries of the audit and their matches by an exact scan, themselves left out: those with fewer than BEAM
        matches, and those in crowds.

        Queries without a match do not count. The scan, in the order given, stops with the block that brings ``pairs``
        pairs of the first kind, or after ``most`` queries; crowds are taken up to about as many pairs.
        """
        kept, found = ([], []), (set(), set())
        for i in range(0, min(len(queries), most), 256):
            for k in range(i, min(i + 256, len(queries), most)):
                d = hamming(self.codes, queries[k])
                near = np.flatnonzero(d <= radius)
                kind = int(len(near) >= BEAM)
                near = near[d[near] > 0]
                if len(near) and not (kind and len(found[1]) >= pairs):
                    found[kind].update((len(kept[kind]), int(self.names[p])) for p in near)
                    kept[kind].append(k)
            if len(found[0]) >= pairs:
                break
        return [(queries[k], f) for k, f in zip(kept, found)]

    def audited_beam(self, samples: list[np.ndarray], radius: int, beam: int | None = None, target: float | None = None) -> tuple[int, float]:
        """The least doubling of ``beam`` whose recall reaches the target for small groups and for crowds in each sample
        of queries, and the least recall.

        A recall is the mean over queries of the share of their matches found, so every query counts alike. If no query
        of a kind has a match among those scanned, that kind says nothing.
        """
        beam, target = beam or BEAM, target or RECALL
        audits = [x for q in samples for x in self.truth(q, radius, AUDIT_PAIRS, AUDIT) if x[1]]
        while True:
            recall = 1.0
            for queries, truth in audits:
                hits = truth & set(zip(*(x.tolist() for x in self.search(queries, beam, radius))))
                of, got = (np.bincount([q for q, _ in pairs], minlength=len(queries)) for pairs in (truth, hits))
                recall = min(recall, float((got / of).mean()))
            if recall >= target or beam >= self.n:
                return beam, recall
            beam *= 2


class Union:
    """Union of the numbers 0..n-1; the least number stands for a part."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while (p := up[root]) != root:
            root = p
        while x != root:
            up[x], x = root, up[x]
        return int(root)

    def roots(self, x: np.ndarray) -> np.ndarray:
        """What stands for the part of each number; paths are shortened on the way."""
        out = self.up[x]
        while True:
            above = self.up[out]
            if (above == out).all():
                self.up[x] = out
                return out
            out = above

    def join(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Unions a[i] and b[i]; the i at which two parts became one, each of which stands for all its equals."""
        ra, rb = self.roots(a), self.roots(b)
        apart = np.flatnonzero(ra != rb)
        _, first = np.unique(ra[apart] * len(self.up) + rb[apart], return_index=True)
        out = []
        for i in apart[first].tolist():
            x, y = self.find(int(ra[i])), self.find(int(rb[i]))
            if x != y:
                self.up[max(x, y)] = min(x, y)
                out.append(i)
        return np.array(out, np.int64)


def verified(q: np.ndarray, p: np.ndarray, part: np.ndarray, a: np.ndarray, b: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """For each query and each part that has points it met, a pair whose sketches (of ``a`` and ``b``) are similar enough,
    if there is one: more pairs of the same part would connect nothing else. In order of q.

    Pairs of a query and part are looked at one by one, then two, then four at a time, until one is found.
    """
    order = np.lexsort((part, q))
    q, p, part = q[order], p[order], part[order]
    start = np.flatnonzero(np.concatenate([[True], (q[1:] != q[:-1]) | (part[1:] != part[:-1])])) if len(q) else q
    size = np.diff(np.concatenate([start, [len(q)]]))
    found = np.full(len(start), -1)
    done, width, left = 0, 1, np.arange(len(start))
    while len(left):
        n = np.minimum(size[left] - done, width)
        group = np.repeat(left, n)
        at = start[group] + done + np.arange(len(group)) - np.repeat(np.cumsum(n) - n, n)
        good = np.concatenate([jaccard(a[q[x]], b[p[x]]) >= similarity for x in np.split(at, range(1 << 16, len(at), 1 << 16))])
        found[group[good][::-1]] = at[good][::-1]
        done, width = done + width, 2 * width
        left = left[(found[left] < 0) & (size[left] > done)]
    found = found[found >= 0]
    return q[found], p[found]


def _sign(batches):
    for batch in batches:
        for part in slices(batch, limit=3 << 20):
            n, hi, lo, th, sketch = signatures(*buffers(pc.utf8_lower(part.column("text"))))
            some = pa.array(n > 0)
            out = pa.RecordBatch.from_arrays(
                [part.column("node"), part.column("doc_id"), pa.array(hi), pa.array(lo), pa.array(th), pa.array([r.tobytes() for r in sketch], pa.binary())],
                names=["node", "doc_id", "hi", "lo", "th", "sketch"],
            )
            yield out.filter(some)


def _shard(radius: int, similarity: float):
    def work(batches):
        points: list[pa.RecordBatch] = []
        held: list[pa.RecordBatch] = []  # the first queries of other shards, which wait for the audit
        graph, beam = None, BEAM

        def columns(part):
            codes = np.stack([part.column(c).to_numpy() for c in ("hi", "lo")], axis=1).view(np.uint64)
            sketch = np.frombuffer(b"".join(part.column("sketch").to_pylist()), np.uint16).reshape(-1, SLOTS)
            return codes, sketch, part.column("node").to_numpy()

        def build():
            nonlocal graph, beam, sketches, ids, first, count, by_code, parts
            codes, sketches, ids = columns(pa.Table.from_batches(points))
            by_code = np.lexsort((ids, codes[:, 1], codes[:, 0]))
            new = np.concatenate([[True], (codes[by_code][1:] != codes[by_code][:-1]).any(axis=1)])
            first = np.flatnonzero(new)
            count = np.diff(np.concatenate([first, [len(ids)]]))
            graph, parts = SmallWorld(codes[by_code][first]), Union(len(ids))
            own = graph.codes[np.argsort(mix(graph.codes[:, 0] + U64(17)))[:AUDIT]]
            foreign = np.concatenate([columns(r)[0] for r in held] or [own[:0]])
            foreign = foreign[np.argsort(mix(foreign[:, 0] + U64(17)), kind="stable")]
            beam, _ = graph.audited_beam([own, foreign], radius)

        def ask(part):
            codes, sketch, node = columns(part)
            for i in range(0, len(node), 2048):
                q, code = graph.search(codes[i : i + 2048], beam, radius)
                size = count[code]  # a code stands for all points that have it
                q = np.repeat(q, size) + i
                p = by_code[np.repeat(first[code], size) + np.arange(len(q)) - np.repeat(np.cumsum(size) - size, size)]
                other = node[q] != ids[p]
                q, p = q[other], p[other]
                q, p = verified(q, p, parts.roots(p), sketch, sketches, similarity)
                if not len(q):
                    continue
                head = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
                anchor = np.repeat(p[head], np.diff(np.concatenate([head, [len(q)]])))
                joined = parts.join(anchor, p)
                a, b = np.concatenate([node[q[head]], ids[anchor[joined]]]), np.concatenate([ids[p[head]], ids[p[joined]]])
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["a", "b"])

        sketches = ids = first = count = by_code = parts = None
        for batch in batches:  # points come first
            if not batch.num_rows:
                continue
            point = batch.column("point")
            if graph is None:
                points.append(batch.filter(point))
            rest = batch.filter(pc.invert(point))
            if rest.num_rows and graph is None:
                if not sum(p.num_rows for p in points):
                    return
                held.append(rest)
                if sum(p.num_rows for p in held) < AUDIT:
                    continue
                build()
                for p in points + held:
                    yield from ask(p)
                held.clear()
            elif rest.num_rows:
                yield from ask(rest)
        if graph is None and sum(p.num_rows for p in points):
            build()
            for p in points + held:
                yield from ask(p)

    return work


def candidate_edges(nodes: DataFrame, radius: int = RADIUS, similarity: float = SIMILARITY, shards: int = SHARDS, shard_points: int = SHARD_POINTS) -> DataFrame:
    """By small-world graphs, with their recall: verified edges (a > b) between nodes (node, hi, lo, sketch): enough to connect all that are connected."""
    if not 0 < shard_points <= MOST_POINTS // 2:  # twice the mean is far beyond what a hash puts in one shard
        raise ValueError(f"0 < shard_points <= {MOST_POINTS // 2}")
    shards = max(shards, -(-nodes.count() // shard_points))
    home = F.pmod(F.xxhash64("hi", "lo"), F.lit(shards)).cast("int")
    sent = nodes.withColumn("home", home).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    sent = sent.select("node", "hi", "lo", "sketch", "shard", (F.col("home") == F.col("shard")).alias("point"))
    placed = sent.repartitionById(shards, F.col("shard")).sortWithinPartitions(F.desc("point"), F.xxhash64("node"))  # queries in random order, the first are audited
    return placed.mapInArrow(lean(_shard(radius, similarity)), "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): each node of an edge list and the least node connected to it, by large-star and small-star steps.

    Both steps shuffle only pairs of ids and keep the components; they end when a round changes nothing, which takes
    about the logarithm of the longest chain. The least neighbour of a node is an aggregate joined to its edges, so a
    node with very many of them is combined before the shuffle and split by the join. Each round is checkpointed.
    """
    def state(df):
        return tuple(df.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.lit(0))).first())

    def with_least(df):
        return df.join(df.groupBy("a").agg(F.min("b").alias("m")), "a")

    now = durable(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = state(now)
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = with_least(both).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
        small = with_least(durable(large.where("a <> b").distinct()))
        moved = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b")))
        now = durable(moved.where("a <> b").distinct())
        after = state(now)
        if after == before:
            break
        before = after
    return now.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")


def rarities(nodes: DataFrame) -> np.ndarray:
    """How often each slot value (slot << 16 | value) occurs in about ``RANKED`` of the nodes, chosen by hash."""
    n = nodes.count()
    some = nodes if n <= RANKED else nodes.where(F.xxhash64("node") <= F.lit(int(-(2**63) + 2**64 * RANKED / n)))
    sketch = np.frombuffer(b"".join(some.select("sketch").toArrow().column("sketch").to_pylist()), np.uint16).reshape(-1, SLOTS)
    times = np.bincount((sketch + (np.arange(SLOTS) << 16))[sketch != EMPTY], minlength=SLOTS << 16)
    return np.minimum(times, 0xFFFF).astype(np.uint16)


def rarest(sketch: np.ndarray, times: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(rows, slot values): of each sketch so many of its rarest slot values that any two sketches of at least this
    similarity share one of them."""
    values = (sketch + (np.arange(SLOTS, dtype=np.uint64) << U64(16))).astype(np.uint64)
    filled = sketch != EMPTY
    keys = np.where(filled, times[values].astype(np.uint64) << U64(46) | (mix(values) >> U64(41)) << U64(23) | values, U64(1) << U64(63))
    keys.sort(axis=1)
    n = filled.sum(axis=1)
    taken = n - np.ceil(similarity * n - 1e-9).astype(np.int64) + 1
    rows, k = np.nonzero(np.arange(SLOTS) < np.minimum(taken, n)[:, None])
    return rows, (keys[rows, k] & U64((1 << 23) - 1)).astype(np.uint32)


def _send(times, similarity: float, shards: int):
    """Entries of the rarest slot values by shard, many to a row."""

    def packed(parts):
        table = pa.Table.from_batches(parts)
        entries = []
        for part in table.to_batches(max_chunksize=4096):
            sketch = np.frombuffer(b"".join(part.column("sketch").to_pylist()), np.uint16).reshape(-1, SLOTS)
            rows, slot = rarest(sketch, times.value, similarity)
            entry = np.empty(len(rows), ENTRY)
            entry["slot"], entry["node"] = slot, part.column("node").to_numpy()[rows]
            for k, c in enumerate(("hi", "lo")):
                entry["code"][:, k] = part.column(c).to_numpy().view(np.uint64)[rows]
            entries.append(entry)
        entry = np.concatenate(entries)
        shard = (mix(entry["slot"].astype(np.uint64)) % U64(shards)).astype(np.int32)
        order = np.argsort(shard, kind="stable")
        there, start = np.unique(shard[order], return_index=True)
        data = [x.tobytes() for x in np.split(entry[order], start[1:])]
        return pa.RecordBatch.from_arrays([pa.array(there), pa.array(data, pa.binary())], names=["shard", "data"])

    def work(batches):
        held, rows = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
            if rows >= 16_384:
                yield packed(held)
                held, rows = [], 0
        if held:
            yield packed(held)

    return work


def meetings(entries: np.ndarray, radius: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Candidates (pairs of nodes, each pair once) among the entries of equal slots, and the entries of each crowd, of
    which only pairs with a node that stands for others are among the candidates."""
    entries = entries[np.lexsort((mix(entries["node"].view(np.uint64)), entries["slot"]))]
    slot, node, code = (np.ascontiguousarray(entries[c]) for c in ("slot", "node", "code"))
    start = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]])) if len(slot) else np.zeros(0, np.int64)
    size = np.diff(np.concatenate([start, [len(slot)]]))
    group = np.repeat(np.arange(len(start)), size)
    after = np.repeat(start + size, size) - np.arange(len(slot)) - 1  # entries of the same slot that follow
    met, crowd = np.zeros(len(start), np.int64), np.zeros(len(start), bool)
    pairs, i, apart = [np.zeros((0, 2), np.int64)], np.flatnonzero(after), 1
    while len(i):
        near = np.concatenate([x[hamming(code[x], code[x + apart]) <= radius] for x in np.split(i, range(1 << 18, len(i), 1 << 18))])
        pairs.append(np.stack([near, near + apart], axis=1))
        np.add.at(met, group[near], 1)
        crowd |= met > CROWD * size
        apart += 1
        i = i[(after[i] >= apart) & ~crowd[group[i]]]
    pairs = np.concatenate(pairs)
    pairs = [pairs[~crowd[group[pairs[:, 0]]]]]
    for g in np.flatnonzero(crowd):
        left = np.arange(start[g], start[g] + size[g])
        while len(left) > 1:
            near = hamming(code[left[1:]], code[left[0]]) <= radius
            found = left[1:][near]
            pairs.append(np.stack([np.full(len(found), left[0]), found], axis=1))
            left = left[1:][~near]
    named = np.sort(node[np.concatenate(pairs)], axis=1)
    named = named[named[:, 0] != named[:, 1]]
    return np.unique(named, axis=0), [entries[start[g] : start[g] + size[g]] for g in np.flatnonzero(crowd)]


def _meet(radius: int):
    def work(batches):
        data = [x for batch in batches for x in batch.column("data").to_pylist()]
        if not data:
            return
        pairs, crowds = meetings(np.frombuffer(b"".join(data), ENTRY), radius)
        data.clear()
        for i in range(0, len(pairs), 1 << 16):
            a, b = pairs[i : i + (1 << 16), 1], pairs[i : i + (1 << 16), 0]
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.binary())], names=["a", "b", "crowd"])
        for c in crowds:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([c.tobytes()], pa.binary())], names=["a", "b", "crowd"])

    return work


def _unpack(batches):
    for batch in batches:
        for data in batch.column("crowd").to_pylist():
            e = np.frombuffer(data, ENTRY)
            for i in range(0, len(e), 1 << 16):
                x = e[i : i + (1 << 16)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x["slot"].astype(np.int64)), pa.array(x["node"]), *(pa.array(x["code"][:, k].copy().view(np.int64)) for k in (0, 1))], names=["slot", "node", "hi", "lo"]
                )


def united(node: np.ndarray, root: np.ndarray, block: np.ndarray, code: np.ndarray, sketch: np.ndarray, radius: int, similarity: float) -> np.ndarray:
    """Links (pairs of nodes) that connect all parts of a tile that any pair of nodes connects which is within the radius
    and similar enough: at most one for each node. If the tile holds two blocks, only pairs across them are looked at."""
    _, first, part, size = np.unique(root, return_index=True, return_inverse=True, return_counts=True)
    parts, two, out = Union(len(node)), block.min() < block.max(), [np.zeros((0, 2), np.int64)]
    parts.up = first[part]
    rows = np.flatnonzero(part != size.argmax())  # the largest part meets the others from their side
    for x in np.split(rows, range(64, len(rows), 64)):
        at = parts.roots(np.arange(len(node)))
        near = (hamming(code[x, None], code[None]) <= radius) & (at[x, None] != at)
        q, p = np.nonzero(near & (block[x, None] != block) if two else near)
        q, p = verified(x[q], p, at[p], sketch, sketch, similarity)
        joined = parts.join(q, p)
        out.append(np.stack([node[q[joined]], node[p[joined]]], axis=1))
    return np.concatenate(out)


def _rest(radius: int, similarity: float):
    """Links of the tiles of crowds, which come sorted by slot and tile."""

    def links(batch: pa.RecordBatch | pa.Table) -> pa.RecordBatch:
        slot, low, high, node, root, block, hi, lo = (batch.column(c).to_numpy() for c in ("slot", "low", "high", "node", "root", "block", "hi", "lo"))
        code = np.stack([hi, lo], axis=1).view(np.uint64)
        sketch = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint16).reshape(-1, SLOTS)
        start = np.flatnonzero(np.concatenate([[True], (slot[1:] != slot[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])]))
        found = [united(*(c[i:j] for c in (node, root, block, code, sketch)), radius, similarity) for i, j in zip(start, [*start[1:], len(slot)])]
        found = np.concatenate(found)
        return pa.RecordBatch.from_arrays([pa.array(found.max(axis=1)), pa.array(found.min(axis=1))], names=["a", "b"])

    def work(batches):
        held: list[pa.RecordBatch] = []  # the tile that the last batch ends with may go on in the next
        for batch in batches:
            if not batch.num_rows:
                continue
            tile = np.stack([batch.column(c).to_numpy() for c in ("slot", "low", "high")], axis=1)
            if held and any(held[-1].column(c)[-1].as_py() != v for c, v in zip(("slot", "low", "high"), tile[0].tolist())):
                yield links(pa.Table.from_batches(held).combine_chunks())
                held = []
            last = np.flatnonzero((tile != tile[-1]).any(axis=1))
            if len(last):
                yield links(pa.Table.from_batches([*held, batch.slice(0, last[-1] + 1)]).combine_chunks())
                held, batch = [], batch.slice(last[-1] + 1)
            held.append(batch)
        if held:
            yield links(pa.Table.from_batches(held).combine_chunks())

    return work


def rest_of_crowds(members: DataFrame, nodes: DataFrame, radius: int, similarity: float, most: int) -> DataFrame:
    """Links (a, b) that connect all parts (roots) of crowds which a pair of their members (slot, node, hi, lo, root) links.

    A crowd of one part is done with. Any other is cut into blocks of about ``most`` nodes, and each two blocks meet in a
    tile of their own, so that a large crowd is spread over tasks. Tiles have the sketches at hand and send on links only,
    not the pairs to be verified.
    """
    split = members.groupBy("slot").agg(F.min("root").alias("least"), F.max("root").alias("greatest"), F.ceil(F.count("*") / most).cast("int").alias("blocks"))
    apart = members.join(split.where("least <> greatest").select("slot", "blocks"), "slot").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    apart = apart.join(nodes.select("node", "sketch"), "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = apart.select("slot", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "node", "root", "block", "hi", "lo", "sketch")
    placed = tiles.repartition("slot", "low", "high").sortWithinPartitions("slot", "low", "high")
    return placed.mapInArrow(lean(_rest(radius, similarity)), "a bigint, b bigint")


def similar(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes whose sketches are similar enough."""

    def work(batches):
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, SLOTS) for c in ("x", "y"))
                yield batch.select(["a", "b"]).filter(pa.array(jaccard(x, y) >= similarity))

    both = pairs.distinct().join(nodes.select(F.col("node").alias("a"), F.col("sketch").alias("x")), "a")
    both = both.join(nodes.select(F.col("node").alias("b"), F.col("sketch").alias("y")), "b").select("a", "b", "x", "y")
    return both.mapInArrow(lean(work), "a bigint, b bigint")


def linked(nodes: DataFrame, radius: int = RADIUS, similarity: float = SIMILARITY, shards: int = SHARDS, shard_slots: int = SHARD_SLOTS, block: int = BLOCK) -> DataFrame:
    """(node, root) of the nodes (node, hi, lo, sketch) that are linked to others: all pairs within the radius and of at
    least this similarity, and what they connect. A node without a link is not among them."""
    if not 0 < similarity <= 1 or shard_slots < 1 or block < 1:
        raise ValueError("0 < similarity <= 1, shard_slots >= 1 and block >= 1")
    shards = max(shards, -(-nodes.count() * SLOTS // (2 * shard_slots)))
    times = nodes.sparkSession.sparkContext.broadcast(rarities(nodes))
    sent = nodes.select("node", "hi", "lo", "sketch").mapInArrow(lean(_send(times, similarity, shards)), "shard int, data binary")
    met = durable(sent.repartitionById(shards, F.col("shard")).mapInArrow(lean(_meet(radius)), "a bigint, b bigint, crowd binary"))
    root = components(similar(met.where("crowd IS NULL").select("a", "b"), nodes, similarity))
    crowds = met.where("crowd IS NOT NULL").select("crowd")
    if crowds.isEmpty():
        return root
    root = durable(root)
    members = crowds.mapInArrow(lean(_unpack), "slot bigint, node bigint, hi bigint, lo bigint").join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    members = durable(members)
    more = durable(rest_of_crowds(members, nodes, radius, similarity, block))
    return root if more.isEmpty() else components(root.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))


def _node() -> Column:
    """A number for each different (doc_id, text)."""
    return F.xxhash64("doc_id", "text")


def memberships(docs: DataFrame, **settings) -> DataFrame:
    """(node, doc_id, group_id, first) of the different (doc_id, text) whose text has words; ``first`` says whether it is
    the first of its group, the least in the order of (doc_id, node)."""
    known = plain(docs, "doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    signed = durable(known.select(_node().alias("node"), "doc_id", "text").mapInArrow(lean(_sign), SIGNATURES).withColumn("key", F.xxhash64("hi", "lo", "th")))
    # texts of equal words are one point; how many there are is combined before the shuffle
    nodes = signed.groupBy("key").agg(F.min(F.struct("doc_id", "node", "hi", "lo", "sketch")).alias("n")).select("key", "n.*")
    nodes = durable(nodes)
    root = linked(nodes, **settings)
    parts = nodes.select("key", "doc_id", "node").join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    firsts = parts.groupBy("root").agg(F.min(F.struct("doc_id", "node")).alias("f"))
    classes = parts.join(firsts, "root").select("key", F.col("f.doc_id").alias("group_id"), F.col("f.node").alias("first_node"))
    rows = signed.select("node", "doc_id", "key").distinct()
    return rows.join(classes, "key").select("node", "doc_id", "group_id", (F.col("node") == F.col("first_node")).alias("first"))


def groups(docs: DataFrame, **settings) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id``, ``group_id`` (the least doc_id of its group), ``group_size`` (distinct
    doc_ids) and ``kept`` (whether it is the group's first).

    Words are lower-cased runs of letters and digits. A text without words, or a null one, is never a duplicate: it is
    a group of its own. So is a row with null doc_id, whose group_id is null. Different texts that share a doc_id are
    looked at apart; of the texts of the least doc_id in a group the one of the least hash is first. Rows repeated as
    they are share one answer. Texts that are equal but for case, punctuation and spacing are exact copies. Texts of any
    length are read whole. An empty table gives no rows. Other columns are ignored, whatever their names.
    """
    member = memberships(docs, **settings)
    rows = docs.select("doc_id", F.when(F.col("doc_id").isNotNull() & F.col("text").isNotNull(), _node()).alias("node"))
    sizes = member.groupBy("group_id").agg(F.count_distinct("doc_id").alias("group_size"))
    labelled = rows.join(member.select("node", "group_id", "first"), "node", "left").withColumn("group_id", F.coalesce("group_id", "doc_id"))
    return labelled.join(sizes, "group_id", "left").select(
        "doc_id", "group_id", F.when(F.col("first").isNull(), 1).otherwise(F.col("group_size")).cast("bigint").alias("group_size"), F.coalesce("first", F.lit(True)).alias("kept")
    )


def first_of_each(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` with one row left of each group of ``groups``, all columns as they were, whatever their names.

    Of rows repeated as they are (same doc_id and text) one stays. Rows with null doc_id or text all stay, as do texts
    without words (but repeated ones). An empty table stays empty. Texts are shuffled once.
    """
    names = quoted(docs.columns)
    node, gone, k = fresh(docs, "node", "gone", "k")
    out = memberships(docs, **settings).where("NOT first").select(F.col("node").alias(gone)).distinct()
    known = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").withColumn(node, _node())
    kept = known.join(out, F.col(node) == F.col(gone), "left_anti")
    one = kept.withColumn(k, F.row_number().over(W.partitionBy(node).orderBy(node))).where(F.col(k) == 1).select(*names)
    return one.union(docs.where("doc_id IS NULL OR text IS NULL"))
