"""Benchmark decontamination: SimHash over item-sized windows, multi-index Hamming blocks, exact verification.

A document is contaminated by a benchmark item if one of its windows of as many words as the item has (or the whole
document, where that is shorter) has a SimHash within the radius of the item's and a weighted shingle Jaccard
similarity to it of at least the threshold. Shingles are three words; a shingle weighs its number of bytes, so long,
telling words count more than short, common ones, and no statistics are needed.

Windows whose shingles shared with the item weigh less than threshold times the item cannot reach the threshold; only
the others are hashed. That is a bound, not a heuristic: no match is lost by it. The SimHash of a window is looked up
in four tables of 16-bit blocks, at all values that differ in at most radius // 4 bits; by the pigeonhole principle
that finds every item fingerprint within the radius.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import NONWORD, U64, Grams, buffers, filtered, lean, plain, row_of, slices, word_hashes, word_spans

SHINGLE, RADIUS, SIMILARITY = 3, 20, 0.6
BLOCKS, BLOCK_BITS = 4, 16
MAX_ITEMS = 50_000  # items in one broadcast index (about 40 MB); a larger benchmark takes several passes
FILTER_BITS = 20
SCHEMA = "doc_id bigint, item_id bigint, start_word int, similarity double, hamming int"


def shingles(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and weight of the shingle at each word (they may cross rows at a row's last two words), and row offsets."""
    starts, ends, woff = word_spans(raw, off, NONWORD)
    grams = Grams(word_hashes(raw, starts, ends)).all(SHINGLE)
    size = np.concatenate([[0], np.cumsum(ends - starts)])
    return grams, (size[SHINGLE:] - size[:-SHINGLE]) if len(grams) else grams.astype(np.int64), woff


def simhash(hashes: np.ndarray, weights: np.ndarray) -> int:
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1)
    return int(np.packbits(2 * (weights @ bits) > weights.sum()).view(np.uint64)[0])


class Index:
    """The benchmark's items: shingles, fingerprints, and block tables over the fingerprints."""

    def __init__(self, items: list[tuple[int, str]], radius: int):
        self.ids: list[int] = []
        self.bags: list[dict[int, int]] = []
        found, self.weights, prints = [], [], []
        lengths = []
        for item, text in items:
            raw, off = buffers(pc.utf8_lower(pa.array([text])))
            h, w, woff = shingles(raw, off)
            if not len(h):
                continue
            bag: dict[int, int] = {}
            for x in h.tolist():
                bag[x] = bag.get(x, 0) + 1
            self.ids.append(item)
            self.bags.append(bag)
            self.weights.append(int(w.sum()))
            lengths.append(int(woff[1]))
            prints.append(simhash(h, w))
            found.append(np.unique(h))
        self.n = len(self.ids)
        self.lengths = np.array(lengths, np.int64)
        self.total = np.array(self.weights, np.float64)
        self.prints = np.array(prints, np.uint64)
        owner = np.repeat(np.arange(self.n), [len(x) for x in found])
        flat = np.concatenate(found) if found else np.zeros(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.keys, first = np.unique(flat[order], return_index=True)
        self.owners, self.first = owner[order], np.concatenate([first, [len(flat)]])
        self.maybe = np.zeros(1 << FILTER_BITS, bool)
        self.maybe[(self.keys >> U64(64 - FILTER_BITS)).astype(np.int64)] = True
        self.radius = radius
        masks = [sum(1 << b for b in bits) for k in range(radius // BLOCKS + 1) for bits in combinations(range(BLOCK_BITS), k)]
        self.masks = np.array(masks, np.int64)
        self.tables = []
        for b in range(BLOCKS):
            value = ((self.prints >> U64(BLOCK_BITS * b)) & U64(0xFFFF)).astype(np.int64)
            order = np.argsort(value, kind="stable")
            self.tables.append((order, np.searchsorted(value[order], np.arange((1 << BLOCK_BITS) + 1))))

    def within(self, fingerprint: int) -> dict[int, int]:
        """Every item whose fingerprint is within the radius, and its distance."""
        items = []
        for b, (order, start) in enumerate(self.tables):
            near = self.masks ^ ((fingerprint >> BLOCK_BITS * b) & 0xFFFF)
            a, z = start[near], start[near + 1]
            some = z > a
            items += [order[i:j] for i, j in zip(a[some].tolist(), z[some].tolist())]
        if not items:
            return {}
        items = np.unique(np.concatenate(items))
        distance = np.bitwise_count(self.prints[items] ^ U64(fingerprint))
        return {int(i): int(d) for i, d in zip(items, distance) if d <= self.radius}


def matches(index: Index, raw: np.ndarray, off: np.ndarray, threshold: float) -> list[tuple[int, int, int, float, int]]:
    """(row, item number, first word, similarity, distance): the best window of each contaminated row and item."""
    h, weight, woff = shingles(raw, off)
    if not len(h) or not index.n:
        return []
    row = row_of(woff)
    at = np.flatnonzero(index.maybe[(h >> U64(64 - FILTER_BITS)).astype(np.int64)])
    at = at[at + SHINGLE <= woff[1:][row[at]]]
    key = np.minimum(np.searchsorted(index.keys, h[at]), len(index.keys) - 1)
    hit = index.keys[key] == h[at]
    at, key = at[hit], key[hit]
    size = index.first[key + 1] - index.first[key]
    item = index.owners[np.repeat(index.first[key], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)]
    at = np.repeat(at, size)
    pair, which = np.unique(row[at] * index.n + item, return_inverse=True)
    enough = np.bincount(which, weight[at], len(pair)) >= threshold * index.total[pair % index.n]
    some = enough[which]
    at, which = at[some], which[some]
    order = np.lexsort((at, which))
    at, which = at[order], which[order]
    cuts = np.flatnonzero(np.concatenate([[True], which[1:] != which[:-1], [True]])) if len(at) else []
    best: dict[tuple[int, int], tuple[float, int, int]] = {}
    seen: dict[tuple[int, int], dict[int, int]] = {}
    for a, z in zip(cuts[:-1], cuts[1:]):
        p = pair[which[a]]
        r, own = int(p // index.n), int(p % index.n)
        low, high = int(woff[r]), int(woff[r + 1])
        words = min(int(index.lengths[own]), high - low)
        span = words - SHINGLE + 1  # shingles of a window
        places = at[a:z]
        running = np.concatenate([[0], np.cumsum(weight[places])])
        starts = np.unique(np.concatenate([np.arange(max(low, q - span + 1), min(q, high - words) + 1) for q in places]))
        held = running[np.searchsorted(places, starts + span)] - running[np.searchsorted(places, starts)]
        for s in starts[held >= threshold * index.total[own]].tolist():
            hs, ws = h[s : s + span], weight[s : s + span]
            if (s, words) not in seen:
                seen[s, words] = index.within(simhash(hs, ws))
            for other, distance in seen[s, words].items():
                if min(int(index.lengths[other]), high - low) != words:
                    continue
                left, common = dict(index.bags[other]), 0
                for x, w in zip(hs.tolist(), ws.tolist()):
                    if left.get(x, 0):
                        left[x] -= 1
                        common += w
                similarity = common / (int(ws.sum()) + index.weights[other] - common)
                found = (similarity, low - s, distance)
                if similarity >= threshold and (r, other) not in best or similarity >= threshold and found[:2] > best[r, other][:2]:
                    best[r, other] = found
    return [(r, i, -low, similarity, d) for (r, i), (similarity, low, d) in sorted(best.items())]


def indexes(benchmark: DataFrame, radius: int, max_items: int = MAX_ITEMS) -> list:
    """Broadcast indexes of the whole benchmark, each of about ``max_items`` items at most."""
    items = plain(benchmark, "item_id", "text").where("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    passes = max(1, -(-items.count() // max_items))
    keyed = items.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)))
    out = []
    for p in range(passes):
        rows = keyed.where(F.col("part") == p).orderBy("item_id", "text").collect()
        index = Index([(r["item_id"], r["text"]) for r in rows], radius)
        if index.n:
            out.append(benchmark.sparkSession.sparkContext.broadcast(index))
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, radius: int = RADIUS, similarity: float = SIMILARITY, max_items: int = MAX_ITEMS) -> DataFrame:
    """Rows (doc_id, item_id, start_word, similarity, hamming): the most similar window for each document and item.

    Words are lower-cased runs of letters and digits. A null text, an empty one, or one of fewer than three words has
    no shingle and is clean, as is any against an empty benchmark; an item of fewer than three words, or with a null
    item_id or text, is not searched for. Rows with null doc_id are left out here. Repeated rows, and texts that share
    a doc_id or item_id, give one row for the pair, its most similar; ties go to the first window. Texts of any length
    are searched whole. An empty table gives no rows. Other columns are ignored, whatever their names. One scan of the
    documents and no shuffle of texts, for each ``max_items`` items.
    """
    found = docs.sparkSession.createDataFrame([], SCHEMA)
    for shared in indexes(benchmark, radius, max_items):

        def work(batches, shared=shared):
            index = shared.value
            for batch in batches:
                for part in slices(batch):
                    rows = matches(index, *buffers(pc.utf8_lower(part.column("text"))), similarity)
                    r, i, start, sim, d = zip(*rows) if rows else ([],) * 5
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column("doc_id").take(pa.array(r, pa.int64())),
                            pa.array([index.ids[k] for k in i], pa.int64()),
                            pa.array(start, pa.int32()),
                            pa.array([round(x, 9) for x in sim], pa.float64()),
                            pa.array(d, pa.int32()),
                        ],
                        names=["doc_id", "item_id", "start_word", "similarity", "hamming"],
                    )

        known = plain(docs, "doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
        found = found.union(known.mapInArrow(lean(work), SCHEMA))
    first = F.max_by(F.struct("start_word", "similarity", "hamming"), F.struct("similarity", -F.col("start_word"), -F.col("hamming")))
    return found.groupBy("doc_id", "item_id").agg(first.alias("m")).select("doc_id", "item_id", "m.start_word", "m.similarity", "m.hamming")


def clean(docs: DataFrame, benchmark: DataFrame, radius: int = RADIUS, similarity: float = SIMILARITY, max_items: int = MAX_ITEMS) -> DataFrame:
    """``docs`` without the contaminated rows, all columns as they were, whatever their names; decided row by row, with
    no shuffle. Rows with null doc_id are judged like any, null and empty texts stay, repeated rows share one fate, and an
    empty table stays empty."""
    for shared in indexes(benchmark, radius, max_items):

        def keep(shared=shared):
            def judge(part):
                bad = {m[0] for m in matches(shared.value, *buffers(pc.utf8_lower(part.column("text"))), similarity)}
                return [i not in bad for i in range(part.num_rows)]

            return judge

        docs = filtered(docs, keep)
    return docs
