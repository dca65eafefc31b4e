"""Removal of repeated passages with suffix arrays sorted by the deep-shallow method.

A passage is ``min_words`` consecutive words (50). Every passage that occurs more than once is marked everywhere but at
its first occurrence, in the order of (doc_id, position); the marked words of a document merge into spans.

1. Winnowing picks, in every window of 50 words, the 25-word gram that hashes least. Equal windows pick the same gram,
   so each repeated passage is found through one gram inside it; only 2 in 27 grams are picked.
2. Picked grams that occur once are dropped (counts are combined before they are shuffled). For the others, the 25
   words behind and the 25 words before are fetched from the text: a sparse suffix array needs no more to decide
   50-word passages. Of occurrences in one task whose gram and words around it are all the same, only the first goes on;
   the others repeat it and are marked where they are found. So boilerplate costs as many rows as there are tasks.
3. Gram by gram, those suffixes and the reversed prefixes are sorted: multikey quicksort to a shallow depth, then blind
   tries for what still ties. The arrays of longest common prefixes say which occurrences agree on a whole window.
   A gram with more occurrences than one task should sort (``HOT``) is spread out by the windows around it instead: the
   first occurrence of each window is an aggregate, and all others are marked. Both ways give the same marks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from marlstone.llm.common import SPACE, U64, Grams, buffers, fresh, lean, mix, plain, quoted, row_of, slices, sliding_min, word_hashes, word_spans

MIN_WORDS, GRAM = 50, 25
SHALLOW, SMALL = 4, 6  # symbols that multikey quicksort looks at; group size below which it stops
PLACE_BITS = 28
CHUNK_ROWS = 25_000
HOT = 50_000  # occurrences of one gram that are sorted in one task at most
KEPT = 100_000  # grams with their surroundings that a task remembers, to send on only the first of each
ANCHORS = "fp bigint, doc_id bigint, th bigint, pos int"
FOUND = "fp bigint, doc_id bigint, th bigint, pos int, ctx binary, a int, b int"
MARKS = "doc_id bigint, th bigint, lo int, hi int"


def picked_grams(raw: np.ndarray, off: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, word position in the row and hash of each winnowed gram."""
    starts, ends, woff = word_spans(raw, off, SPACE)
    words = word_hashes(raw, starts, ends)
    hashes = Grams(words).all(gram)
    if not len(hashes):
        z = np.zeros(0, np.int64)
        return z, z, z
    mask = U64((1 << PLACE_BITS) - 1)
    packed = (hashes & ~mask) | np.arange(len(hashes), dtype=np.uint64)
    least = sliding_min(packed, window - gram + 1)
    row = row_of(woff)
    first = np.arange(len(least))
    inside = first + window <= woff[1:][row[: len(least)]]
    at = np.unique(least[inside] & mask).astype(np.int64)
    return row[at], at - woff[row[at]], hashes[at].view(np.int64)


def lcp(a: bytes, b: bytes) -> int:
    """Common leading 4-byte symbols."""
    if a == b:
        return len(a) // 4
    return (8 * len(a) - (int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_length()) // 32


class BlindTrie:
    """A compacted trie that stores branch depths and branching symbols only; strings are compared once, at a leaf."""

    def __init__(self, keys: list[bytes]):
        self.keys, self.root = keys, None

    def add(self, i: int) -> None:
        key = self.keys[i]
        if self.root is None:
            self.root = [i]
            return
        node = self.root
        while type(node) is tuple:  # a branch: (depth, {symbol: child})
            depth, below = node
            node = below.get(key[4 * depth : 4 * depth + 4]) or next(iter(below.values()))
        other = self.keys[node[0]]
        if other == key:
            node.append(i)
            return
        common = lcp(key, other)
        parent, link, node = None, None, self.root
        while type(node) is tuple and node[0] < common:
            parent, link = node, key[4 * node[0] : 4 * node[0] + 4]
            node = node[1][link]
        symbol = key[4 * common : 4 * common + 4]
        if type(node) is tuple and node[0] == common:
            node[1][symbol] = [i]
            return
        branch = (common, {other[4 * common : 4 * common + 4]: node, symbol: [i]})
        if parent is None:
            self.root = branch
        else:
            parent[1][link] = branch

    def sorted(self) -> list[tuple[int, int]]:
        """(index, common prefix with the one before) in order; the first has -1."""
        out: list[tuple[int, int]] = []
        stack = [(self.root, -1)]
        while stack:
            node, common = stack.pop()
            if type(node) is tuple:
                children = [node[1][s] for s in sorted(node[1])]
                stack += [(c, node[0]) for c in reversed(children[1:])]
                stack.append((children[0], common))
            else:
                whole = len(self.keys[node[0]]) // 4
                out.append((node[0], common))
                out += [(i, whole) for i in node[1:]]
        return out


def deep_shallow(keys: list[bytes], members: list[int]) -> list[tuple[int, int]]:
    """Sorts ``members`` by their keys; gives (index, common symbols with the one before), the first with -1."""
    pieces: list[list[int]] = []  # in order; members of one piece agree to the shallow depth, or are few
    stack = [(members, 0)]
    while stack:  # multikey quicksort: three ways on one symbol
        group, depth = stack.pop()
        if len(group) <= SMALL or depth >= SHALLOW:
            pieces.append(group)
            continue
        at = 4 * depth
        pivot = keys[group[len(group) // 2]][at : at + 4]
        less, same, more = [], [], []
        for i in group:
            s = keys[i][at : at + 4]
            (same if s == pivot else less if s < pivot else more).append(i)
        stack += [(g, d) for g, d in ((more, depth), (same, depth + 1), (less, depth)) if g]
    out: list[tuple[int, int]] = []
    for group in pieces:
        trie = BlindTrie(keys)
        for i in group:
            trie.add(i)
        part = trie.sorted()
        if out:
            part[0] = (part[0][0], lcp(keys[out[-1][0]], keys[part[0][0]]))
        out += part
    return out


def marks(fp: np.ndarray, doc: np.ndarray, th: np.ndarray, pos: np.ndarray, ctx: list[bytes], window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of rows sorted by gram: (row, first word, end word) of what repeats an earlier occurrence."""
    side = window - gram
    order = np.lexsort((pos, th, doc))
    fp, doc, th, pos, ctx = fp[order], doc[order], th[order], pos[order], [ctx[i] for i in order]
    n = len(fp)
    symbols = np.frombuffer(b"".join(ctx), ">u4").reshape(n, 2 * side)
    room = (symbols != 0).reshape(n, 2, side).sum(axis=2)  # zeros stand for what lies outside the document
    by_gram = np.argsort(fp, kind="stable")
    cuts = np.flatnonzero(np.concatenate([[True], fp[by_gram][1:] != fp[by_gram][:-1], [True]]))
    ranked = []
    for k in range(2):
        keys = [c[4 * side * k : 4 * side * (k + 1)] for c in ctx]
        listed = by_gram.tolist()
        pairs: list[tuple[int, int]] = []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            pairs += deep_shallow(keys, listed[a:b])
        both = np.array(pairs, np.int64).reshape(-1, 2)
        ranked.append((both[:, 0], both[:, 1]))
    least, most = np.full(n, window + 1), np.full(n, -1)
    classes = np.empty((2, n), np.int64)
    for left in range(side + 1):
        for k, depth in ((0, side - left), (1, left)):
            at, common = ranked[k]
            classes[k, at] = np.cumsum(common < depth)
        _, first, inverse = np.unique(classes[0] * (n + 1) + classes[1], return_index=True, return_inverse=True)
        first = first[inverse]
        earlier = (doc[first] != doc) | (th[first] != th) | (pos[first] != pos)
        hit = earlier & (room[:, 0] >= side - left) & (room[:, 1] >= left)
        least[hit] = np.minimum(least[hit], left)
        most[hit] = left
    found = np.flatnonzero(most >= 0)
    return doc[found], th[found], pos[found] - most[found], pos[found] - least[found] + window


def _anchors(window: int, gram: int):
    def work(batches):
        for batch in batches:
            for part in slices(batch):
                row, pos, fp = picked_grams(*buffers(part.column("text")), window, gram)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(fp), part.column("doc_id").take(take), part.column("th").take(take), pa.array(pos.astype(np.int32))],
                    names=["fp", "doc_id", "th", "pos"],
                )

    return work


def _found(window: int, gram: int):
    """What is known of each picked gram that occurs again, in rows of three kinds.

    With ``ctx``: (gram, document, place, the words around it), to be sorted by gram. Without ``ctx`` and with ``pos``: a
    window around a hot gram, by two hashes (``fp``; ``a`` and ``b``) and its place. Without both: a span [a, b) that
    repeats something earlier in the same task.
    """
    side = window - gram

    def rows(fp, doc, th, pos=None, ctx=None, a=None, b=None):
        n = len(doc)
        binary = pa.nulls(n, pa.binary()) if ctx is None else pa.Array.from_buffers(pa.binary(ctx.shape[1]), n, [None, pa.py_buffer(ctx.tobytes())]).cast(pa.binary())
        ints = [pa.nulls(n, pa.int32()) if x is None else pa.array(x.astype(np.int32)) for x in (pos, a, b)]
        return pa.RecordBatch.from_arrays([pa.array(fp), pa.array(doc), pa.array(th), ints[0], binary, *ints[1:]], names=["fp", "doc_id", "th", "pos", "ctx", "a", "b"])

    def firsts(key, doc, th, pos, seen):
        """Which rows to send on, those that come before all others of their key in this task, and which repeat another
        one; a row that stands at the same place of the same document as the first is neither."""
        new, again = np.zeros(len(key), bool), np.zeros(len(key), bool)
        if not len(key):
            return new, again
        order = np.lexsort((pos, th, doc, key))
        head = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
        of = order[np.repeat(head, np.diff(np.concatenate([head, [len(key)]])))]
        again[order] = (doc[order] != doc[of]) | (th[order] != th[of]) | (pos[order] != pos[of])
        for i in order[head].tolist():
            k, place = int(key[i]), (int(doc[i]), int(th[i]), int(pos[i]))
            old = seen.get(k)
            if old is None or place < old:
                new[i] = True
                if old is not None or len(seen) < KEPT:
                    seen[k] = place
            else:
                again[i] = place != old
        return new, again

    def work(batches):
        seen: dict[int, tuple[int, int, int]] = {}
        for batch in batches:
            for part in slices(batch):
                raw, off = buffers(part.column("text"))
                starts, ends, woff = word_spans(raw, off, SPACE)
                whole = word_hashes(raw, starts, ends)
                words = np.concatenate([(whole >> U64(32)).astype(np.uint32) | np.uint32(1), [np.uint32(0)]])
                lists = part.column("found")
                size = np.diff(lists.offsets.to_numpy())
                flat = lists.flatten()
                places, fps = flat.field("pos").to_numpy().astype(np.int64), flat.field("fp").to_numpy()
                hots = flat.field("hot").to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(part.num_rows), size)
                docs, ths = (part.column(c).to_numpy() for c in ("doc_id", "th"))
                grams = (Grams(whole), Grams(mix(whole))) if hots.any() else None
                for i in range(0, len(row), CHUNK_ROWS):
                    own = slice(i, i + CHUNK_ROWS)
                    r, pos, fp, hot = row[own], places[own], fps[own], hots[own]
                    doc, th, at = docs[r], ths[r], woff[r] + pos
                    right, left = np.minimum(woff[r + 1] - at - gram, side), np.minimum(pos, side)
                    fits = right + left >= side  # else no window around the gram lies inside the document
                    k = np.flatnonzero(fits & ~hot)
                    behind, before = at[k, None] + gram + np.arange(side), at[k, None] - 1 - np.arange(side)
                    behind[np.arange(side) >= right[k, None]] = len(words) - 1
                    before[np.arange(side) >= left[k, None]] = len(words) - 1
                    ctx = words[np.concatenate([behind, before], axis=1)]
                    around = Grams(ctx.ravel().astype(np.uint64)).at(np.arange(len(ctx)) * 2 * side, 2 * side)
                    new, again = firsts(mix(fp[k].view(np.uint64) ^ around), doc[k], th[k], pos[k], seen)
                    yield rows(fp[k][new], doc[k][new], th[k][new], pos[k][new], ctx[new].astype(">u4").view(np.uint8).reshape(-1, 8 * side))
                    k = k[again]
                    yield rows(fp[k], doc[k], th[k], a=(pos - left)[k], b=(pos + gram + right)[k])
                    k = np.flatnonzero(fits & hot)
                    n = (left + right - side + 1)[k]  # windows around each
                    k = np.repeat(k, n)
                    shift = np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n)
                    start = pos[k] - left[k] + shift
                    first = woff[r[k]] + start
                    if len(k):
                        wa, wb = (g.at(first, window) for g in grams)
                        new, again = firsts(wa ^ mix(wb), doc[k], th[k], start, seen)
                        k, start, wa, wb, again, where = k[new], start[new], wa[new], wb[new], k[again], start[again]
                        yield rows(wa.view(np.int64), doc[k], th[k], start, a=(wb >> U64(33)).astype(np.int64), b=(wb & U64(0x7FFFFFFF)).astype(np.int64))
                        yield rows(fp[again], doc[again], th[again], a=where, b=where + window)

    return work


def _marks(window: int, gram: int):
    """Spans that repeat an earlier occurrence, from rows sorted by (fp, a, b, doc_id, th, pos)."""

    def spans(doc, th, lo, hi):
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(th), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))], names=["doc_id", "th", "lo", "hi"])

    def emit(table):
        cols = [table.column(c).to_numpy() for c in ("fp", "doc_id", "th", "pos")]
        return spans(*marks(*cols, table.column("ctx").to_pylist(), window, gram))

    def work(batches):  # whole grams are handled together, about CHUNK_ROWS at a time
        held, rows, last = [], 0, None
        for batch in batches:
            new = pa.Table.from_batches([batch])
            plain_ = new.filter(pc.and_(pc.is_null(new.column("ctx")), pc.is_null(new.column("pos"))))
            if plain_.num_rows:
                yield spans(*(plain_.column(c).to_numpy() for c in ("doc_id", "th", "a", "b")))
            hot = new.filter(pc.and_(pc.is_null(new.column("ctx")), pc.is_valid(new.column("pos"))))
            if hot.num_rows:
                key, place = (np.stack([hot.column(c).to_numpy().astype(np.int64) for c in cs], axis=1) for cs in (("fp", "a", "b"), ("doc_id", "th", "pos")))
                if last is not None:  # the first row of the window that the batch before ended with
                    key, place = np.concatenate([last[0], key]), np.concatenate([last[1], place])
                head = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)]))
                of = np.repeat(head, np.diff(np.concatenate([head, [len(key)]])))
                again = (place != place[of]).any(axis=1)[len(key) - hot.num_rows :]
                last = key[of[-1:]], place[of[-1:]]
                more = hot.filter(pa.array(again))
                start = more.column("pos").to_numpy()
                yield spans(more.column("doc_id").to_numpy(), more.column("th").to_numpy(), start, start + window)
            sortable = new.filter(pc.is_valid(new.column("ctx")))
            if not sortable.num_rows:
                continue
            held.append(sortable)
            rows += sortable.num_rows
            if rows >= CHUNK_ROWS:
                table = pa.concat_tables(held)
                fp = table.column("fp").to_numpy()
                cut = int(np.searchsorted(fp, fp[-1]))
                if cut:
                    yield emit(table.slice(0, cut))
                held, rows = [table.slice(cut)], table.num_rows - cut
        if rows:
            yield emit(pa.concat_tables(held))

    return work


def marked_spans(docs: DataFrame, window: int = MIN_WORDS, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """Spans by (doc_id, th): th is xxhash64 of the text, which tells apart texts that share a doc_id."""
    if not 0 < gram < window:
        raise ValueError("0 < gram < window")
    keyed = plain(docs, "doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL").withColumn("th", F.xxhash64("text"))
    picked = keyed.mapInArrow(lean(_anchors(window, gram)), ANCHORS)
    counts = picked.groupBy("fp").agg(F.count("*").alias("n")).where("n > 1").select("fp", (F.col("n") > hot).alias("hot"))
    by_doc = picked.join(counts, "fp").groupBy("doc_id", "th").agg(F.collect_set(F.struct("pos", "fp", "hot")).alias("found"))
    found = keyed.join(by_doc, ["doc_id", "th"]).select("text", "doc_id", "th", "found").mapInArrow(lean(_found(window, gram)), FOUND)
    placed = found.repartition("fp").sortWithinPartitions("fp", "a", "b", "doc_id", "th", "pos")
    marked = placed.mapInArrow(lean(_marks(window, gram)), MARKS)
    by = W.partitionBy("doc_id", "th").orderBy("lo", "hi")
    reach = F.max("hi").over(by.rowsBetween(W.unboundedPreceding, -1))
    return (
        marked.withColumn("new", F.when(reach.isNull() | (F.col("lo") > reach), 1).otherwise(0))
        .withColumn("island", F.sum("new").over(by.rowsBetween(W.unboundedPreceding, 0)))
        .groupBy("doc_id", "th", "island")
        .agg(F.min("lo").alias("start_word"), F.max("hi").alias("end_word"))
        .drop("island")
    )


def repeated_spans(docs: DataFrame, window: int = MIN_WORDS, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """Rows (doc_id, start_word, end_word): words [start, end) repeat an earlier passage; words count from 0.

    Words are runs between ASCII white space. A null doc_id or text is left out; an empty text or one of fewer than
    ``window`` words has no passages. A row repeated as it is (same doc_id and text) is the same document, not a copy
    of it. Of equal passages, the one at the lowest (doc_id, text hash, position) is the first. Texts of any length are
    taken whole. An empty table gives no rows. Other columns are ignored, whatever their names.
    """
    return marked_spans(docs, window, gram, hot).select("doc_id", "start_word", "end_word")


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words in the spans, each cut from its first word's start to the next word's start."""
    raw = text.encode("utf-8", "surrogatepass")
    starts, _, _ = word_spans(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), SPACE)
    bounds = np.concatenate([starts, [len(raw)]])
    keep, done = [], 0
    for a, b in sorted(spans):
        keep.append(raw[done : bounds[min(a, len(starts))]])
        done = max(done, int(bounds[min(b, len(starts))]))
    return b"".join([*keep, raw[done:]]).decode("utf-8", "surrogatepass")


def without_repeats(docs: DataFrame, window: int = MIN_WORDS, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """``docs`` with repeated passages cut out of ``text`` and ``n_chars`` set to what is left, same columns, whatever
    their names.

    Passages are those of ``repeated_spans``. A document of which only white space is left is dropped; all others stay,
    those without a repeated passage (empty texts and very short ones too) and those with null doc_id or text untouched.
    A repeated row loses what its equals lose, and an empty table stays empty.
    """
    names = docs.columns

    @F.pandas_udf("string")
    def cut(text, lo, hi):
        return pd.Series([None if t is None else cut_words(t, list(zip(a, b))) for t, a, b in zip(text, lo, hi)], dtype=object)

    doc, th, spans, left = fresh(docs, "doc", "th", "spans", "left")
    by_doc = marked_spans(docs, window, gram, hot).groupBy("doc_id", "th").agg(F.sort_array(F.collect_list(F.struct("start_word", "end_word"))).alias(spans))
    by_doc = by_doc.select(F.col("doc_id").alias(doc), F.col("th").alias(th), spans)
    joined = docs.join(by_doc, (F.col("doc_id") == F.col(doc)) & (F.xxhash64("text") == F.col(th)), "left")
    some = F.col(spans).isNotNull()
    with_left = joined.withColumn(left, cut(F.when(some, F.col("text")), f"{spans}.start_word", f"{spans}.end_word"))
    kept = with_left.where(~some | F.col(left).rlike("[^ \\t\\n\\r\\f\\x0B]"))
    new = {"text": F.when(some, F.col(left)).otherwise(F.col("text"))}
    if "n_chars" in names:
        new["n_chars"] = F.when(some, F.length(left).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return kept.select(*[new[n].alias(n) if n in new else c for n, c in zip(names, quoted(names))])


def sql(window: int = MIN_WORDS) -> str:
    """The same spans in DuckDB SQL over ``documents``, with every window written out."""
    return f"""
WITH d AS (
  SELECT DISTINCT doc_id, text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
w AS (
  SELECT doc_id, md5(text) AS th, regexp_extract_all(text, '[^ \\t\\n\\r\\f\\v]+') AS ws FROM d),
wins AS (
  SELECT doc_id, th, i, md5(array_to_string(ws[i + 1:i + {window}], ' ')) AS passage
  FROM w, LATERAL (SELECT unnest(range(0, len(ws) - {window - 1})) AS i)),
again AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY passage ORDER BY doc_id, th, i) AS k FROM wins) WHERE k > 1),
edges AS (
  SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id, th ORDER BY i) + {window} THEN 0 ELSE 1 END AS new FROM again),
islands AS (
  SELECT *, sum(new) OVER (PARTITION BY doc_id, th ORDER BY i ROWS UNBOUNDED PRECEDING) AS island FROM edges)
SELECT doc_id, min(i)::INTEGER AS start_word, (max(i) + {window})::INTEGER AS end_word
FROM islands GROUP BY doc_id, th, island
"""
