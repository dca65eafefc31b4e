"""Language-model scoring by compression: zstandard sizes under in-domain and general dictionaries.

What a side (in-domain: documents labelled of good quality; general: all) knows of the corpus has two parts, both from
counts over all of it.

1. Words. Those that save most (count times length) fill a raw-content dictionary that grows with the corpus, the best
   last, where matches cost least. A worker loads the two dictionaries.
2. Segments. Texts are cut into runs of words at places that the words themselves decide, so equal passages have equal
   segments. Every segment that occurs in more than one document is in the side's dictionary; as there may be as many as
   the corpus has, they stay a table, from which each document gets those it has in common with other documents.

A text's size under a side is that of its segments known to the side, each a reference of ``REFERENCE`` bytes, and of
the rest of it compressed by zstandard under the side's words. Eight times the size over the text's bytes estimates a
cross-entropy in bits a byte, and the difference of the two, general minus in-domain, is the score: the higher, the more
in-domain.

Words of in-domain documents are counted from these documents alone: a Bloom filter of fixed size lets hardly any other
text into the join with the labels. All texts are shuffled once, to meet their segments.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import SPACE, U64, Grams, buffers, durable, encode_words, lean, plain, slices, word_hashes, word_spans

DICTIONARY_BYTES, CORPUS_SHARE, LEVEL, MIN_LETTERS = 64 << 10, 4096, 3, 3  # a word of fewer letters is no shorter as a match
PIECES = 1 << 16  # turned around at a time
SEGMENT, LEAST_WORDS, REFERENCE = 16, 8, 6  # mean words of a segment, words of the shortest, bytes of a reference to one
BLOOM_BITS = 1 << 26  # of the filter, 8 MB at any size; if it fills up, more texts get into the join, which decides
RUN = 32  # letters of the longest word
HELD_WORDS = 300_000  # counted words that a task combines before it sends them on
SCHEMA = "doc_id bigint, n_bytes bigint, in_bits double, general_bits double, score double"


def good_ids(labels: DataFrame) -> DataFrame:
    """The doc_ids labelled of good quality, each once."""
    return plain(labels, "doc_id", "quality").where("doc_id IS NOT NULL AND quality = 1").select("doc_id").distinct()


def bloom(ids: DataFrame) -> np.ndarray:
    """A Bloom filter of ``BLOOM_BITS`` bits over doc_ids, three bits each."""
    h = F.xxhash64("doc_id")
    places = F.array(*(F.shiftrightunsigned(h, 20 * k).bitwiseAND(F.lit(BLOOM_BITS - 1)) for k in (0, 1)), F.xxhash64(h).bitwiseAND(F.lit(BLOOM_BITS - 1)))
    bits = ids.select(F.explode(places).alias("p")).select((F.col("p") / 64).cast("bigint").alias("w"), F.expr("shiftleft(1L, cast(p % 64 as int))").alias("b"))
    table = bits.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(BLOOM_BITS // 64, np.uint64)
    out[table.column("w").to_numpy()] = table.column("b").to_numpy().view(np.uint64)
    return out


def in_domain(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The texts of documents labelled of good quality."""
    good = durable(good_ids(labels))
    shared = docs.sparkSession.sparkContext.broadcast(bloom(good))

    @F.pandas_udf("boolean")
    def maybe(a: pd.Series, b: pd.Series) -> pd.Series:
        out = np.ones(len(a), bool)
        for p in (a.to_numpy(np.int64), a.to_numpy(np.int64).view(np.uint64) >> np.uint64(20), b.to_numpy(np.int64)):
            p = p.astype(np.uint64) & np.uint64(BLOOM_BITS - 1)
            out &= (shared.value[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) == 1
        return pd.Series(out)

    h = F.xxhash64("doc_id")
    texts = plain(docs, "doc_id", "text").where("text IS NOT NULL AND doc_id IS NOT NULL").where(maybe(h, F.xxhash64(h)))
    return texts.hint("merge").join(good, "doc_id", "left_semi").select("text")


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n): occurrences of each word in all texts. A word of more than ``RUN`` letters, as scripts without spaces
    have them, is counted in runs of so many."""

    def count(batches):
        held: list[pa.Table] = []
        rows = 0
        for batch in batches:
            for part in slices(batch):
                _, codes, words = encode_words(part.column("text"))
                new = pa.table({"word": words.cast(pa.string()), "n": pa.array(np.bincount(codes, minlength=len(words)))})
                long = pc.greater(pc.utf8_length(new.column("word")), RUN)
                if pc.any(long).as_py():
                    cut = new.filter(long)
                    runs = [(w[i : i + RUN], n) for w, n in zip(*(cut.column(c).to_pylist() for c in ("word", "n"))) for i in range(0, len(w), RUN)]
                    new = pa.concat_tables([new.filter(pc.invert(long)), pa.table({"word": [w for w, _ in runs], "n": [n for _, n in runs]})])
                held.append(new)
                rows += new.num_rows
                if rows >= HELD_WORDS:
                    yield from _summed(held)
                    held, rows = [], 0
        if held:
            yield from _summed(held)

    return texts.select("text").mapInArrow(lean(count), "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _summed(held: list[pa.Table]) -> list[pa.RecordBatch]:
    table = pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum")])
    return table.select(["word", "n_sum"]).rename_columns(["word", "n"]).combine_chunks().to_batches(max_chunksize=50_000)


def segments(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, first byte, end byte and hash of each segment: words up to one whose hash says so, ``LEAST_WORDS`` or more.
    The blank behind a segment belongs to it."""
    starts, ends, woff = word_spans(raw, off, SPACE)
    words = word_hashes(raw, starts, ends)
    last = words % U64(SEGMENT) == 0
    last[woff[1:][woff[1:] > 0] - 1] = True
    end = np.flatnonzero(last) + 1
    first = np.concatenate([[0], end[:-1]]) if len(end) else end
    n = end - first
    some = n >= LEAST_WORDS
    first, end, n = first[some], end[some], n[some]
    row = np.searchsorted(woff, first, side="right") - 1
    until = np.where(end < woff[row + 1], starts[np.minimum(end, max(len(starts) - 1, 0))], off[row + 1]) if len(end) else end
    return row, starts[first], until, Grams(words).at(first, n).view(np.int64)


def shared_segments(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, general, inside): by (doc_id, text), the hashes of its segments that another row has too, and of those that
    another in-domain row has."""

    def cut(batches):
        for batch in batches:
            for part in slices(batch):
                row, _, _, h = segments(*buffers(part.column("text")))
                pairs = np.unique(np.stack([row, h], axis=1), axis=0) if len(row) else np.zeros((0, 2), np.int64)
                at = np.searchsorted(pairs[:, 0], np.arange(part.num_rows + 1))
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(pairs[:, 1]))
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("doc_id"), lists], names=["key", "doc_id", "segments"])

    texts = plain(docs, "doc_id", "text").where("text IS NOT NULL").withColumn("key", F.xxhash64("doc_id", "text"))
    slim = texts.mapInArrow(lean(cut), "key bigint, doc_id bigint, segments array<bigint>").where(F.size("segments") > 0)
    good = good_ids(labels).withColumn("good", F.lit(1))
    slim = durable(slim.hint("merge").join(good, "doc_id", "left").select("key", F.coalesce("good", F.lit(0)).alias("good"), "segments"))
    one = slim.select("key", "good", F.explode("segments").alias("s"))
    counts = one.groupBy("s").agg(F.count("*").alias("n"), F.sum("good").alias("n_in")).where("n > 1")
    found = one.hint("merge").join(counts, "s").select("key", "s", (F.col("n_in") > F.col("good")).alias("inside"))
    return found.groupBy("key").agg(F.collect_set("s").alias("general"), F.collect_set(F.when(F.col("inside"), F.col("s"))).alias("inside"))


def dictionary_bytes(total: int) -> int:
    """Bytes of each dictionary for a corpus whose words have ``total`` bytes: 64 KB and a 4,096th of them."""
    return DICTIONARY_BYTES + total // CORPUS_SHARE


def assemble(words: pa.Table, size: int) -> bytes:
    """A raw dictionary of the words (word, v) that save most, the best last. A word that does not fit is passed over."""
    words = words.sort_by([("v", "descending"), ("word", "ascending")])
    pieces = pc.utf8_replace_slice(words.column("word").cast(pa.large_string()), 0, 0, " ")
    room, taken = size, []
    for i, n in enumerate(pc.binary_length(pieces).to_pylist()):
        if n <= room:
            room -= n
            taken.append(i)
    return b"".join(x.encode() for i in range(len(taken), 0, -PIECES) for x in pieces.take(pa.array(taken[max(0, i - PIECES) : i][::-1])).to_pylist())


def best(counts: DataFrame, n: str, size: int) -> bytes:
    """The dictionary of one side. Only the words that fit are brought to the driver: the bytes of the words of each value
    say down to which value all fit, and of the next value the first words in order fill the rest."""
    rated = counts.where((F.length("word") >= MIN_LETTERS) & (F.col(n) > 0))
    rated = rated.select("word", (F.col(n) * (F.octet_length("word") - 1)).alias("v"))
    levels = rated.groupBy("v").agg(F.sum(F.octet_length("word") + 1).alias("b")).toArrow().sort_by([("v", "descending")])
    v, used = levels.column("v").to_numpy(), np.cumsum(levels.column("b").to_numpy())
    fits = int(np.searchsorted(used, size, side="right"))
    parts = []
    if fits:
        parts.append(rated.where(F.col("v") >= int(v[fits - 1])).toArrow())
    if fits < len(v):
        room = size - (int(used[fits - 1]) if fits else 0)
        parts.append(rated.where(F.col("v") == int(v[fits])).orderBy("word").limit(room // (MIN_LETTERS + 1) + 1).toArrow())
    return assemble(pa.concat_tables(parts), size) if parts else b""


def dictionaries(docs: DataFrame, labels: DataFrame, size: int | None = None) -> tuple[bytes, bytes]:
    """(in-domain, general) dictionaries, of at most ``size`` bytes each, or as many as ``dictionary_bytes`` gives."""
    known = plain(docs, "doc_id", "text").where("text IS NOT NULL")
    counts = durable(word_counts(known))
    if size is None:
        size = dictionary_bytes(counts.agg(F.sum(F.col("n") * F.octet_length("word")).alias("b")).first()["b"] or 0)
    return best(durable(word_counts(in_domain(docs, labels))), "n", size), best(counts, "n", size)


@functools.lru_cache(maxsize=2)
def compressor(dictionary: bytes, level: int = LEVEL) -> zstandard.ZstdCompressor:
    """A compressor that reaches all of the dictionary: its window spans it, and its table has a place for each byte.

    The tables that zstd chooses by level index no more than the last MB of a dictionary, and those of the levels below
    5 never more than 16 MB. A worker keeps the last two, as large ones take seconds to build.
    """
    flags = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
    if len(dictionary) < 8:
        return zstandard.ZstdCompressor(level=level, **flags)
    log = min(29, max(17, (len(dictionary) - 1).bit_length()))
    reach = zstandard.ZstdCompressionParameters.from_level(level, window_log=max(21, log + 1), chain_log=log, hash_log=log, search_log=4, min_match=5, strategy=zstandard.STRATEGY_GREEDY, **flags)
    data = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    data.precompute_compress(compression_params=reach)
    return zstandard.ZstdCompressor(dict_data=data, compression_params=reach)


def without(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The bytes outside the spans, which come in order."""
    out, done = [], 0
    for a, b in spans:
        out.append(raw[done:a])
        done = b
    return b"".join([*out, raw[done:]])


def scores(docs: DataFrame, labels: DataFrame, size: int | None = None, dicts: tuple[bytes, bytes] | None = None) -> DataFrame:
    """One row for each row of ``docs``: UTF-8 bytes, bits a byte under each side, and their difference.

    A null text gives nulls; an empty one 0 bytes and null bits. An empty table gives no rows. Texts of any length are
    scored whole. Without any document labelled of good quality the in-domain side knows nothing. Words that tie in value
    are taken in the order of their text; a word that does not fit into what is left of a dictionary is passed over. Null
    doc_id and repeated rows are carried through one to one and counted each, so a row
    repeated as it is shares its segments with itself. Other columns are ignored, whatever their names. The two
    dictionaries of words are broadcast. They grow with the corpus (``dictionary_bytes``), and a worker's two compressors
    take some ten times their bytes.
    """
    shared = docs.sparkSession.sparkContext.broadcast(dicts or dictionaries(docs, labels, size))
    keyed = plain(docs, "doc_id", "text").withColumn("key", F.xxhash64("doc_id", "text"))
    joined = keyed.hint("merge").join(shared_segments(docs, labels), "key", "left").select("doc_id", "text", "general", "inside")

    def work(batches):
        under = [compressor(d) for d in shared.value]
        for batch in batches:
            for part in slices(batch):
                known = [[frozenset(x) if x else frozenset() for x in part.column(c).to_pylist()] for c in ("inside", "general")]
                raw, off = buffers(part.column("text"))
                data, off = raw.tobytes(), off.tolist()
                spans: dict[int, list[tuple[int, int, int]]] = {}
                some = [i for i, s in enumerate(known[1]) if s]
                if some:
                    row, a, b, h = segments(raw, np.array(off))
                    for x in zip(row.tolist(), a.tolist(), b.tolist(), h.tolist()):
                        if known[1][x[0]]:
                            spans.setdefault(x[0], []).append(x[1:])
                rows = []
                for i, null in enumerate(part.column("text").is_null().to_pylist()):
                    n = off[i + 1] - off[i]
                    if null or not n:
                        rows.append((None if null else 0, None, None, None))
                        continue
                    text, bits = data[off[i] : off[i + 1]], []
                    for side, c in zip(known, under):
                        own = [(a - off[i], b - off[i]) for a, b, h in spans.get(i, ()) if h in side[i]]
                        rest = without(text, own)
                        bits.append(8 * (REFERENCE * len(own) + (len(c.compress(rest)) if rest else 0)) / n)
                    rows.append((n, *bits, bits[1] - bits[0]))
                kinds = [pa.int64(), pa.float64(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))],
                    names=["doc_id", "n_bytes", "in_bits", "general_bits", "score"],
                )

    return joined.mapInArrow(lean(work), SCHEMA)
