"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of one fixed public vocabulary. A word's probability under a language
is the sum over all ways to write it as pieces, computed by the forward algorithm; a text's is the product over its
words. Pieces never cross white space, so each distinct word is scored once per slice. The piece probabilities come
from expectation maximisation (forward-backward over the same lattices) on a bounded sample of rows whose ``lang`` is
known. A character that no piece covers costs its UTF-8 bytes at a fixed rate; no longer piece has such a character
(``Vocabulary`` checks it), so every segmentation passes through it and its cost is a factor of the whole word.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from marlstone.llm.common import U64, encode_words, lean, mix, plain, row_sums, slices

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
FIT_ROWS, LANGS_AT_ONCE, ROUNDS, BYTE_LOG = 120, 64, 4, math.log(1 / 256) - 6.0
RUN = 24  # characters of the runs in which longer words are learnt from
SCALED, STRIDE, LEAST = 24, 8, 1e-10  # words of more places are rescaled as they are scored, after so many places each; the least probability of a piece
SCHEMA = "doc_id bigint, lang string, predicted string, log_prob double, margin double, n_words bigint"
CHUNK_WORDS, SLOT_BITS = 16_384, 20
HASH_BASE = U64(0x9E3779B97F4A7C15)


class Vocabulary:
    """The pieces of a public tokenizer, found in arrays of code points by a hash table that numpy can probe.

    Row numbers of a probability table: 0..n-1 the pieces, n+0..n+3 an uncovered character of 1 to 4 bytes, n+4 none.
    """

    _open: dict[str, Vocabulary] = {}

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        self.n, self.longest = len(pieces), max(map(len, pieces))
        single = {x for x in pieces if len(x) == 1}
        if not all(single.issuperset(x) for x in pieces):
            raise ValueError("a character of some piece is no piece itself")
        hashes = np.array([self._hash(x) for x in pieces], np.uint64)
        self.order = np.argsort(hashes)
        self.hashes, self.sorted = hashes, hashes[self.order]
        slot = (hashes >> U64(64 - SLOT_BITS)).astype(np.int64)
        self.slots = np.full(1 << SLOT_BITS, -1, np.int32)
        self.slots[slot] = np.arange(self.n)
        used, times = np.unique(slot, return_counts=True)
        self.slots[used[times > 1]] = -2  # several pieces share the slot: they are looked up by bisection

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(HASH_BASE) + ord(c) + 1) % 2**64
        return int(mix(np.array([h], np.uint64))[0])

    @classmethod
    def at(cls, path: str) -> Vocabulary:
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece number by hash, n + 4 where there is none."""
        h = mix(h)
        k = self.slots[(h >> U64(64 - SLOT_BITS)).astype(np.int64)]
        hard = k == -2
        if hard.any():
            at = np.minimum(np.searchsorted(self.sorted, h[hard]), self.n - 1)
            k[hard] = self.order[at]
        wrong = (k < 0) | (self.hashes[np.maximum(k, 0)] != h)
        k[wrong] = self.n + 4
        return k

    def lattices(self, words: list[str]):
        """For groups of words of one length: their numbers, and by piece length l the piece that starts at each place."""
        by_length: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_length.setdefault(len(w), []).append(i)
        for n, members in sorted(by_length.items()):
            for i in range(0, len(members), CHUNK_WORDS):
                own = members[i : i + CHUNK_WORDS]
                joined = "".join(["\u2581" + words[k] for k in own]).encode("utf-32-le", "surrogatepass")
                codes = np.frombuffer(joined, np.uint32).reshape(len(own), n + 1).T.astype(np.uint64)  # place x word
                ids, h = [], np.zeros_like(codes)
                for size in range(1, min(self.longest, n + 1) + 1):
                    h = h[: n + 2 - size] * HASH_BASE + codes[size - 1 :] + U64(1)
                    found = self.find(h)
                    if size == 1:
                        bare = found == self.n + 4
                        c = codes[bare]
                        found[bare] = self.n + (c > 0x7F).astype(np.int32) + (c > 0x7FF) + (c > 0xFFFF)
                    ids.append(found)
                yield np.array(own), ids


def extended(table: np.ndarray) -> np.ndarray:
    """A table of piece probabilities with the rows for uncovered characters, whose cost ``uncovered`` adds, and for none."""
    return np.concatenate([table, np.ones((4, table.shape[1])), np.zeros((1, table.shape[1]))])


def uncovered(ids: list[np.ndarray], n: int) -> np.ndarray:
    """Log cost by word of the characters that no piece covers."""
    size = ids[0] - (n - 1)  # 1 to 4 bytes
    return BYTE_LOG * np.where((size > 0) & (size < 5), size, 0).sum(axis=0)


def forward(ids: list[np.ndarray], rows: np.ndarray, scaled: bool = True) -> tuple[list[np.ndarray], np.ndarray]:
    """Forward sums by place (words x languages), those of long words rescaled, and the logarithm of the scale.

    A place is at least ``LEAST`` times the one before, so ``STRIDE`` places and the
    longest piece before them stay far inside the range of a double.
    """
    places, words = ids[0].shape
    alpha, logs = [np.ones((words, rows.shape[1]))], np.zeros((words, rows.shape[1]))
    for end in range(1, places + 1):
        total = np.zeros((words, rows.shape[1]))
        for size in range(1, min(len(ids), end) + 1):
            k = ids[size - 1][end - size]
            if size == 1 or (k < rows.shape[0] - 1).any():
                total += alpha[end - size] * rows[k]
        alpha.append(total)
        if scaled and end % STRIDE == 0 and places > SCALED:
            for j in range(max(0, end - len(ids)), end + 1):
                alpha[j] = alpha[j] / total
            logs += np.log(total)
    return alpha, logs


def word_scores(words: list[str], rows: np.ndarray, path: str) -> np.ndarray:
    """Log probability of each word under each language, over all its segmentations."""
    out = np.zeros((len(words), rows.shape[1]))
    for own, ids in Vocabulary.at(path).lattices(words):
        alpha, logs = forward(ids, rows)
        out[own] = np.log(alpha[-1]) + logs + uncovered(ids, rows.shape[0] - 5)[:, None]
    return out


def fit_pieces(words: list[str], counts: np.ndarray, path: str, rounds: int = ROUNDS) -> np.ndarray:
    """Piece probabilities of one language by expectation maximisation over all segmentations.

    Long words, as scripts without spaces have them, are cut into runs, each learnt from as a word.
    """
    vocabulary = Vocabulary.at(path)
    runs: dict[str, float] = {}
    for w, n in zip(words, counts.tolist(), strict=True):
        for i in range(0, len(w), RUN):
            run = w[i : i + RUN]
            runs[run] = runs.get(run, 0.0) + n
    groups = list(vocabulary.lattices(list(runs)))
    weight = np.array(list(runs.values()))
    prob = np.full(vocabulary.n, 1.0 / vocabulary.n)
    for _ in range(rounds):
        rows, expected = extended(prob[:, None]), np.zeros(vocabulary.n + 5)
        for own, ids in groups:
            places = len(ids[0])
            alpha, _ = forward(ids, rows, scaled=False)
            share = weight[own] / alpha[-1][:, 0]
            beta = [None] * places + [share]
            for start in range(places - 1, -1, -1):
                beta[start] = np.zeros(len(own))
                for size in range(1, min(len(ids), places - start) + 1):
                    k = ids[size - 1][start]
                    through = rows[k, 0] * beta[start + size]
                    beta[start] += through
                    expected += np.bincount(k, alpha[start][:, 0] * through, vocabulary.n + 5)
        expected = expected[: vocabulary.n] + 0.05
        prob = np.maximum(expected / expected.sum(), LEAST)
    return prob


def fit(docs: DataFrame, rows: int = FIT_ROWS, path: str = VOCABULARY) -> tuple[list[str], np.ndarray]:
    """Languages and their piece probabilities (pieces x languages), each language learnt in an executor.

    For each value of ``lang``, the ``rows`` distinct rows (doc_id, text length) whose hash is lowest: a bounded sample,
    the same however the table is partitioned. A row that is there many times counts once. No such rows: no languages.
    """
    known = plain(docs, "doc_id", "text", "lang").where("lang IS NOT NULL AND text IS NOT NULL AND length(text) > 0")
    keyed = known.withColumn("_h", F.xxhash64("doc_id", F.length("text")))
    totals = keyed.groupBy("lang").agg(F.approx_count_distinct("_h", 0.02).alias("n")).collect()
    if not totals:
        return [], np.zeros((1, 0))
    bounds = [(r["lang"], min(2**63 - 1, int(-(2**63) + 2**64 * min(1.0, (2 * rows + 20) / max(1, r["n"]))))) for r in totals]
    near = F.broadcast(docs.sparkSession.createDataFrame(bounds, "lang string, _bound bigint"))
    once = keyed.join(near, "lang").where("_h <= _bound").groupBy("lang", "_h").agg(F.min("text").alias("text"))
    picked = once.withColumn("_n", F.row_number().over(W.partitionBy("lang").orderBy("_h"))).where(F.col("_n") <= rows)

    def learn(table: pa.Table) -> pa.Table:
        _, codes, words = encode_words(table.column("text").combine_chunks())
        prob = fit_pieces(words.to_pylist(), np.bincount(codes, minlength=len(words)), path)
        return pa.table({"lang": table.column("lang").slice(0, 1), "prob": pa.array([prob.tobytes()], pa.binary())})

    learnt = picked.select("lang", "text").groupBy("lang").applyInArrow(learn, "lang string, prob binary").collect()
    learnt.sort(key=lambda r: r["lang"])
    return [r["lang"] for r in learnt], np.stack([np.frombuffer(r["prob"], np.float64) for r in learnt], axis=1)


def identify(docs: DataFrame, rows: int = FIT_ROWS, path: str = VOCABULARY, model: tuple[list[str], np.ndarray] | None = None) -> DataFrame:
    """One row for each row of ``docs``: declared ``lang``, ``predicted`` language, its ``log_prob`` for a character,
    and ``margin`` over the second (in nats a character; 0 if there is but one language).

    A null text, one without words (an empty one, or white space), or a table without any labelled row: predicted,
    log_prob and margin are null. An empty table gives no rows. Texts of any length are scored whole; a word of any
    length is scored over all its segmentations. Ties go to the language whose name sorts first. Null doc_id and
    repeated rows are carried through one to one. Other columns are ignored, whatever their names. The table of
    probabilities is broadcast: 32,000 pieces times the languages present. Scores are made for ``LANGS_AT_ONCE``
    languages at a time.
    """
    langs, table = model or fit(docs, rows, path)
    shared = docs.sparkSession.sparkContext.broadcast(extended(table))

    def work(batches):
        for batch in batches:
            for part in slices(batch):
                offsets, codes, words = encode_words(part.column("text"))
                n = np.diff(offsets)
                listed = words.to_pylist()
                predicted, best, margin = [None] * len(n), [None] * len(n), [None] * len(n)
                if langs and listed:
                    sizes = np.array([len(w) + 1 for w in listed], np.int64)
                    chars = row_sums(sizes[codes], offsets)
                    some = (shared.value[:, k : k + LANGS_AT_ONCE] for k in range(0, len(langs), LANGS_AT_ONCE))
                    totals = np.concatenate([row_sums(word_scores(listed, part_of, path)[codes], offsets) for part_of in some], axis=1)
                    order = np.argsort(-totals, axis=1, kind="stable")
                    for i in np.flatnonzero(n):
                        a = totals[i, order[i, 0]]
                        b = totals[i, order[i, 1]] if len(langs) > 1 else a
                        predicted[i], best[i], margin[i] = langs[order[i, 0]], a / chars[i], (a - b) / chars[i]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("lang"), pa.array(predicted, pa.string()), pa.array(best, pa.float64()), pa.array(margin, pa.float64()), pa.array(n)],
                    names=["doc_id", "lang", "predicted", "log_prob", "margin", "n_words"],
                )

    return plain(docs, "doc_id", "text", "lang").mapInArrow(lean(work), SCHEMA)
