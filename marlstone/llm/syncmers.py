"""Document fingerprints from closed syncmers.

A k-mer (k characters) is an anchor when the least of its inner s-mers stands first or last in it. Whether it is
one depends on its own characters alone, so equal passages have equal anchors at equal relative places, whatever
surrounds them. Order and anchor values come from one linear hash of code points modulo 2**64, which SQL can state.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import BATCH_BYTES, U64, lean, plain, slices, sliding_min

SMER, KMER = 12, 60
_rng = np.random.Generator(np.random.PCG64(99))
COEFFICIENTS = _rng.integers(1, 2**63, 64, dtype=np.uint64) * U64(2) + U64(1)
SCHEMA = "doc_id bigint, pos int, anchor bigint"


def smer_hashes(codes: np.ndarray, s: int) -> np.ndarray:
    n = len(codes) - s + 1
    out = np.zeros(max(n, 0), np.uint64)
    for j in range(s if n > 0 else 0):
        out += codes[j : j + n] * COEFFICIENTS[j]
    return out


def anchors(codes: np.ndarray, k: int = KMER, s: int = SMER) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the closed syncmers in code points and a 63-bit value of each k-mer."""
    h = smer_hashes(codes, s)
    w = k - s + 1
    least = sliding_min(h, w)
    m = len(least)
    at = np.flatnonzero((h[:m] == least) | (h[w - 1 : w - 1 + m] == least))
    # the k-mer's value: its s-mers weighted by 1, 3, 5 ... so that order counts
    index = np.arange(len(h), dtype=np.uint64)
    plain_sum, place_sum = np.zeros(len(h) + 1, np.uint64), np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h, out=plain_sum[1:])
    np.cumsum(h * index, out=place_sum[1:])
    total, placed = plain_sum[at + w] - plain_sum[at], place_sum[at + w] - place_sum[at]
    value = U64(2) * placed - (U64(2) * at.astype(np.uint64) - U64(1)) * total
    return at, (value >> U64(1)).astype(np.int64)


def fingerprints(docs: DataFrame, k: int = KMER, s: int = SMER) -> DataFrame:
    """One row for each closed syncmer: ``doc_id``, ``pos`` (characters from 0) and ``anchor``.

    Texts are taken as they are, whole, however long. A null text, an empty one or one shorter than k gives no rows, and
    an empty table none at all; a null doc_id is carried through; texts that share a doc_id and repeated rows each give
    their anchors; where s-mers tie for the least, an edge that equals the least counts. Other columns are ignored,
    whatever their names. No shuffle.

    Of the k-mers 2 in k - s + 1 are anchors. A closed syncmer begins in every k - s + 1 characters or fewer, so a shared
    passage of 2 * k - s - 1 characters (107) surely has a common anchor; a shorter one of at least k may have.
    """
    if not 0 < s <= min(k, 64):
        raise ValueError("0 < s <= k, and s <= 64")

    def work(batches):
        for batch in batches:
            for part in slices(batch, limit=BATCH_BYTES // 3):
                ids, places, values = [], [], []
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    if not text or len(text) < k:
                        continue
                    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
                    at, value = anchors(codes, k, s)
                    if len(at):
                        ids.append((doc, len(at)))
                        places.append(at)
                        values.append(value)
                if ids:
                    n = [c for _, c in ids]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([d for d, _ in ids], pa.int64()).take(pa.array(np.repeat(np.arange(len(n)), n))),
                            pa.array(np.concatenate(places).astype(np.int32)),
                            pa.array(np.concatenate(values)),
                        ],
                        names=["doc_id", "pos", "anchor"],
                    )

    return plain(docs, "doc_id", "text").mapInArrow(lean(work), SCHEMA)


def matches(docs: DataFrame, k: int = KMER, s: int = SMER) -> DataFrame:
    """Links between documents by shared anchors: ``doc_b`` and ``doc_a``, the least document that has the anchor
    (doc_a < doc_b), ``shift`` (pos_b - pos_a) and how many anchors agree on it.

    A document is linked to the first holder of each of its anchors, not to every one: that connects all documents that
    share an anchor, in as many rows as there are anchors, however many documents share one. A passage moved as a block
    shows as many anchors with one shift. Rows with null doc_id are left out; rows repeated as they are count once.
    """
    found = fingerprints(docs, k, s).where(F.col("doc_id").isNotNull()).distinct()
    first = found.groupBy("anchor").agg(F.min(F.struct("doc_id", "pos")).alias("a"), F.count("*").alias("n")).where("n > 1").select("anchor", "a")
    return (
        found.join(first, "anchor")
        .where("doc_id > a.doc_id")
        .groupBy(F.col("a.doc_id").alias("doc_a"), F.col("doc_id").alias("doc_b"), (F.col("pos") - F.col("a.pos")).alias("shift"))
        .agg(F.count("*").alias("n_anchors"))
    )


def sql(k: int = KMER, s: int = SMER) -> str:
    """The same anchors in DuckDB SQL over ``documents`` whose doc_ids are not null and different."""
    w = k - s + 1
    lead = " + ".join(f"lead(code, {j}) OVER w * {int(COEFFICIENTS[j])}::HUGEINT" for j in range(s))
    return f"""
WITH chars AS (
  SELECT doc_id, u.pos::BIGINT - 1 AS pos, unicode(u.c)::HUGEINT AS code, length(text) AS n
  FROM documents, LATERAL (SELECT unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) AS pos) u
  WHERE length(text) >= {k} AND doc_id IS NOT NULL),
smers AS (
  SELECT doc_id, pos, n, ({lead}) % 18446744073709551616::HUGEINT AS h
  FROM chars WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
kmers AS (
  SELECT doc_id, pos, n, h, lead(h, {w - 1}) OVER w AS last_h,
    min(h) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {w - 1} FOLLOWING) AS least,
    sum(h) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {w - 1} FOLLOWING) AS total,
    sum(h * pos) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {w - 1} FOLLOWING) AS placed
  FROM smers WHERE pos <= n - {s} WINDOW w AS (PARTITION BY doc_id ORDER BY pos))
SELECT doc_id, pos::INTEGER AS pos,
  ((2 * placed - (2 * pos - 1) * total) % 18446744073709551616::HUGEINT // 2)::BIGINT AS anchor
FROM kmers WHERE pos <= n - {k} AND (h = least OR last_h = least)
"""
