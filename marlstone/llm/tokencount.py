"""Exact token counts by overlap resynchronisation.

A huge text is encoded in overlapping chunks. Two neighbours are joined at a place in their overlap that is a token
boundary in both and that is *proven stable*: the pretokeniser splits there whatever stands around, so neither the
text cut off behind it nor the text cut off before it can change a token. Such a place lies behind a letter that no
letter follows, behind a digit that no digit follows, or between a non-blank and a blank. If an overlap has none, it
is widened (doubled) until it has one or reaches the text's start or end, so the count always equals that of the
whole text.
"""

from __future__ import annotations

import base64
import os

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame

from marlstone.llm.common import lean, plain, slices

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
STABLE = regex.compile(r"(?<=\p{L})(?!\p{L})|(?<=\p{N})(?!\p{N})|(?<=\S)(?=\s)")
CHUNK_CHARS, OVERLAP_CHARS = 16_384, 256
SCHEMA = "doc_id bigint, n_chars bigint, n_bytes bigint, n_tokens bigint, n_chunks int, n_widened int"
_open: dict[str, tuple[tiktoken.Encoding, np.ndarray]] = {}


def encoder(path: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The encoding of a vocabulary file and the byte length of each of its tokens; read once in each process."""
    if path not in _open:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            sizes[rank] = len(token)
        name = os.path.basename(path)
        _open[path] = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), sizes
    return _open[path]


def _clean(text: str) -> str:
    """Lone surrogates, which UTF-8 cannot hold, become U+FFFD."""
    try:
        text.encode()
    except UnicodeEncodeError:
        text = text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    return text


def _byte_places(text: str, at: list[int]) -> list[int]:
    out, done, total = [], 0, 0
    for p in at:
        total += len(text[done:p].encode())
        done = p
        out.append(total)
    return out


def encode_long(text: str, path: str, chunk: int, overlap: int) -> tuple[list[int], int, int]:
    """Tokens of the whole text, the number of chunks and of widenings."""
    encoding, sizes = encoder(path)
    if len(text) <= chunk:
        return encoding.encode_ordinary(text), 1, 0
    out: list[int] = []
    start, chunks, widened = 0, 0, 0  # ``start`` is a proven boundary, or the text's start
    while start < len(text):
        reach = start + chunk
        if reach >= len(text):
            out += encoding.encode_ordinary(text[start:])
            return out, chunks + 1, widened
        left_end, width = reach, overlap
        while True:
            # the left chunk is text[start:left_end], the right one begins at ``low`` inside it
            low = max(start, left_end - width)
            left = encoding.encode_ordinary(text[start:left_end])
            ends = np.cumsum(sizes[left])
            probe_end = min(len(text), left_end + width)
            right = np.concatenate([[0], np.cumsum(sizes[encoding.encode_ordinary(text[low:probe_end])])])
            stable = [m.start() for m in STABLE.finditer(text, max(low, start + 1), left_end) if low <= m.start() < left_end]
            cut = None
            if stable:
                base = len(text[start:low].encode())
                inside = _byte_places(text[low:left_end], [p - low for p in stable])
                both = set((right + base).tolist())
                for p, b in zip(reversed(stable), reversed(inside)):
                    k = int(np.searchsorted(ends, base + b))
                    if k < len(ends) and ends[k] == base + b and base + b in both:
                        cut = (p, k + 1)
                        break
            if cut:
                out += left[: cut[1]]
                start, chunks = cut[0], chunks + 1
                break
            if low == start and left_end >= len(text):
                out += left
                return out, chunks + 1, widened
            widened += 1
            width *= 2
            left_end = min(len(text), reach + width)
    return out, chunks, widened


def counts(docs: DataFrame, vocabulary: str = VOCABULARY, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """One row for each row of ``docs``: exact ``n_tokens`` of the whole text, and how it was chunked.

    A null text gives null counts, an empty one zeros (and no chunk). An empty table gives no rows. Texts of any length
    are counted whole. A null doc_id, repeated ids and repeated rows are carried through one to one; other columns are
    ignored, whatever their names. No shuffle.
    """

    def work(batches):
        for batch in batches:
            for part in slices(batch):
                rows = []
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    if text is None:
                        rows.append((doc, None, None, None, None, None))
                        continue
                    text = _clean(text)
                    tokens, chunks, widened = encode_long(text, vocabulary, chunk_chars, overlap_chars) if text else ([], 0, 0)
                    rows.append((doc, len(text), len(text.encode()), len(tokens), chunks, widened))
                kinds = [pa.int64()] * 4 + [pa.int32()] * 2
                names = ["doc_id", "n_chars", "n_bytes", "n_tokens", "n_chunks", "n_widened"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    return plain(docs, "doc_id", "text").mapInArrow(lean(work), SCHEMA)
