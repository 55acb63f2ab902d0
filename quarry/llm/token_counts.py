"""Token counts by a byte-level BPE vocabulary, in Arrow functions that return lengths only.

Texts are cut into pieces of at most about `piece_bytes` at safe boundaries: before a white-space character that follows a non-white-space
one. There the vocabulary's pattern always begins a new pre-token (white space joins only what comes after it), so the pieces' counts add
up to the whole text's. A stretch without such a boundary is never cut. A long run of white space doesn't go through the pattern, whose
look-ahead would have to go back over it: all of it but its last character is one pre-token by definition (the whole of it at the end of a
text), and is merged as such. Pieces are encoded in batches of about `batch_bytes` of UTF-8 each, however long or short the texts are: long
texts give several batches, short ones share one. The text stays in the task; what leaves it is one number a row.

A null text has a null count, an empty one 0. Texts may be of any length, of whatever they consist. All rows are counted, also those with a
null doc_id and repeated ones (each alike). Extra columns are ignored. Strings that look like special tokens are ordinary text. An empty
table gives no rows.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PIECE_BYTES, BATCH_BYTES = 64 << 10, 1 << 20
#: White space as the pattern has it: the Unicode property, without the information separators that Python adds to it.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SAFE = re.compile(f"(?<=[^{SPACE}])(?=[{SPACE}])")
#: Runs from this length on don't go through the pattern.
LONG_RUN = 2048
_RUN = re.compile(f"[{SPACE}]{{{LONG_RUN},}}")


@functools.lru_cache(2)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding("counts", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, most: int = PIECE_BYTES) -> Iterator[tuple[str, bool]]:
    """The text in pieces of about `most` characters, cut at safe boundaries only, and whether a piece is one pre-token of white space."""
    at = 0
    if len(text) >= LONG_RUN:
        for run in _RUN.finditer(text):
            yield from ((p, False) for p in _cut(text, at, run.start(), most))
            at = run.end() if run.end() == len(text) else run.end() - 1
            yield text[run.start() : at], True
    yield from ((p, False) for p in _cut(text, at, len(text), most))


def _cut(text: str, at: int, end: int, most: int) -> Iterator[str]:
    while end - at > most:
        cut = _SAFE.search(text, at + most, end)
        if not cut or cut.start() >= end:
            break
        yield text[at : cut.start()]
        at = cut.start()
    if at < end:
        yield text[at:end]


def batches_of(texts: Iterator[tuple[int, str | None]], piece_bytes: int, batch_bytes: int) -> Iterator[tuple[list[str], list[int], list[tuple[str, int]]]]:
    """Pieces with their rows in batches of about batch_bytes, and the white-space pre-tokens met on the way."""
    batch, owners, runs, size = [], [], [], 0
    for n, text in texts:
        for piece, run in pieces(text, piece_bytes) if text else ():
            if run:
                runs.append((piece, n))
            else:
                batch.append(piece)
                owners.append(n)
            size += len(piece) if piece.isascii() else len(piece.encode())
            if size >= batch_bytes:
                yield batch, owners, runs
                batch, owners, runs, size = [], [], [], 0
    if batch or runs:
        yield batch, owners, runs


def counts(texts: list[str | None], path: str, piece_bytes: int = PIECE_BYTES, batch_bytes: int = BATCH_BYTES) -> list[int | None]:
    out: list[int | None] = [None if t is None else 0 for t in texts]
    for owner, n in counted(enumerate(texts), path, piece_bytes, batch_bytes):
        out[owner] += n
    return out


def counted(texts: Iterator[tuple[int, str | None]], path: str, piece_bytes: int, batch_bytes: int) -> Iterator[tuple[int, int]]:
    """Row and tokens of each piece."""
    held = encoding(path)
    for batch, owners, runs in batches_of(texts, piece_bytes, batch_bytes):
        yield from zip(owners, map(len, held.encode_ordinary_batch(batch, num_threads=1)), strict=True)
        yield from ((n, len(held._encode_single_piece(run))) for run, n in runs)


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, piece_bytes: int = PIECE_BYTES, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """doc_id and n_tokens of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            n = np.zeros(len(texts), np.int64)
            for row, tokens in counted(((k, texts[k].as_py()) for k in range(len(texts))), vocabulary, piece_bytes, batch_bytes):
                n[row] += tokens
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, mask=texts.is_null().to_numpy(zero_copy_only=False))], ["doc_id", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long")
