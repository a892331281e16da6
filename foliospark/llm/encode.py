"""Encoding a whole corpus with a public byte-level BPE tokenizer.

Texts are split by the vocabulary's public pattern. Each piece, as bytes
mapped to Latin-1, runs through an Aho-Corasick automaton of all tokens, which
gives every token that ends at every position in one pass. The encoder then
walks from the left, takes the longest token that starts there, and accepts it
only if it is compatible with the token before; if no length is, it gives up
the previous token for its next shorter one. Two adjacent tokens are
compatible if merging their joined bytes by rank gives just these two; a
sequence whose adjacent pairs are all compatible is the one that the merges
produce. Compatibility is memoised, and so are the pieces.
A position once given up for good is never entered again, so the walk is
linear in the piece.

Defined results: NULL and empty texts give an empty list; a lone surrogate
cannot occur in Parquet strings; repeated rows are encoded alike and all kept.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

VOCABULARY = "byte_bpe_50k"
TOKENIZER_DIR = "/opt/tokenizers"
PIECE_CACHE = 200_000  # pieces remembered per worker, of at most LONG characters
LONG = 64
# The public split pattern of byte-level BPE vocabularies of this family (fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Encoder:
    """Exact byte-level BPE by longest matches and backtracking."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a).decode("latin-1"): int(b) for a, b in map(bytes.split, lines)}
        self.ranks = ranks
        self.split = regex.compile(PATTERN).findall
        self.tokens = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.tokens.add_word(token, (len(token), rank, token))
        self.tokens.make_automaton()
        self.fit: dict[tuple[str, str], bool] = {}
        self.own: dict[str, bool] = {}
        self.pieces: dict[str, list[int]] = {}

    def merged(self, text: str) -> list[str]:
        """The merges applied one by one; only for the joined bytes of two tokens."""
        parts = list(text)
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], len(self.ranks)))
            if parts[best] + parts[best + 1] not in self.ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def compatible(self, a: str, b: str) -> bool:
        known = self.fit.get((a, b))
        if known is None:
            known = self.fit[a, b] = self.merged(a + b) == [a, b]
        return known

    def reachable(self, token: str) -> bool:
        known = self.own.get(token)
        if known is None:
            known = self.own[token] = len(token) == 1 or self.merged(token) == [token]
        return known

    def piece(self, text: str) -> list[int]:
        raw = text.encode("utf-8").decode("latin-1")
        whole = self.ranks.get(raw)
        if whole is not None and self.reachable(raw):
            return [whole]
        starts: list[list[tuple[int, int, str]]] = [[] for _ in raw]
        for end, match in self.tokens.iter(raw):
            starts[end + 1 - match[0]].append(match)  # shorter ones first
        path: list[tuple[int, int, str]] = []
        tried: list[int] = [len(starts[0])]
        dead = bytearray(len(raw) + 1)
        at = 0
        while at < len(raw):
            options, i, step = starts[at], tried[-1], None
            while i:
                i -= 1
                m = options[i]
                if not dead[at + m[0]] and self.reachable(m[2]) and (not path or self.compatible(path[-1][2], m[2])):
                    step = m
                    break
            tried[-1] = i
            if step is None:
                dead[at] = 1
                tried.pop()
                at -= path.pop()[0]
            else:
                path.append(step)
                at += step[0]
                tried.append(len(starts[at]) if at < len(raw) else 0)
        return [m[1] for m in path]

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        cache = self.pieces
        for p in self.split(text) if text else ():
            ids = cache.get(p)
            if ids is None:
                ids = self.piece(p)
                if len(p) <= LONG and len(cache) < PIECE_CACHE:
                    cache[p] = ids
            out += ids
        return out


@functools.cache
def encoder(directory: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY) -> Encoder:
    """One encoder per worker and vocabulary file."""
    return Encoder(f"{directory}/{vocabulary}.tiktoken")


def encode(df: DataFrame, id_col: str, text_col: str, directory: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY) -> DataFrame:
    """id and ids (ARRAY<INT>) of every row; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(directory, vocabulary)
        for batch in batches:
            ids = pa.array([enc.encode(t) for t in batch.column(1).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[id_col, "ids"])

    kind = dict(df.dtypes)[id_col]
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def token_counts(df: DataFrame, keep: list[str], text_col: str, directory: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY) -> DataFrame:
    """The columns to keep and n_tokens of every row, 0 for NULL and empty texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(directory, vocabulary)
        for batch in batches:
            n = pa.array([len(enc.encode(t)) for t in batch.column(len(keep)).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], n], names=[*keep, "n_tokens"])

    kinds = dict(df.dtypes)
    return df.select(*keep, text_col).mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", n_tokens bigint")
