"""Byte-level BPE: longest matches from an Aho-Corasick automaton, backtracking over memoised adjacent-token compatibility.

A sequence of tokens is what the ranked merges produce exactly when every two adjacent tokens are: merging their
joined bytes gives back these two tokens. The encoder walks a piece from the left, tries the longest token at each
position and steps to shorter ones (or back) while the pair with the token before is not compatible. The encoding of
every prefix is unique, so a position that fails once fails for good, and a piece is done in linear time.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import held, text_slices

#: The code points with Unicode's White_Space property, as the splitting pattern's \s takes them.
WHITE = "\\t-\\r\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: No match of the pattern crosses the end of one of these chunks, so a chunk's ids don't depend on its neighbours.
CHUNK = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
LONGEST_CACHED = 48


class ByteBPE:
    """cache_entries and pair_entries bound the memory of the two memos; a full memo starts anew."""

    def __init__(self, path: str, pattern: str, cache_entries: int = 500_000, pair_entries: int = 1_000_000):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, lines))}
        self.bytes_of = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = token
        self.decimal = list(map(str, range(len(self.bytes_of))))
        self.pieces = regex.compile(pattern.replace(r"\s", f"[{WHITE}]").replace(r"\S", f"[^{WHITE}]").replace(f"[^[{WHITE}]", f"[^{WHITE}"))
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.whole: dict[int, bool] = {}
        self.shorter_of: dict[int, int] = {}
        self.pairs: dict[int, bool] = {}
        self.chunks: dict[str, tuple[int, ...]] = {}
        self.of_piece: dict[str, tuple[int, ...]] = {}
        self.cache_entries, self.pair_entries = cache_entries, pair_entries

    def merged(self, data: bytes) -> list[int]:
        """The ids that merging by rank gives; only for the bytes of one or two tokens."""
        ranks, none = self.ranks, len(self.bytes_of)
        parts = [data[i : i + 1] for i in range(len(data))]
        of_pair = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:])]
        while of_pair and (least := min(of_pair)) < none:
            i = of_pair.index(least)
            parts[i : i + 2] = [self.bytes_of[least]]
            del of_pair[i]
            if i:
                of_pair[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
            if i < len(of_pair):
                of_pair[i] = ranks.get(parts[i] + parts[i + 1], none)
        return [ranks[p] for p in parts]

    def compatible(self, left: int, right: int) -> bool:
        key = left << 32 | right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= self.pair_entries:
                self.pairs.clear()
            known = self.pairs[key] = self.merged(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        return known

    def reachable(self, token: int) -> bool:
        known = self.whole.get(token)
        if known is None:
            known = self.whole[token] = self.merged(self.bytes_of[token]) == [token]
        return known

    def shorter(self, token: int) -> int:
        """The longest token that is a proper prefix of this one; -1 if none."""
        known = self.shorter_of.get(token)
        if known is None:
            data = self.bytes_of[token]
            known = next((self.ranks[data[:k]] for k in range(len(data) - 1, 0, -1) if data[:k] in self.ranks), -1)
            self.shorter_of[token] = known
        return known

    def piece(self, data: bytes) -> list[int]:
        if (rank := self.ranks.get(data)) is not None:
            return [rank]
        n, bytes_of = len(data), self.bytes_of
        longest = [-1] * n
        for end, token in self.automaton.iter(data.decode("latin-1")):
            longest[end + 1 - len(bytes_of[token])] = token  # ends rise, so the last one kept is the longest
        dead = bytearray(n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            while token >= 0:
                end = at + len(bytes_of[token])
                if not dead[end] and (self.compatible(out[-1], token) if out else self.reachable(token)):
                    break
                token = self.shorter(token)
            if token >= 0:
                out.append(token)
                at = end
                token = longest[at] if at < n else -1
            else:
                if not out:
                    raise ValueError("the ranks lack a token for some byte")
                dead[at] = 1
                last = out.pop()
                at -= len(bytes_of[last])
                token = self.shorter(last)
        return out

    def chunk(self, chunk: str) -> tuple[int, ...]:
        found = self.chunks.get(chunk)
        if found is None:
            parts = self.pieces.findall(chunk)
            found = self.known_piece(chunk) if len(parts) == 1 else tuple(chain.from_iterable(map(self.known_piece, parts)))
            if len(chunk) <= LONGEST_CACHED:
                if len(self.chunks) >= self.cache_entries:
                    self.chunks.clear()
                self.chunks[chunk] = found
        return found

    def known_piece(self, piece: str) -> tuple[int, ...]:
        found = self.of_piece.get(piece)
        if found is None:
            found = tuple(self.piece(piece.encode("utf-8", "replace")))
            if len(piece) <= LONGEST_CACHED:
                if len(self.of_piece) >= self.cache_entries:
                    self.of_piece.clear()
                self.of_piece[piece] = found
        return found

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(map(self.chunk, CHUNK.findall(text)))) if text else []

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def load(path: str, pattern: str = public_tokenizers.PATTERN) -> ByteBPE:
    """One encoder for each Python worker, kept over its tasks."""
    return held(("bpe", path, pattern), lambda: ByteBPE(path, pattern))


def encode(df: DataFrame, path: str, text: str = "text", key: str = "doc_id", pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """key and ids array<int> of each whole text. Null or empty text: no ids. Repeated rows and null keys stay as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        for batch in chain.from_iterable(map(text_slices, batches)):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([bpe.encode(t) for t in batch.column(1).to_pylist()], pa.list_(pa.int32()))], [key, "ids"])

    src = df.select(key, text)
    return src.mapInArrow(run, f"`{key}` {src.schema[0].dataType.simpleString()}, ids array<int>")


def decode(df: DataFrame, path: str, ids: str = "ids", key: str = "doc_id", pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """key and the decoded bytes of each row's ids; null ids: empty bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([bpe.decode(x or []) for x in batch.column(1).to_pylist()], pa.binary())], [key, "decoded"])

    src = df.select(key, ids)
    return src.mapInArrow(run, f"`{key}` {src.schema[0].dataType.simpleString()}, decoded binary")


def digests(df: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode each whole text, decode its ids again, keep digests of both.

    Null or empty text: no ids, digests of nothing. Every row gives a row, repeated or not; other columns aren't read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        sha = hashlib.sha256
        for batch in chain.from_iterable(map(text_slices, batches)):
            n, of_ids, of_bytes = [], [], []
            for text in batch.column(1).to_pylist():
                ids = bpe.encode(text)
                n.append(len(ids))
                of_ids.append(sha(",".join(map(bpe.decimal.__getitem__, ids)).encode()).hexdigest())
                of_bytes.append(sha(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(of_ids), pa.array(of_bytes)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
