"""Byte-level BPE by longest matches and backtracking.

A sequence of tokens is the encoding of its bytes exactly when every two neighbours are the encoding of
theirs (and each token is its own encoding). So a piece is encoded from the left by the longest token
that fits behind the one before, going back over a token where none does; positions found to lead
nowhere are marked, so the work stays linear in the piece. The longest token at each position comes
from one pass of an Aho-Corasick automaton, whose keys are the tokens' bytes written as Latin-1
characters; whether two tokens may stand side by side is worked out by undoing merges and remembered.

Defined results: a null text is the empty text and has no tokens; empty tables stay empty; other
columns are not touched.
"""

from __future__ import annotations

import base64
import hashlib
from array import array  # of four-byte items on all platforms of Spark, little-endian
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .pieces import CutTexts
from .worker import held

MOST_BYTES = 64 << 20  # of a vocabulary file that is sent to the workers
MOST_PAIRS = 250_000  # of neighbours known to fit or not, about 30 MB
_NONE = -1


def read_ranks(content: bytes) -> list[bytes]:
    """Token bytes by rank, from lines of base64 and rank."""
    pairs = [line.split() for line in content.splitlines() if line.strip()]
    tokens = [b""] * len(pairs)
    for encoded, rank in pairs:
        tokens[int(rank)] = base64.b64decode(encoded)
    return tokens


class BacktrackEncoder:
    def __init__(self, tokens: list[bytes]) -> None:
        self.tokens = tokens
        self.rank = {token: k for k, token in enumerate(tokens)}
        self._length = [len(token) for token in tokens]
        self._automaton = ahocorasick.Automaton()
        for k, token in enumerate(tokens):
            self._automaton.add_word(token.decode("latin-1"), k)
        self._automaton.make_automaton()
        self._shorter = [self._prefix(token) for token in tokens]
        self._merged: dict[tuple[int, int], int] = {}
        self._parts: list[tuple[int, int]] = []
        self._fits: dict[int, bool] = {}
        #: Tokens that no merges make; they stand only for a piece that they fill.
        self._unmade: set[int] = set()
        for k, token in enumerate(tokens):
            self._parts.append(self._split(k, token))
        self._fits.clear()

    def _prefix(self, token: bytes) -> int:
        for end in range(len(token) - 1, 0, -1):
            if (k := self.rank.get(token[:end])) is not None:
                return k
        return _NONE

    def _split(self, k: int, token: bytes) -> tuple[int, int]:
        """The two tokens whose merge makes token ``k``; a byte is its own part."""
        left = self._shorter[k]
        while left != _NONE:
            right = self.rank.get(token[self._length[left]:])
            if left < k and right is not None and right < k and self._may_follow(left, right):
                self._merged[left, right] = k
                return left, right
            left = self._shorter[left]
        if len(token) > 1:
            self._unmade.add(k)
        return k, k

    def _may_follow(self, left: int, right: int) -> bool:
        """Whether the bytes of both encode to these two: no merge across the seam, at any step of
        the merges that made them, comes before the merges that hide it."""
        merged, parts, limit = self._merged, self._parts, len(self.tokens)
        while True:
            if merged.get((left, right), limit) < limit:
                return False
            undo_left = left > right
            for _ in range(2):
                if undo_left:
                    limit, left = left, parts[left][1] if left < len(parts) else left
                    if left != limit:
                        break
                else:
                    limit, right = right + 1, parts[right][0] if right < len(parts) else right
                    if right + 1 != limit:
                        break
                undo_left = not undo_left
            else:
                return True

    def may_follow(self, left: int, right: int) -> bool:
        pair = left * len(self.tokens) + right
        known = self._fits.get(pair)
        if known is None:
            if len(self._fits) >= MOST_PAIRS:
                self._fits.clear()
            known = self._fits[pair] = self._may_follow(left, right)
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.rank.get(piece)
        if whole is not None:
            return [whole]
        longest = [_NONE] * len(piece)
        length, shorter, unmade = self._length, self._shorter, self._unmade
        for end, k in self._automaton.iter(piece.decode("latin-1")):  # ends ascend: the last is the longest
            if k not in unmade:
                longest[end + 1 - length[k]] = k
        open_ = bytearray(b"\x01") * (len(piece) + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < len(piece):
            last = out[-1] if out else _NONE
            while token != _NONE:
                end = at + length[token]
                if open_[end] and token not in unmade and (last == _NONE or self.may_follow(last, token)):
                    break
                token = shorter[token]
            if token != _NONE:
                out.append(token)
                at = end
                token = longest[at] if at < len(piece) else _NONE
            elif last == _NONE:
                raise ValueError("the vocabulary lacks a byte of the text")
            else:
                open_[at] = 0
                token = out.pop()
                at -= length[token]
        return out


def _encoder(content: bytes, pattern: str) -> tuple[BacktrackEncoder, CutTexts]:
    """Made once in a worker for each vocabulary and pattern."""

    def made() -> tuple[BacktrackEncoder, CutTexts]:
        encoder, matches = BacktrackEncoder(read_ranks(content)), regex.compile(pattern)

        def make(unit: str) -> bytes:
            return b"".join([array("I", encoder.encode_piece(piece.encode())).tobytes() for piece in matches.findall(unit)])

        return encoder, CutTexts(lambda units: [make(unit) for unit in units])

    return held(("backtrack", hashlib.sha256(content + pattern.encode()).digest()), made)


def vocabulary(path: str) -> bytes:
    """The content of a vocabulary file on the driver; its size is checked as it is sent to all workers."""
    with open(path, "rb") as file:
        content = file.read(MOST_BYTES + 1)
    if len(content) > MOST_BYTES:
        raise ValueError(f"{path} has more than {MOST_BYTES} bytes")
    return content


def _on_ids(content, pattern: str, make_row, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, cut = _encoder(content.value, pattern)
        for batch in batches:
            columns: list[list] = [[] for _ in names]
            for ids in cut.encode_all(batch.column("text").to_pylist()):
                for column, value in zip(columns, make_row(encoder, ids), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column("id"), *map(pa.array, columns)], names=["id", *names])

    return run


def decode(tokens: list[bytes], ids: bytes) -> bytes:
    return b"".join(map(tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _digests(encoder: BacktrackEncoder, ids: bytes) -> tuple:
    back = decode(encoder.tokens, ids)
    return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back).hexdigest()


def _plain(encoder: BacktrackEncoder, ids: bytes) -> tuple:
    return (np.frombuffer(ids, "<u4").tolist(),)


def _decoded(encoder: BacktrackEncoder, ids: bytes) -> tuple:
    return (decode(encoder.tokens, ids).decode("utf-8", "replace"),)


def _mapped(docs: DataFrame, path: str, pattern: str, text: str, doc_id: str, make_row, schema: str) -> DataFrame:
    ship(docs.sparkSession)
    content = docs.sparkSession.sparkContext.broadcast(vocabulary(path))
    names = [part.split()[0] for part in schema.split(", ")]
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(_on_ids(content, pattern, make_row, names), f"id {kind}, {schema}").withColumnRenamed("id", doc_id)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, ids): the token ids of each whole text."""
    return _mapped(docs, path, pattern, text, doc_id, _plain, "ids array<int>")


def round_trip(docs: DataFrame, path: str, pattern: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, decoded): each text after encoding and decoding."""
    return _mapped(docs, path, pattern, text, doc_id, _decoded, "decoded string")


def digests(docs: DataFrame, path: str, pattern: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of encoding, and of decoding what was encoded."""
    return _mapped(docs, path, pattern, text, doc_id, _digests, "n_tokens long, ids_sha256 string, decoded_sha256 string")


def _tokens_of(content, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, cut = _encoder(content.value, pattern)
        for batch in batches:
            ids = list(cut.encode_all(batch.column("text").to_pylist()))
            digests = [_digests(encoder, x) for x in ids]
            ends = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
            values = pa.array(np.frombuffer(b"".join(ids), "<i4"), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"), pa.ListArray.from_arrays(pa.array(ends), values), pa.array([d[0] for d in digests], pa.int64()),
                    pa.array([d[1] for d in digests], pa.string()), pa.array([d[2] for d in digests], pa.string()),
                ],
                names=["doc_id", "ids", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return run


def tokenized(docs: DataFrame, path: str, pattern: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, ids, n_tokens, ids_sha256, decoded_sha256): ids and digests together."""
    ship(docs.sparkSession)
    content = docs.sparkSession.sparkContext.broadcast(vocabulary(path))
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(
        _tokens_of(content, pattern), "doc_id long, ids array<int>, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
