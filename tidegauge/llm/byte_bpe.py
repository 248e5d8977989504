"""Byte-level BPE by backtracking over longest matches.

Bytes become Latin-1 characters, so a trie of the vocabulary finds the longest
token at a place. A sequence of tokens is what the merges give if and only if
every pair of neighbours is compatible: merging the bytes of the two gives
those two again. The encoder takes the longest token that is compatible with
the one before it, tries shorter prefixes otherwise, and goes back one token
and bars the place when none fits; a place is barred at most once, so a piece
takes linear time however long it is. Compatibility is memoised.
"""

from __future__ import annotations

import base64
from array import array
from hashlib import sha256

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.frames import map_column

REMEMBERED_PIECES = 1_000_000
REMEMBERED_PAIRS = 2_000_000
LONG_PIECE = 64


class ByteBpe:
    """Encoder and decoder for ``ranks`` (token bytes to id) and a splitting ``pattern``."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.tokens = {i: t for t, i in ranks.items()}
        self.trie = ahocorasick.Automaton()
        for token, i in ranks.items():
            self.trie.add_word(token.decode("latin-1"), i)
        self.longest_token = max(map(len, ranks))
        self.shorter: dict[bytes, bytes | None] = {}
        self.parts: dict[bytes, tuple[bytes, bytes] | None] = {}
        self.fits: dict[tuple[bytes, bytes], bool] = {}
        self.pieces: dict[str, bytes] = {}

    def merge(self, data: bytes, until: int = 1) -> list[bytes]:
        """The merges in order of rank, one at a time, down to ``until`` parts; for the bytes of a token."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > until:
            ranked = [(self.ranks.get(a + b, len(self.ranks) + 1), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
            rank, at = min(ranked)
            if rank > len(self.ranks):
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def halves(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The two parts whose merge makes ``token``; a single byte has none."""
        if token not in self.parts:
            self.parts[token] = self._halves(token)
        return self.parts[token]

    def _halves(self, token: bytes) -> tuple[bytes, bytes] | None:
        if len(token) == 1:
            return None
        before = self.merge(token, until=2)
        return (before[0], before[1]) if len(before) == 2 and self.merge(token) == [token] else (b"", b"")

    def compatible(self, left: bytes, right: bytes) -> bool:
        """Whether the merges leave these two tokens side by side; an empty ``left`` asks for ``right`` alone."""
        known = self.fits.get((left, right))
        if known is None:
            if len(self.fits) >= REMEMBERED_PAIRS:
                self.fits.clear()
            known = self.fits[left, right] = self._compatible(left, right)
        return known

    def _compatible(self, left: bytes, right: bytes) -> bool:
        """Undo the later of the two last merges again and again: at no time may a merge across the border come first."""
        ranks = self.ranks
        # a token that its own bytes don't merge into never appears
        if self.halves(right) == (b"", b"") or left and self.halves(left) == (b"", b""):
            return False
        most = len(ranks) + 1
        while left:
            across = ranks.get(left + right)
            if across is not None and across < most:
                return False
            own, other = self.halves(left), self.halves(right)
            if own is None and other is None:
                return True
            # of equal ranks the place further left merges first
            if other is None or own is not None and ranks[left] > ranks[right]:
                most, left = ranks[left], own[1]
            else:
                most, right = ranks[right] + 1, other[0]
        return True

    def longest(self, data: str, at: int) -> bytes:
        """The longest token that begins at ``at``."""
        # no token is longer than the longest one, so a slice of that length is enough
        window = data[at : at + self.longest_token]
        return window[: self.trie.longest_prefix(window)].encode("latin-1")

    def prefix(self, token: bytes) -> bytes | None:
        """The next shorter token that ``token`` begins with."""
        if token not in self.shorter:
            ends = range(len(token) - 1, 0, -1)
            self.shorter[token] = next((token[:n] for n in ends if token[:n] in self.ranks), None)
        return self.shorter[token]

    def backtrack(self, data: bytes) -> list[bytes]:
        text = data.decode("latin-1")
        barred = bytearray(len(data) + 1)
        out: list[bytes] = []
        at, token = 0, self.longest(text, 0)
        while at < len(data):
            last = out[-1] if out else b""
            while token is not None:
                if not barred[at + len(token)] and self.compatible(last, token):
                    break
                token = self.prefix(token)
            if token is not None:
                out.append(token)
                at += len(token)
                token = self.longest(text, at) if at < len(data) else None
            else:
                barred[at] = 1
                token = out.pop()
                at -= len(token)
        return out

    def piece(self, text: str) -> bytes:
        """The ids of one match of the pattern, as little-endian unsigned 32-bit integers."""
        data = text.encode()
        if data in self.ranks:
            return self.ranks[data].to_bytes(4, "little")
        return array("I", map(self.ranks.__getitem__, self.backtrack(data))).tobytes()

    def encode(self, text: str | None) -> bytes:
        """The ids of a whole text, as little-endian unsigned 32-bit integers."""
        found = self.pattern.findall(text or "")
        out = list(map(self.pieces.get, found))
        if None in out:
            out = [ids if ids is not None else self._remember(piece) for ids, piece in zip(out, found)]
        return b"".join(out)

    def _remember(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            ids = self.piece(piece)
            if len(piece) <= LONG_PIECE:
                if len(self.pieces) >= REMEMBERED_PIECES:
                    self.pieces.clear()
                self.pieces[piece] = ids
        return ids

    def decode(self, ids: bytes) -> bytes:
        numbers = array("I", ids)
        return b"".join(map(self.tokens.__getitem__, numbers))


def read_ranks(path: str) -> list[str]:
    """The lines of a rank file; a vocabulary is bounded by its nature, some 50,000 short lines."""
    with open(path, encoding="ascii") as file:
        return file.read().splitlines()


def codec(lines: list[str], pattern: str) -> ByteBpe:
    return ByteBpe({base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line)}, pattern)


_held: dict[tuple[str, int], ByteBpe] = {}


def held_codec(lines, pattern: str) -> ByteBpe:
    """One codec per worker process and broadcast vocabulary."""
    key = (pattern, lines.id if hasattr(lines, "id") else id(lines))
    if key not in _held:
        _held.clear()
        _held[key] = codec(lines.value, pattern)
    return _held[key]


def encode_documents(
    docs: DataFrame, ranks_path: str, pattern: str, doc_id: str = "doc_id", text: str = "text", keep_ids: bool = False
) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)``, and the ``ids`` themselves with ``keep_ids``.

    A null text counts as empty: no tokens, and the digests of nothing. Null
    and repeated ids keep their rows; other columns play no part. ``ids`` are
    binary, little-endian unsigned 32-bit integers.
    """
    lines = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def per_batch(texts: pa.Array) -> list[pa.Array]:
        bpe = held_codec(lines, pattern)
        ids, counts, digests, back = [], [], [], []
        for t in texts:
            encoded = bpe.encode(t.as_py())
            counts.append(len(encoded) // 4)
            digests.append(sha256(encoded).hexdigest())
            back.append(sha256(bpe.decode(encoded)).hexdigest())
            if keep_ids:
                ids.append(encoded)
        made = [pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(back, pa.string())]
        return [*made, pa.array(ids, pa.binary())] if keep_ids else made

    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    makes = "n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids binary" if keep_ids else "")
    return map_column(narrow, "text", makes, per_batch)


def decode_documents(rows: DataFrame, ranks_path: str, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """Replace the binary ``ids`` by the ``decoded`` bytes; null ids decode to nothing."""
    lines = rows.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def per_batch(batch: pa.Array) -> list[pa.Array]:
        bpe = held_codec(lines, "")
        return [pa.array([bpe.decode(x or b"") for x in batch.to_pylist()], pa.binary())]

    return map_column(rows, ids, f"`{name}` binary", per_batch)
