"""Byte-pair encoding by backtracking over longest token matches, and decoding by an offset table.

The encoder finds every vocabulary token inside a pre-token with one Aho-Corasick pass, then walks from left to right
taking the longest token at each place. A token may follow another only if byte-pair merging of the two together would
leave the border between them (the pair-compatibility table, filled on demand). Where no token fits, the last one is
taken back and the next shorter one is tried; places that proved to be dead ends are never tried again, so the work is
linear in the length. The result equals that of the merges themselves.

The decoder holds all tokens' bytes in one array with the offset of each token and gathers the bytes of a whole
document at once.

Defined results: a null text is an empty text (no tokens, empty decoded text); texts of any length are encoded whole;
a vocabulary's special strings inside texts become their one special token; rows are independent, so repeated rows get the
same result and an empty table an empty one; further columns are ignored by `encode_decode` and kept by `encoded`.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.llm.common import map_arrow, record_batch
from attestor.llm.token_counts import WHITE, byte_symbols, merge_ranks

#: Pre-tokens and token pairs that one Python worker remembers.
CACHE_ENTRIES = 500_000
#: Bytes in one round of decoding.
DECODE_TOKENS = 1 << 16
#: The split of byte-level vocabularies, with white space written out.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^W\p{L}\p{N}]+|[W]+(?![^W])|[W]+".replace("W", WHITE)

_CODECS: dict[str, "Codec"] = {}


class _Pieces(dict):
    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        ids = self[piece] = np.asarray(self.encode(piece.encode("utf-8")), "<u4").tobytes()
        return ids


class Codec:
    """Encoder and decoder of one byte-level vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, self.specials = spec["model"]["vocab"], {t["content"]: t["id"] for t in spec["added_tokens"]}
        to_byte = {c: b for b, c in enumerate(byte_symbols())}
        size = max([*vocab.values(), *self.specials.values()]) + 1
        tokens: list[bytes] = [b""] * size
        for token, k in vocab.items():
            tokens[k] = token.encode() if token in self.specials else bytes(map(to_byte.__getitem__, token))
        for token, k in self.specials.items():
            tokens[k] = token.encode()
        self.lengths = np.fromiter(map(len, tokens), np.int64, size)
        self.offsets = np.concatenate(([0], np.cumsum(self.lengths)[:-1]))
        self.blob = np.frombuffer(b"".join(tokens), np.uint8)

        # rank[t] is the place of the merge that makes token t (-1: a single byte), parts[t] its two halves
        self.rank, self.parts, self.joined = [-1] * size, [None] * size, {}
        for (a, b), k in merge_ranks(spec["model"]["merges"]).items():
            x, y, t = vocab[a], vocab[b], vocab[a + b]
            self.rank[t], self.parts[t], self.joined[x, y] = k, (x, y), k
        self.matches = ahocorasick.Automaton(ahocorasick.STORE_ANY)
        for token, k in vocab.items():
            if token not in self.specials:
                self.matches.add_word(tokens[k].decode("latin-1"), (len(tokens[k]), k))
        self.matches.make_automaton()
        self.compatible: dict[tuple[int, int], bool] = {}
        self.pieces = _Pieces(self.encode_piece)
        self.split = regex.compile(SPLIT).findall
        self.special = regex.compile("(" + "|".join(map(regex.escape, self.specials)) + ")")

    def fits(self, a: int, b: int) -> bool:
        """Whether merging the bytes of a and b together keeps the border between them."""
        known = self.compatible.get((a, b))
        if known is None:
            if len(self.compatible) >= CACHE_ENTRIES:
                self.compatible.clear()
            known = self.compatible[a, b] = self._border_stays(a, b, len(self.joined) + 1)
        return known

    def _border_stays(self, a: int, b: int, end: int) -> bool:
        """Whether the border between a and b outlives the merges before number `end`. The two sides are unmerged from
        the last merge back to the first: x and y are the tokens beside the border until merge number `until`, and the
        border is lost if they merge before that."""
        rank, x, y, until = self.rank, a, b, end
        while True:
            k = self.joined.get((x, y))
            if k is not None and k < until:
                return False
            if rank[x] < 0 and rank[y] < 0:
                return True
            if rank[x] > rank[y]:
                until, x = rank[x], self.parts[x][1]
            else:
                # equal merges on both sides run from the left, so a pair across the border at that rank comes first
                until, y = rank[y] + 1, self.parts[y][0]

    def encode_piece(self, data: bytes) -> list[int]:
        n = len(data)
        starts: list[list[int]] = [[] for _ in range(n)]
        for end, (length, token) in self.matches.iter(data.decode("latin-1")):
            starts[end - length + 1].append((length, token))
        for found in starts:
            found.sort()  # the longest is taken from the end
        if n and len(starts[0]) and starts[0][-1][0] == n and self._whole(starts[0][-1][1]):
            return [starts[0][-1][1]]
        dead, out, left = bytearray(n + 1), [], [list(starts[0])] if n else []
        place, at = 0, [0]
        while place < n:
            options = left[-1]
            while options:
                length, token = options.pop()
                if not dead[place + length] and (not out or self.fits(out[-1], token)):
                    out.append(token)
                    place += length
                    at.append(place)
                    if place < n:
                        left.append(list(starts[place]))
                    break
            else:
                dead[place] = 1
                left.pop()
                at.pop()
                out.pop()
                place = at[-1]
        return out

    def _whole(self, token: int) -> bool:
        """Whether the token's own bytes merge to it, which holds if its halves are whole and fit up to that merge."""
        parts = self.parts[token]
        if parts is None:
            return True
        return self._border_stays(*parts, self.rank[token]) and self._whole(parts[0]) and self._whole(parts[1])

    def encode(self, text: str) -> bytes:
        """The identifiers as little-endian unsigned 32-bit integers."""
        if not any(s in text for s in self.specials):
            return b"".join(map(self.pieces.__getitem__, self.split(text)))
        out = []
        for part in self.special.split(text):
            if part in self.specials:
                out.append(self.specials[part].to_bytes(4, "little"))
            else:
                out.extend(map(self.pieces.__getitem__, self.split(part)))
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        tokens, out = np.frombuffer(ids, "<u4"), []
        for k in range(0, len(tokens), DECODE_TOKENS):
            part = tokens[k : k + DECODE_TOKENS]
            lengths = self.lengths[part]
            ends = np.cumsum(lengths)
            place = np.repeat(self.offsets[part] - ends + lengths, lengths)
            place += np.arange(len(place))
            out.append(self.blob[place].tobytes())
        return b"".join(out)


def codec(path: str) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def _decoded(c: Codec, ids: bytes) -> str:
    return c.decode(ids).decode("utf-8", "replace")


def encoded(docs: DataFrame, vocabulary: str, text_col: str = "text", ids_col: str = "token_ids", decoded_col: str | None = None) -> DataFrame:
    """docs with the identifiers of each whole text as array<int>, and the text decoded from them again if a name for
    it is given. Input columns of these names are replaced."""
    new = [ids_col] + [decoded_col] * (decoded_col is not None)
    kept = docs.drop(*new)
    place = kept.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)
        for batch in batches:
            ids = [c.encode(t or "") for t in batch.column(place).to_pylist()]
            ends = np.concatenate(([0], np.cumsum([len(x) // 4 for x in ids], dtype=np.int64)))
            values = pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32))
            columns = [*batch.columns, pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values)]
            if decoded_col is not None:
                columns.append(pa.array([_decoded(c, x) for x in ids], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, *new])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema] + [f"`{ids_col}` array<int>"] + ([f"`{decoded_col}` string"] if decoded_col else []))
    return map_arrow(kept, run, schema)


def encode_decode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, number of tokens, digest of the identifiers, digest of the text decoded from them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)
        for batch in batches:
            ids = [c.encode(t or "") for t in batch.column(1).to_pylist()]
            yield record_batch(
                doc_id=batch.column(0),
                n_tokens=pa.array([len(x) // 4 for x in ids], pa.int64()),
                ids_sha256=pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                decoded_sha256=pa.array([hashlib.sha256(_decoded(c, x).encode("utf-8")).hexdigest() for x in ids], pa.string()),
            )

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
