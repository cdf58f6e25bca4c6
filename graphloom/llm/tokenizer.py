"""Encoding of a whole corpus with a public byte-level BPE vocabulary (problem 7).

The vocabulary file is serialised directly into a sentencepiece BPE model:
every token becomes a piece in the byte alphabet with minus its rank as its
score, so that the merges of lowest rank come first, and normalisation is the
identity. Texts are split by the vocabulary's pattern and each pre-token is
encoded on its own; decoding is the inverse mapping of the pieces' bytes.
"""

from __future__ import annotations

import base64
import re
import struct
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"

# The split pattern that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# The same pattern where a text has ASCII characters only.
ASCII_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"

SLICE = 1 << 20  # characters split at once, which bounds the strings held
KEPT = 400_000  # pre-tokens remembered
LONG = 64  # longer pre-tokens are not remembered


def byte_alphabet() -> str:
    """256 characters that stand for the bytes: printable ones for themselves, the others for U+0100 and on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return "".join(chr(b if b in own else next(rest)) for b in range(256))


ALPHABET = byte_alphabet()
_TO_ALPHABET = {b: ALPHABET[b] for b in range(256)}


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by id from a rank file."""
    pairs = [line.split() for line in open(path, "rb") if line.strip()]
    out = [b""] * len(pairs)
    for token, rank in pairs:
        out[int(rank)] = base64.b64decode(token)
    return out


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _bytes(field: int, body: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(body)) + body


def _int(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def serialise(tokens: list[bytes]) -> bytes:
    """A sentencepiece BPE model whose piece ids are the token ids; the unknown piece comes last."""
    out = bytearray()
    for rank, token in enumerate(tokens):
        piece = "".join(map(_TO_ALPHABET.__getitem__, token)).encode()
        out += _bytes(1, _bytes(1, piece) + _varint(2 << 3 | 5) + struct.pack("<f", -float(rank)))
    out += _bytes(1, _bytes(1, b"<unk>") + _varint(2 << 3 | 5) + struct.pack("<f", 0.0) + _int(3, 2))
    bpe, n = 2, len(tokens)
    out += _bytes(2, _int(3, bpe) + _int(4, n + 1) + _int(40, n) + _int(41, -1) + _int(42, -1) + _int(43, -1))
    out += _bytes(3, _bytes(1, b"identity") + _int(3, 0) + _int(4, 0) + _int(5, 0))
    return bytes(out)


class Encoder:
    """Token ids of texts; remembers the ids of pre-tokens met before, up to a bound."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor()
        self.processor.LoadFromSerializedProto(model)
        self.known: dict[str, list[int]] = {}
        self.wide, self.narrow = regex.compile(PATTERN), re.compile(ASCII_PATTERN, re.ASCII)

    def split(self, text: str) -> list[str]:
        return (self.narrow if text.isascii() else self.wide).findall(text)

    def _learn(self, pieces: Iterable[str]) -> list[str]:
        new = [p for p in set(pieces) if p not in self.known]
        if new:
            mapped = [p.encode().decode("latin-1").translate(_TO_ALPHABET) for p in new]
            self.known.update(zip(new, self.processor.encode(mapped, num_threads=1)))
        return [p for p in new if len(p) > LONG]

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each text; null and empty texts have none."""
        out: list[list[int]] = []
        for part in _slices(texts):
            split = [self.split(t) if t else [] for t in part]
            long = self._learn(chain.from_iterable(split))
            ids = self.known.__getitem__
            out.extend(list(chain.from_iterable(map(ids, s))) for s in split)
            self._forget(long)
        return out

    def count(self, texts: list[str | None]) -> list[int]:
        """Number of ids of each text."""
        out: list[int] = []
        for part in _slices(texts):
            split = [self.split(t) if t else [] for t in part]
            long = self._learn(chain.from_iterable(split))
            ids = self.known.__getitem__
            out.extend(sum(map(len, map(ids, s))) for s in split)
            self._forget(long)
        return out

    def _forget(self, long: list[str]) -> None:
        for p in long:
            del self.known[p]
        if len(self.known) > KEPT:
            self.known.clear()


def _slices(texts: list[str | None]) -> Iterator[list[str | None]]:
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t or "")
        if size >= SLICE:
            yield part
            part, size = [], 0
    if part:
        yield part


_ENCODERS: dict[int, Encoder] = {}


def encoder(model: bytes) -> Encoder:
    """The worker's encoder for a model, made once."""
    key = hash(model)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(model)
    return _ENCODERS[key]


def shared_model(df: DataFrame, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY):
    """The serialised model as a broadcast of about a megabyte, whatever the corpus."""
    return df.sparkSession.sparkContext.broadcast(serialise(read_ranks(f"{folder}/{vocabulary}")))


def encode(df: DataFrame, text: str = "text", out: str = "ids", keep: list[str] | None = None, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per row with the ids of its text in ``out``, and the columns ``keep`` (by default all but the text).

    Null and empty texts have an empty list. Special tokens' names in a text
    are ordinary text. Nothing is shuffled; repeated texts are encoded again.
    """
    keep = [c for c in df.columns if c != text] if keep is None else keep
    model = shared_model(df, folder, vocabulary)
    schema = T.StructType([*[df.schema[c] for c in keep], T.StructField(out, T.ArrayType(T.IntegerType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                ids = enc.encode(part.column(len(keep)).to_pylist())
                offsets = np.zeros(len(ids) + 1, dtype=np.int32)
                np.cumsum([len(x) for x in ids], out=offsets[1:])
                flat = np.fromiter(chain.from_iterable(ids), dtype=np.int32, count=int(offsets[-1]))
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(len(keep))], lists], names=[*keep, out])

    return df.select(*keep, text).mapInArrow(run, schema)


def decode(df: DataFrame, ids: str = "ids", out: str = "text", folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """The inverse of :func:`encode`: ``out`` is the text of ``ids``; an empty list gives an empty text, null gives null.

    Ids outside the vocabulary are skipped; bytes that are no UTF-8 become U+FFFD.
    """
    tokens = df.sparkSession.sparkContext.broadcast(read_ranks(f"{folder}/{vocabulary}"))
    keep = [c for c in df.columns if c != ids]
    schema = T.StructType([*[df.schema[c] for c in keep], T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = tokens.value
        for batch in batches:
            texts = [None if x is None else b"".join(table[i] for i in x if i is not None and 0 <= i < len(table)).decode(errors="replace") for x in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], pa.array(texts, pa.string())], names=[*keep, out])

    return df.select(*keep, ids).mapInArrow(run, schema)
