"""Encoding of texts with a public byte-level BPE vocabulary.

The vocabulary is serialised, on the driver, as a sentencepiece BPE model: every
token becomes a piece spelled in the byte alphabet (one printable character per
byte) and scored by its negative rank, with identity normalisation.  A text is cut
into pre-tokens by the vocabulary's pattern; pre-tokens are encoded piecewise (each
distinct one once per batch of work, from a bounded cache), so a merge never
crosses a pre-token.  Decoding maps ids back to bytes.

Null and empty texts have the empty list of ids.  Strings of special tokens in a
text are ordinary text.
"""

from __future__ import annotations

import base64
import os
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Folder of the vocabulary files; a parameter of every function that reads one.
VOCABULARIES = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"

#: The published pre-token pattern of the byte-level vocabularies (fixed value).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space of that pattern, as Unicode defines it: the engine at hand also counts the separators U+001C to U+001F.
_SPACE = r"\p{White_Space}"
_NO_SPACE = r"\P{White_Space}"

CACHE_ENTRIES = 400_000


def byte_alphabet() -> list[str]:
    """One printable character for each byte: itself where it is printable, else from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in set(plain) else chr(next(spare)) for b in range(256)]


def load_ranks(path: str) -> list[bytes]:
    """Tokens of a ``.tiktoken`` file by rank, which is the id."""
    ranks: dict[int, bytes] = {}
    with open(path, "rb") as lines:
        for line in lines:
            if line.strip():
                token, rank = line.split()
                ranks[int(rank)] = base64.b64decode(token)
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError(f"{path}: ranks are not 0 to {len(ranks) - 1}")
    return [ranks[k] for k in range(len(ranks))]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: int | bytes | float) -> bytes:
    """A protobuf field: varint, length-delimited or 32-bit float."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def piece_model(tokens: list[bytes]) -> bytes:
    """The vocabulary as a serialised sentencepiece model; an unused unknown piece follows the last id."""
    letters = byte_alphabet()
    normal, unknown, bpe = 1, 2, 2
    out = bytearray()
    for rank, token in enumerate(tokens):
        piece = "".join(letters[b] for b in token).encode()
        out += _field(1, _field(1, piece) + _field(2, float(-rank)) + _field(3, normal))
    out += _field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, unknown))
    out += _field(2, _field(3, bpe) + _field(4, len(tokens) + 1))
    out += _field(3, _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0))
    return bytes(out)


class Encoder:
    """Encodes texts with a serialised piece model; one per Python worker."""

    def __init__(self, model: bytes):
        import regex
        import sentencepiece

        self.pieces = sentencepiece.SentencePieceProcessor()
        self.pieces.LoadFromSerializedProto(model)
        pattern = PATTERN.replace(r"[^\s\p{L}", rf"[^{_SPACE}\p{{L}}").replace(r"\S", _NO_SPACE).replace(r"\s", _SPACE)
        self.split = regex.compile(pattern).findall
        self.table = {b: letter for b, letter in enumerate(byte_alphabet())}
        self.known: dict[str, list[int]] = {}

    def learn(self, words: set[str]) -> None:
        fresh = [w for w in words if w not in self.known]
        if not fresh:
            return
        spelled = [w.encode("utf-8", "replace").decode("latin-1").translate(self.table) for w in fresh]
        for word, ids in zip(fresh, self.pieces.encode(spelled, num_threads=1)):
            self.known[word] = ids

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        cut = [self.split(t) if t else [] for t in texts]
        self.learn(set().union(*cut))
        known = self.known
        out = []
        for words in cut:
            ids: list[int] = []
            for w in words:
                ids += known[w]
            out.append(ids)
        if len(known) > CACHE_ENTRIES or sum(map(len, known)) > 40 * CACHE_ENTRIES:
            known.clear()
        return out


def _model(df: DataFrame, folder: str, vocabulary: str):
    return df.sparkSession.sparkContext.broadcast(piece_model(load_ranks(os.path.join(folder, vocabulary))))  # about 1 MB


def _slices(column: pa.Array, most: int = 2_000_000) -> Iterator[list[str | None]]:
    """Lists of texts of at most about ``most`` characters together, so that memory stays bounded."""
    held, size = [], 0
    for scalar in column:
        text = scalar.as_py()
        held.append(text)
        size += len(text or "")
        if size >= most or len(held) >= 4096:
            yield held
            held, size = [], 0
    if held:
        yield held


def encode_texts(df: DataFrame, *, id_column: str = "doc_id", text: str = "text", folder: str = VOCABULARIES, vocabulary: str = VOCABULARY) -> DataFrame:
    """``<id_column>, ids ARRAY<INT>``: one row per row of ``df``, whole texts, null and empty texts as []."""
    model = _model(df, folder, vocabulary)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model.value)
        for batch in batches:
            at = 0
            for texts in _slices(batch.column(1)):
                ids = pa.array(encoder.encode(texts), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), ids], names=[id_column, "ids"])
                at += len(texts)

    kind = df.schema[id_column].dataType.simpleString()
    return df.select(id_column, F.col(text).cast("string").alias("text")).mapInArrow(kernel, f"{id_column} {kind}, ids ARRAY<INT>")


def count_tokens(df: DataFrame, *, id_column: str = "doc_id", text: str = "text", folder: str = VOCABULARIES, vocabulary: str = VOCABULARY) -> DataFrame:
    """``<id_column>, n_tokens BIGINT``; the ids themselves do not leave the Python workers."""
    model = _model(df, folder, vocabulary)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model.value)
        for batch in batches:
            sizes = [len(ids) for texts in _slices(batch.column(1)) for ids in encoder.encode(texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=[id_column, "n_tokens"])

    kind = df.schema[id_column].dataType.simpleString()
    return df.select(id_column, F.col(text).cast("string").alias("text")).mapInArrow(kernel, f"{id_column} {kind}, n_tokens BIGINT")


def decode_ids(ids: str | Column, tokens: list[bytes]) -> Column:
    """Column of the texts that lists of ids stand for; null for null, ids outside the vocabulary are an error."""

    @F.pandas_udf("string")
    def decode(column):
        return column.map(lambda x: None if x is None else b"".join(tokens[i] for i in x).decode("utf-8", "replace"))

    return decode(ids)
