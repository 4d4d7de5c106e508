"""Encoding of the whole corpus with a public byte-level BPE tokenizer (problem 8).

A sentencepiece BPE model is serialised directly from the vocabulary: every
token becomes a piece whose bytes are mapped to printable characters, its score
is its negative rank, and the normaliser is the identity.  Texts are cut into
pre-tokens by the tokenizer's own pattern, each pre-token is encoded by the
model, and ids are ranks.  Null and empty texts give an empty list; texts of
any length are encoded whole; special tokens' strings are ordinary text.
"""

from __future__ import annotations

import base64
import os
import struct
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlode.llm.common import table

#: Where the vocabulary files are; REVIEWLODE_TOKENIZERS or a parameter overrides it.
DEFAULT_DIR = "/opt/tokenizers"
#: The pre-token pattern of byte_bpe_50k, a fixed value of that public tokenizer.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pre-tokens remembered by one worker; beyond it, the cache starts anew.
CACHE = 200_000


def vocabulary(path: str) -> list[bytes]:
    """Tokens of a .tiktoken file by rank."""
    ranked: dict[int, bytes] = {}
    with open(path, "rb") as f:
        for line in f:
            if line.strip():
                token, rank = line.split()
                ranked[int(rank)] = base64.b64decode(token)
    return [ranked[i] for i in range(len(ranked))]


def byte_characters() -> list[str]:
    """A printable character for each byte: printable Latin-1 stands for itself, the others follow from U+0100."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, extra = [], 0x100
    for b in range(256):
        if b in own:
            out.append(chr(b))
        else:
            out.append(chr(extra))
            extra += 1
    return out


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, payload: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(payload)) + payload


def serialise(tokens: list[bytes]) -> bytes:
    """The sentencepiece model (protocol buffer wire format) of a byte-level BPE vocabulary."""
    chars = byte_characters()
    out = bytearray()
    for rank, token in enumerate(tokens):
        piece = "".join(chars[b] for b in token).encode()
        out += _field(1, _field(1, piece) + b"\x15" + struct.pack("<f", -float(rank)))
    out += _field(1, _field(1, b"<unk>") + b"\x15" + struct.pack("<f", 0.0) + b"\x18\x02")
    # trainer: model_type BPE, vocabulary size, id of the unknown piece, no bos, eos, pad
    trainer = b"\x18\x02" + b"\x20" + _varint(len(tokens) + 1)
    trainer += _varint(40 << 3) + _varint(len(tokens))
    for number in (41, 42, 43):
        trainer += _varint(number << 3) + _varint((1 << 64) - 1)
    out += _field(2, trainer)
    # normaliser: identity, no dummy prefix, blanks kept, blanks not escaped
    out += _field(3, _field(1, b"identity") + b"\x18\x00" + b"\x20\x00" + b"\x28\x00")
    return bytes(out)


class Encoder:
    def __init__(self, path: str, pattern: str = PATTERN):
        import regex
        import sentencepiece

        self.tokens = vocabulary(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(self.tokens))
        self.find = regex.compile(pattern).findall
        chars = byte_characters()
        self.map = {b: c for b, c in enumerate(chars)}
        self.back = {c: b for b, c in enumerate(chars)}
        self.known: dict[str, list[int]] = {}

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        cut = [self.find(t) if t else [] for t in texts]
        known = self.known
        if len(known) > CACHE:
            known.clear()
        new = list({p for c in cut for p in c if p not in known})
        if new:
            mapped = [p.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.map) for p in new]
            for p, ids in zip(new, self.model.encode(mapped, num_threads=1)):
                known[p] = ids
        out = []
        for c in cut:
            ids: list[int] = []
            for p in c:
                ids += known[p]
            out.append(ids)
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of a list of ids, by the inverse mapping."""
        pieces = "".join(self.model.id_to_piece(i) for i in ids)
        return bytes(self.back[c] for c in pieces).decode("utf-8", "replace")


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def tokenizer_path(name: str = "byte_bpe_50k", folder: str | None = None) -> str:
    return os.path.join(folder or os.environ.get("REVIEWLODE_TOKENIZERS", DEFAULT_DIR), f"{name}.tiktoken")


def encode(df: DataFrame, key: str, text: str, path: str | None = None) -> DataFrame:
    """key, ids of every row; one pass in Arrow batches, without a shuffle."""
    path = path or tokenizer_path()

    def run(batches):
        import pyarrow as pa

        e = encoder(path)
        for batch in batches:
            ids = e.encode_batch(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, type=pa.list_(pa.int32()))], names=[key, "ids"])

    schema = T.StructType([df.schema[key], T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return df.select(key, text).mapInArrow(run, schema)


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode(table(spark, d, "documents"), "doc_id", "text")


def p8_token_counts(spark: SparkSession, d: str) -> DataFrame:
    """Documents and tokens by source."""
    docs = table(spark, d, "documents").select("doc_id", "source")
    return p8_ids(spark, d).join(docs, "doc_id").groupBy("source").agg(F.count(F.lit(1)).alias("n_documents"), F.sum(F.size("ids")).cast("long").alias("n_tokens"))
