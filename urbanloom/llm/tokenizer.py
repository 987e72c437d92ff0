"""Encoding of a corpus with a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the vocabulary files, where no other is given.
VOCABULARIES = "/opt/tokenizers"
#: Fixed value: the pre-splitting pattern that the byte_bpe vocabularies were made with.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes up to which a vocabulary file is sent to the executors as a broadcast (the public ones have about 1 MB).
VOCABULARY_BYTES = 64 << 20
#: Characters from which a text is cut before it is encoded.
LONG = 1 << 16
# A pre-split piece never ends in white space after something else, so a cut before white space that follows a character
# changes nothing.
_SAFE = re.compile(r"(?<=\S)(?=\s)")

_cache: dict[str, object] = {}


def read_vocabulary(name: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> bytes:
    """The rank file ``name`` as it is, for ``Coder``."""
    return Path(folder, f"{name}.tiktoken").read_bytes()


class Coder:
    """Encodes and decodes with a rank file, without special tokens."""

    def __init__(self, ranks: bytes, pattern: str = PATTERN) -> None:
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self._coder = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    @classmethod
    def shared(cls, ranks: bytes) -> Coder:
        """One coder per worker process and vocabulary."""
        key = hashlib.sha256(ranks).hexdigest()
        if key not in _cache:
            _cache[key] = cls(ranks)
        return _cache[key]

    @staticmethod
    def pieces(text: str, size: int = LONG) -> list[str]:
        """``text`` in parts of about ``size`` characters, cut where the encoding isn't changed; longer ones where there is no such place."""
        out, at = [], 0
        while len(text) - at > size:
            m = _SAFE.search(text, at + size)
            if not m:
                break
            out.append(text[at : m.start()])
            at = m.start()
        return [*out, text[at:]]

    def encode(self, text: str | None) -> list[int]:
        """Ids of ``text``; none for null and for empty text."""
        if not text:
            return []
        if len(text) <= LONG:
            return self._coder.encode_ordinary(text)
        return [i for part in self.pieces(text) for i in self._coder.encode_ordinary(part)]

    def decode(self, ids: list[int]) -> str:
        """The text of ``ids``: their bytes are joined before they are read as UTF-8, as a character may span ids."""
        return b"".join(self._coder.decode_tokens_bytes(ids)).decode("utf-8", "replace")


def _vocabulary(df: DataFrame, name: str, folder: str):
    ranks = read_vocabulary(name, folder)
    if len(ranks) > VOCABULARY_BYTES:
        raise ValueError(f"{name} has {len(ranks)} bytes; the bound for a broadcast is {VOCABULARY_BYTES}")
    return df.sparkSession.sparkContext.broadcast(ranks)


def encode(df: DataFrame, key: str, text: str, vocabulary: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> DataFrame:
    """(key, ids) of each row: one pass without a shuffle. Null and empty texts have empty ids; repeated rows stay."""
    ranks = _vocabulary(df, vocabulary, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder.shared(ranks.value)
        for batch in batches:
            keys, texts = batch.columns
            for lo in range(0, len(keys), 512):  # long texts leave in small batches
                ids = [coder.encode(t) for t in texts.slice(lo, 512).to_pylist()]
                yield pa.RecordBatch.from_arrays([keys.slice(lo, 512), pa.array(ids, pa.list_(pa.int32()))], names=["key", "ids"])

    kind = dict(df.dtypes)[key]
    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def decode(df: DataFrame, key: str, ids: str, vocabulary: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> DataFrame:
    """(key, text) of each row; null ids give null, empty ids empty text."""
    ranks = _vocabulary(df, vocabulary, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder.shared(ranks.value)
        for batch in batches:
            texts = [None if x is None else coder.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["key", "text"])

    kind = dict(df.dtypes)[key]
    return df.select(F.col(key).alias("key"), F.col(ids).alias("ids")).mapInArrow(run, f"key {kind}, text string").withColumnRenamed("key", key)
