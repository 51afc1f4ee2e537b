"""Byte-pair encoding and decoding with forced boundaries (operators 4 and, for its ids, 6).

A pair of neighbouring symbols that occurs inside no vocabulary token can't be joined by any merge,
so a cut between the two changes nothing: the fragments are encoded on their own and their ids
concatenated. The pairs are read off the vocabulary. The pre-tokenizer forces cuts of its own, which
are made first; its pieces repeat, so each distinct piece is cut and encoded once a worker (the memo
is emptied when it reaches a fixed size). Texts that hold an added token's string, or one of the four
control characters that Python and the tokenizer class differently, go through the library whole.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from termloom.llm import common as C

MEMO = 1 << 18
#: The byte-level pre-tokenizer's pattern, and the same for texts of ASCII alone.
_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_SPLIT_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.A)


def default_path(name: str) -> str:
    """Where the installed vocabulary files are; operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Memo(dict):
    """fragment -> value of ``make``; emptied when full."""

    def __init__(self, make, most: int = MEMO):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, fragment: str):
        if len(self) >= self.most:
            self.clear()
        out = self.make(fragment)
        if len(fragment) < 200:
            self[fragment] = out
        return out


class ForcedBpe:
    """Encoder and decoder of a byte-level BPE file that reproduces the library's ids."""

    def __init__(self, path: str):
        self.tok = Tokenizer.from_file(str(path))
        self.tok.no_truncation()
        self.tok.no_padding()
        vocab = self.tok.get_vocab(with_added_tokens=True)
        added = {t.content for t in self.tok.get_added_tokens_decoder().values()}
        plain = [t for t in vocab if t not in added]
        self.inside = {a + b for t in plain for a, b in zip(t, t[1:], strict=False)}
        self.byte_of = {c: b for b, c in _byte_alphabet().items()}
        odd = [re.escape(x) for x in sorted(added, key=len, reverse=True)]
        self.whole = re.compile("|".join(["[\x1c-\x1f]", *odd]))
        self.token_bytes = {i: (t.encode() if t in added else bytes(self.byte_of[c] for c in t)) for t, i in vocab.items()}
        self.memo = Memo(self._piece)
        kind = json.loads(self.tok.to_str())["pre_tokenizer"] or {}
        self.known = kind.get("type") == "ByteLevel" and kind.get("use_regex") and not kind.get("add_prefix_space") and self.tok.normalizer is None

    def cut(self, piece: str) -> list[str]:
        """The fragments of a piece between symbol pairs that no token holds."""
        at = [i for i in range(1, len(piece)) if piece[i - 1 : i + 1] not in self.inside]
        return [piece[a:b] for a, b in zip([0, *at], [*at, len(piece)], strict=True)]

    def _piece(self, piece: str) -> tuple[str, bytes]:
        mapped = piece.encode().decode("latin-1").translate(_ALPHABET)
        ids = [t.id for part in self.cut(mapped) for t in self.tok.model.tokenize(part)]
        return ",".join(map(str, ids)), b"".join(map(self.token_bytes.__getitem__, ids))

    def encode_joined(self, text: str) -> tuple[str, bytes]:
        """(ids in decimal joined by commas, bytes of the decoded ids)."""
        if not text:
            return "", b""
        if not self.known or self.whole.search(text):
            ids = self.tok.encode(text, add_special_tokens=False).ids
            return ",".join(map(str, ids)), self.decode(ids).encode()
        got = list(map(self.memo.__getitem__, (_SPLIT_ASCII if text.isascii() else _SPLIT).findall(text)))
        return ",".join([x for x, _ in got]), b"".join([y for _, y in got]).decode("utf-8", "replace").encode()

    def encode(self, text: str) -> list[int]:
        joined = self.encode_joined(text)[0]
        return list(map(int, joined.split(","))) if joined else []

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", "replace")


def _byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in own)}


_ALPHABET = _byte_alphabet()
_loaded: dict[str, ForcedBpe] = {}


def loaded(path: str) -> ForcedBpe:
    if path not in _loaded:
        _loaded[path] = ForcedBpe(path)
    return _loaded[path]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids array<int>) of each row of (doc_id, text); null text: no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for t in batches:
            ids = pa.array([bpe.encode(x or "") for x in t.column(1).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([t.column(0), ids], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of each row of (doc_id, ids); null ids: empty. Unknown ids raise KeyError."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for t in batches:
            yield pa.RecordBatch.from_arrays([t.column(0), pa.array([bpe.decode(x or []) for x in t.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return tokens.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")


def digest(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of (doc_id, text).

    Ids as the library gives them without special tokens added, decoded with them kept. Null or
    empty text: no ids, digests of the empty string. doc_id may be null or repeat; each row gives a
    row. Other columns are ignored; an empty table gives none. Memory: one batch and the memo.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for t in batches:
            n, a, b = [], [], []
            for x in t.column(1):
                joined, back = bpe.encode_joined(x.as_py() or "")
                n.append(joined.count(",") + 1 if joined else 0)
                a.append(hashlib.sha256(joined.encode()).hexdigest())
                b.append(hashlib.sha256(back).hexdigest())
            yield pa.RecordBatch.from_arrays([t.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")).mapInArrow(C.trimmed(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(C.documents(spark, sf_dir), str(Path(default_path("byte_bpe_50k.json"))))
