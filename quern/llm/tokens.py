"""Encoding of whole texts with public tokenizers.

Byte-level BPE keeps the ranks of all adjacent pairs of a word in a segment tree:
its root is the leftmost pair of the lowest rank, a merge changes three leaves, and it is
over when the root has no rank.  Each distinct word is merged once per worker.
"""

from __future__ import annotations

import base64
import importlib
from array import array
from collections.abc import Callable, Iterator
from itertools import chain
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

TOKENIZERS = "/opt/tokenizers"
#: How the byte-level tokenizers split a text into words before they merge (a fixed value of the public vocabularies).
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bounds of a worker's memory of merged words: entries, and characters of a word worth keeping.
CACHE_WORDS, CACHE_CHARS = 300_000, 64
NO_RANK = 1 << 62


def merge_word(word: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """Token ids of one word."""
    if word in ranks:
        return (ranks[word],)
    n = len(word)
    size = 1
    while size < n:
        size *= 2
    part = [word[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    # a leaf is rank and place in one number, so the smallest is the leftmost pair of the lowest rank
    tree = [NO_RANK] * (2 * size)
    for i in range(n - 1):
        rank = ranks.get(word[i : i + 2])
        if rank is not None:
            tree[size + i] = rank << 32 | i
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b

    def put(i: int, value: int) -> None:
        k = size + i
        tree[k] = value
        while k > 1:
            other = tree[k ^ 1]
            low = value if value < other else other
            k >>= 1
            if tree[k] == low:
                return
            tree[k] = value = low

    while tree[1] != NO_RANK:
        i = tree[1] & 0xFFFFFFFF
        j = after[i]
        part[i] += part[j]
        k = after[i] = after[j]
        part[j] = b""
        put(j, NO_RANK)
        if k < n:
            before[k] = i
            rank = ranks.get(part[i] + part[k])
            put(i, NO_RANK if rank is None else rank << 32 | i)
        else:
            put(i, NO_RANK)
        h = before[i]
        if h >= 0:
            rank = ranks.get(part[h] + part[i])
            put(h, NO_RANK if rank is None else rank << 32 | h)
    return tuple(ranks[p] for p in part if p)


class _Merged(dict):
    """Words to token ids; a missing word is merged, and kept unless it is long."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = merge_word(word.encode("utf-8", "surrogatepass"), self.ranks)
        if len(word) <= CACHE_CHARS:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = ids
        return ids


_LOADED: dict[str, Callable[[str], list[int]]] = {}


def _file(name: str, folder: str) -> Path:
    for suffix in (".tiktoken", ".model", ".json"):
        if (path := Path(folder, name + suffix)).exists():
            return path
    raise FileNotFoundError(f"no vocabulary {name} in {folder}")


def encoder(name: str, folder: str = TOKENIZERS) -> Callable[[str], list[int]]:
    """The function from a text to its token ids, without special tokens; loaded once per worker."""
    path = _file(name, folder)
    if str(path) not in _LOADED:
        if path.suffix == ".tiktoken":
            import regex

            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, path.read_bytes().splitlines())}
            words, merged = regex.compile(WORDS), _Merged(ranks)
            _LOADED[str(path)] = lambda text: list(chain.from_iterable(map(merged.__getitem__, words.findall(text))))
        elif path.suffix == ".json":
            t = importlib.import_module("tokenizers").Tokenizer.from_file(str(path))
            t.encode_special_tokens = True
            _LOADED[str(path)] = lambda text: t.encode(text, add_special_tokens=False).ids
        else:
            s = importlib.import_module("sentencepiece").SentencePieceProcessor(model_file=str(path))
            _LOADED[str(path)] = lambda text: s.encode(text, num_threads=1)
    return _LOADED[str(path)]


def token_ids(docs: DataFrame, key: str, text: str, tokenizer: str, folder: str = TOKENIZERS) -> DataFrame:
    """`key, ids`: each row's text as a list of token ids; an empty list for null and empty texts.

    Every row gives one row, repeated keys included; strings that look like special tokens are
    ordinary text; other columns play no role.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = encoder(tokenizer, folder)
        for batch in batches:
            flat, ends = array("i"), array("i", [0])
            for t in batch.column(1):
                if t := t.as_py():
                    flat.extend(ids(t))
                ends.append(len(flat))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[key, "ids"])

    schema = T.StructType([docs.schema[key], T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return docs.select(key, text).mapInArrow(encode, schema)


def token_counts(docs: DataFrame, key: str, text: str, tokenizers: list[str], folder: str = TOKENIZERS) -> DataFrame:
    """`key, tokenizer, n_tokens` for each row and tokenizer; 0 for null and empty texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for name in tokenizers:
                ids = encoder(name, folder)
                counts = pa.array([len(ids(t)) if t else 0 for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([name] * len(texts), pa.string()), counts], names=[key, "tokenizer", "n_tokens"])

    schema = T.StructType([docs.schema[key], T.StructField("tokenizer", T.StringType()), T.StructField("n_tokens", T.LongType())])
    return docs.select(key, text).mapInArrow(count, schema)
