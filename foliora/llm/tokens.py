"""Encoding of texts with a public byte-level tokenizer from a local rank file."""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema

from foliora.functions.rows import schema_of, spread

#: Folder of the public tokenizers; a parameter of every operator here.
TOKENIZERS = os.environ.get("FOLIORA_TOKENIZERS", "/opt/tokenizers")
#: Longest part of a text that is encoded at once, in characters.
PART = 20_000
# Fixed value: the published pre-tokenization pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A token always begins where white space follows something else, and where a letter is followed by a sign other than
#: the apostrophe: no token of the pattern runs over such a place, whatever stands around it.
SAFE = re.compile(r"(?<=\S)(?=[ \n\t])|(?<=[A-Za-zÀ-ÖØ-öø-ÿА-яぁ-ゖァ-ヺ一-龥가-힣ก-ฮ])(?=[。，、；：！？「」『』（）《》【】—…,.;:!?()\[\]\"<>/])")

_LOADED: dict = {}


def encoder(folder: str = TOKENIZERS, name: str = "byte_bpe_50k"):
    """The tokenizer of a rank file, loaded once in each worker."""
    path = os.path.join(folder, f"{name}.tiktoken")
    if path not in _LOADED:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _LOADED[path] = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path]


def parts(text: str, size: int = PART) -> Iterator[str]:
    """Cut a long text where a token begins in any case, so that the parts' ids are those of the whole."""
    start = 0
    while len(text) - start > size:
        m = SAFE.search(text, start + size)
        if m is None:
            break
        yield text[start : m.start()]
        start = m.start()
    yield text[start:]


def encode(text: str | None, enc=None) -> np.ndarray:
    """Ids of a text, without special tokens; none for an empty or null text."""
    if not text:
        return np.empty(0, np.uint32)
    enc = enc or encoder()
    if len(text) <= PART:
        return enc.encode_to_numpy(text, disallowed_special=())
    return np.concatenate([enc.encode_to_numpy(p, disallowed_special=()) for p in parts(text)])


def decode(ids, folder: str = TOKENIZERS, name: str = "byte_bpe_50k") -> str:
    """Text of ids, by way of their raw bytes, so that a character may span tokens."""
    return encoder(folder, name).decode_bytes([int(i) for i in ids]).decode("utf-8", errors="replace")


def encode_column(df: DataFrame, key: str = "doc_id", text: str = "text", folder: str = TOKENIZERS, name: str = "byte_bpe_50k") -> DataFrame:
    """Key and ids of every row; the ids of null and empty texts are an empty list.

    Rows are neither dropped nor joined, so repeated rows are repeated; only ``key`` and ``text`` are
    read; strings of special tokens within a text are ordinary text."""
    kind = df.schema[key].dataType.simpleString()
    schema = schema_of(f"`{key}` {kind}, ids array<int>")

    def run(batches):
        enc, arrow = encoder(folder, name), to_arrow_schema(schema)
        for b in batches:
            ids = [encode(t, enc) for t in b.column(1).to_pylist()]
            offsets = np.zeros(len(ids) + 1, np.int32)
            np.cumsum([len(x) for x in ids], out=offsets[1:])
            values = np.concatenate(ids).astype(np.int32) if ids else np.empty(0, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)).cast(arrow.field(1).type)
            yield pa.RecordBatch.from_arrays([b.column(0), lists], schema=arrow)

    return spread(df.select(key, text)).mapInArrow(run, schema)


def count_column(df: DataFrame, columns: list[str], text: str = "text", folder: str = TOKENIZERS, name: str = "byte_bpe_50k") -> DataFrame:
    """``columns`` of every row and the number of tokens of its text (0 for null)."""
    schema = schema_of(", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns) + ", n_tokens bigint")

    def run(batches):
        enc, arrow = encoder(folder, name), to_arrow_schema(schema)
        for b in batches:
            n = pa.array([len(encode(t, enc)) for t in b.column(len(columns)).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(columns)], n], schema=arrow)

    return spread(df.select(*columns, text)).mapInArrow(run, schema)
