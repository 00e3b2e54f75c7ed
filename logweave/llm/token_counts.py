"""Token counts by batch encoding in Arrow functions that return lengths only.

Texts are encoded in batches balanced by bytes. A long text is first split where no token can
cross: between a character that isn't white space and white space. Both sides are encoded alone
and their lengths added, so no batch grows with a text.

The byte-level vocabulary comes as a file for `tokenizers` and as ranks for `tiktoken`. Both give
the same ids (tests/llm compares them on texts and on every code point), and the latter is about
four times as fast on words that repeat little, so it encodes where the ranks lie beside the file.
That is settled once, on the driver, and an executor that lacks the ranks fails. Any other tokenizer
file is read by its own library.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.llm.arrow import slices_by_bytes, small

#: A special token of the byte-level vocabulary; its string in a text is that token, as by the library's default.
SPECIAL = {"<|endoftext|>": 50256}
CHUNK_CHARS, BATCH_BYTES = 1 << 16, 1 << 21
_boundary = re.compile(r"(?<=\S)(?=\s)")


def vocabulary_path(name: str) -> str:
    """Where a vocabulary file of the installed public collection lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def ranks_of(path: str) -> str | None:
    """The file of ranks that gives the same ids as the byte-level vocabulary at `path`, if it lies beside it. For the driver to ask."""
    ranks = f"{path.removesuffix('.json')}.tiktoken"
    return ranks if path.endswith("byte_bpe_50k.json") and os.path.exists(ranks) else None


@lru_cache(maxsize=4)
def encoder(path: str, ranks: str | None = None):
    """A function from a list of texts to a list of id arrays, for a vocabulary file, loaded once in each worker; by `ranks`, if given."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if ranks:
        import public_tokenizers
        import tiktoken

        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        enc = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens=SPECIAL)
        return lambda texts: [enc.encode_to_numpy(t, allowed_special="all") for t in texts]
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        return lambda texts: [np.asarray(e.ids, np.uint32) for e in tok.encode_batch_fast(texts, add_special_tokens=False)]
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda texts: [np.asarray(ids, np.uint32) for ids in sp.encode(texts, num_threads=1)]


def safe_chunks(text: str, limit: int = CHUNK_CHARS) -> list[str]:
    """`text` in pieces whose encodings join to its own: cut only before white space that follows another character.

    Holds for byte-level vocabularies, whose words take white space only at their start. A run
    without such a place stays whole.
    """
    if len(text) <= limit:
        return [text]
    out, start = [], 0
    while len(text) - start > limit and (m := _boundary.search(text, start + limit)):
        out.append(text[start : m.start()])
        start = m.start()
    return [*out, text[start:]]


def batched_ids(texts: list[str | None], path: str, ranks: str | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(index of its text, ids of a piece) in order; a null text is an empty one. At most about BATCH_BYTES are in hand at once."""
    split = "byte_bpe" in os.path.basename(path)
    pieces = [(i, p) for i, t in enumerate(texts) for p in (safe_chunks(t or "") if split else [t or ""])]
    encode = encoder(path, ranks)
    for a, b in slices_by_bytes([len(p.encode("utf-8", "surrogatepass")) for _, p in pieces], BATCH_BYTES):
        yield from zip((i for i, _ in pieces[a:b]), encode([p for _, p in pieces[a:b]]), strict=True)


def token_counts(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", limit: int = 512, text: str | Column = "text", carry: list[str | Column] | None = None) -> DataFrame:
    """`carry` (all columns, by default) and n_bytes, n_tokens, over_limit (n_tokens > `limit`) of every whole text.

    A null text counts as empty: 0 bytes, 0 tokens. Repeated rows are counted alike. Columns that
    have the name of a result column are replaced. `vocabulary` is a name in the installed
    collection, or a path that every executor can open.
    """
    path = vocabulary if os.path.isabs(vocabulary) else vocabulary_path(vocabulary)
    ranks = ranks_of(path)
    base = docs.select((text if isinstance(text, Column) else F.col(text)).cast("string").alias("__text"), *(carry if carry is not None else ["*"])).drop("n_bytes", "n_tokens", "over_limit")
    rest = [f for f in base.schema.fields if f.name != "__text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            counts = np.zeros(batch.num_rows, np.int64)
            for i, ids in batched_ids(batch.column(0).to_pylist(), path, ranks):
                counts[i] += len(ids)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(counts)], [f.name for f in rest] + ["n_tokens"])

    sized = base.withColumn("n_bytes", F.coalesce(F.octet_length("__text"), F.lit(0)).cast("long"))
    rest = [f for f in sized.schema.fields if f.name != "__text"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rest] + ["n_tokens bigint"])
    return sized.mapInArrow(run, schema).withColumn("over_limit", F.col("n_tokens") > limit)
