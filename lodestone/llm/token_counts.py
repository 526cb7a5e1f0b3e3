"""Token counts (9): batch encoding in Arrow functions that return lengths only.

Batches are balanced by bytes, not by rows, and a long text is split at places where the pre-tokenizer
always splits too, so that the parts' counts add up to the whole text's. What a worker needs beside the one text at hand is
bound by `batch_bytes`, not by the longest text or the Arrow batch. (A text without any place to split goes to the library whole.)
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, slices

BATCH_BYTES = 256 * 1024
PART_CHARS = 64 * 1024


@lru_cache(maxsize=4)
def load(path: str):
    """The tokenizer of a .json (tokenizers) or .model (sentencepiece) file; a bare name is looked up among the public files."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if os.sep not in path:
        import public_tokenizers

        path = public_tokenizers.path(path)
    if path.endswith(".model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path)
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.no_truncation()
    made.no_padding()
    return made


def lengths(tokenizer, texts: list[str]) -> list[int]:
    if hasattr(tokenizer, "encode_batch_fast"):
        return [len(x) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    return [len(x) for x in tokenizer.encode(texts, num_threads=1)]


def split_safely(text: str, size: int) -> list[str]:
    """Parts of about `size` characters whose tokens are the text's tokens.

    A cut is made before a single space between two characters that are neither white space nor apostrophes:
    byte-level pre-tokenizers start a new piece there whatever surrounds it, and no special string holds a
    space. Where a text has no such place it stays whole.
    """
    parts, at = [], 0
    while len(text) - at > size:
        cut = text.find(" ", at + size)
        while cut != -1 and not (cut + 1 < len(text) and not text[cut - 1].isspace() and not text[cut + 1].isspace() and "'" not in (text[cut - 1], text[cut + 1])):
            cut = text.find(" ", cut + 1)
        if cut == -1:
            break
        parts.append(text[at:cut])
        at = cut
    parts.append(text[at:])
    return parts


def count_batch(tokenizer, texts: list[str], batch_bytes: int, part_chars: int, splittable: bool) -> list[int]:
    """Tokens of each text; the library gets `batch_bytes` bytes at a time (or one part, where that has more)."""
    counts, queue, owner, held = [0] * len(texts), [], [], 0

    def flush() -> None:
        for i, n in zip(owner, lengths(tokenizer, queue), strict=True):
            counts[i] += n
        queue.clear()
        owner.clear()

    for i, text in enumerate(texts):
        for part in split_safely(text, part_chars) if splittable and len(text) > part_chars else [text]:
            size = len(part) if part.isascii() else len(part.encode())
            if queue and held + size > batch_bytes:
                flush()
                held = 0
            queue.append(part)
            owner.append(i)
            held += size
    if queue:
        flush()
    return counts


def count_tokens(
    docs: DataFrame, tokenizer_path: str = "byte_bpe_50k.json", limit: int = 512, id_col: str = "doc_id", text_col: str = "text",
    batch_bytes: int = BATCH_BYTES, part_chars: int = PART_CHARS,
) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of each row.

    Null and empty texts have 0 bytes and 0 tokens; repeated rows are counted each; an empty table gives
    no rows; further columns are not read. No begin, end or added tokens; special strings within a text
    are treated as the library does by default. sentencepiece texts are never split (its normalizer looks
    across spaces).
    """
    splittable = not tokenizer_path.endswith(".model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(tokenizer_path)
        for whole in batches:
            for batch in slices(whole, whole.column(1).to_pylist(), batch_bytes):
                counts = count_batch(tokenizer, [x or "" for x in batch.column(2).to_pylist()], batch_bytes, part_chars, splittable)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64())], ["id", "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col).alias("text"))
    out = map_arrow(rows, run, f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
