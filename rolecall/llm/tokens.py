"""Token counts: texts are encoded in batches on the executors and only the counts come back.

The vocabulary is read where the tasks run, from a path that is a parameter. Inside an Arrow
batch texts are cut into encoding calls of about equal bytes. A text longer than ``PART_CHARS``
is cut at safe boundaries: a single space between two ASCII letters or digits. No piece of the
vocabulary continues over the start of a word, and the encoder itself puts a word start before
each part, which stands for the dropped space; so the counts of the parts add up to the count of
the text. A vocabulary that has such a piece is refused for cutting: texts are then encoded whole.

Defined cases: a null or empty text has 0 tokens; a text without a safe boundary is encoded whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

PART_CHARS = 32_768
CALL_BYTES = 1 << 20
_SAFE = re.compile(r"(?<=[A-Za-z0-9]) (?=[A-Za-z0-9])")


@lru_cache(maxsize=4)
def _encoder(path: str):
    """(function from texts to token counts, whether long texts may be cut)"""
    if path.endswith(".model"):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        word_start = "▁"
        cut = not any(word_start in model.id_to_piece(i).lstrip(word_start) for i in range(model.get_piece_size()))
        cut = cut and len(model.encode("a b")) == len(model.encode("a")) + len(model.encode("b"))
        return (lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]), cut
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    return (lambda texts: [len(x) for x in model.encode_batch(texts, add_special_tokens=False)]), False


def safe_parts(text: str, limit: int = PART_CHARS) -> list[str]:
    """Parts of about ``limit`` characters, cut at a safe boundary; it is dropped."""
    parts, at = [], 0
    while len(text) - at > limit:
        found = _SAFE.search(text, at + limit)
        if not found:
            break
        parts.append(text[at : found.start()])
        at = found.end()
    parts.append(text[at:])
    return parts


def count_batch(texts: list[str | None], path: str, part_chars: int = PART_CHARS, call_bytes: int = CALL_BYTES) -> np.ndarray:
    encode, cut = _encoder(path)
    total = np.zeros(len(texts), np.int64)
    call: list[str] = []
    owner: list[int] = []
    size = 0

    def flush() -> None:
        if call:
            np.add.at(total, owner, encode(call))
            call.clear()
            owner.clear()

    for row, text in enumerate(texts):
        if not text:
            continue
        for part in safe_parts(text, part_chars) if cut else [text]:
            call.append(part)
            owner.append(row)
            size += len(part) if part.isascii() else len(part.encode())
            if size >= call_bytes:
                flush()
                size = 0
    flush()
    return total


def n_tokens(text: Column | str, path: str, part_chars: int = PART_CHARS) -> Column:
    """Column with the number of tokens of ``text`` under the vocabulary at ``path``."""

    @F.arrow_udf("long")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(count_batch(texts.to_pylist(), path, part_chars))

    return count(F.col(text) if isinstance(text, str) else text)
