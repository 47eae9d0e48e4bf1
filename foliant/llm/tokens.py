"""Words of Arrow batches in bounded pieces, for the operators that run on Python workers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that a worker takes apart at a time, unless one text alone has more.
PIECE = 4 * 2**20


def pieces(texts: pa.Array, limit: int = PIECE, table: bytes | None = None) -> Iterator[tuple[int, list[list[bytes]]]]:
    """(row at which a piece starts, the words of each of its texts); A-Z lower-cased. texts is binary; null has no words.

    bytes.lower() changes A-Z only and bytes.split() splits at exactly space and 0x09 to 0x0D. table maps bytes before that.
    """
    start, held, size = 0, [], 0
    for i, x in enumerate(texts):
        text = x.as_py() or b""
        if held and size + len(text) > limit:
            yield start, held
            start, held, size = i, [], 0
        held.append((text.translate(table) if table else text).lower().split())
        size += len(text)
    if held:
        yield start, held


def ends(words: list[list[bytes]]) -> np.ndarray:
    """Where each text's words begin in the piece, and the end of the last: length + 1 offsets."""
    return np.concatenate(([0], np.cumsum([len(w) for w in words], dtype=np.int64)))
