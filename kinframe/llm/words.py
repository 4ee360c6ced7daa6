"""Words of Arrow arrays of texts: maximal runs of bytes other than 0x20 and 0x09 to 0x0D."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(words of all texts in order, number of words of each text) of a binary array; null has none.

    Bytes that are no UTF-8 are letters like others: nothing is decoded.
    """
    plain = pc.fill_null(texts, b"")
    bare = pa.Array.from_buffers(pa.string(), len(plain), plain.buffers(), offset=plain.offset)
    parts = pc.ascii_split_whitespace(bare)
    sizes = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = parts.flatten()
    full = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    row = np.repeat(np.arange(len(sizes)), sizes)[full]
    return flat.filter(pa.array(full)), np.bincount(row, minlength=len(sizes)).astype(np.int64)
