"""Cut oversized texts at their strongest natural boundaries, with overlap, by range-maximum queries over token positions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.llm.bpe import VOCABULARY, Bpe, load, share

LIMIT, OVERLAP = 4096, 64
#: Strength of the place before a token, by what stands there; the strongest wins (fixed values).
BOUNDARIES = (
    (5, regex.compile(r"\n[ \t]*\n\s*")),
    (4, regex.compile(r"\n\s*")),
    (3, regex.compile(r"(?:[.!?;;…](?=\s)|[。！？।॥])[\"'”’»」』)\]]*\s*")),
    (2, regex.compile(r"(?:[,:·—–](?=\s)|[，、；：])\s*")),
    (1, regex.compile(r"\s+")),
)


class RangeMax:
    """Sparse table: position of the greatest value in any range of up to `widest` positions, the rightmost among equals, in constant time."""

    def __init__(self, values: np.ndarray, widest: int | None = None):
        n = len(values)
        self.values = values
        level = np.arange(n, dtype=np.int32)
        self.levels = [level]
        width = 1
        while 2 * width <= min(n, widest or n):
            left, right = level[: n - 2 * width + 1], level[width : n - width + 1]
            level = np.where(values[right] >= values[left], right, left)
            self.levels.append(level)
            width *= 2

    def query(self, a: int, b: int) -> int:
        """Of the positions a <= p < b."""
        k = int(b - a).bit_length() - 1
        left, right = int(self.levels[k][a]), int(self.levels[k][b - (1 << k)])
        return right if self.values[right] >= self.values[left] else left


def pieces(text: str, bpe: Bpe, limit: int = LIMIT, overlap: int = OVERLAP, least: float = 0.5) -> list[tuple[int, int, int]]:
    """(start, end, tokens) in characters. A piece is cut where the boundary is strongest among the lengths from `least` x limit to
    the limit, the last one among equals; the next piece starts `overlap` tokens before the cut."""
    starts = np.asarray(bpe.starts(text), dtype=np.int64)
    n = len(starts)
    if n <= limit:
        return [(0, len(text), n)]
    strength = np.zeros(len(text) + 1, dtype=np.int8)
    for value, pattern in reversed(BOUNDARIES):
        for m in pattern.finditer(text):
            # a token may start with the blank before a word: both places are the same boundary
            strength[m.end()] = max(strength[m.end()], value)
            if m.end() > m.start() and text[m.end() - 1] == " ":
                strength[m.end() - 1] = max(strength[m.end() - 1], value)
    fresh = np.r_[True, starts[1:] > starts[:-1]]  # a token inside a character is no place to cut
    table = RangeMax(np.where(fresh, strength[starts], np.int8(-1)), limit + 1)
    out, s = [], 0
    while True:
        begin = int(starts[s])
        room = limit
        while True:
            if n - s <= room and bpe.count(text[begin:]) <= limit:
                out.append((begin, len(text), bpe.count(text[begin:])))
                return out
            first = s + max(overlap + 1, int(limit * least))
            last = min(s + room, n - 1)
            cut = table.query(min(first, last), last + 1)
            size = bpe.count(text[begin : int(starts[cut])])
            if size <= limit:
                break
            room -= size - limit  # a slice can need a token more than it did inside the text
        out.append((begin, int(starts[cut]), size))
        s = cut - overlap
        while s > 0 and not fresh[s]:
            s -= 1


def split(df: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, piece_no, start_char, end_char, n_tokens, piece) for each text above the limit.

    Texts at or below the limit, empty and null texts give no row; repeated rows are split each. A token has at least one byte, so texts of no
    more bytes than the limit are passed over without counting (exact). Lengths count characters from 0. No shuffle.
    """
    shared = share(df.sparkSession, vocabulary)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = load(shared)
        for b in batches:
            rows = []
            for k, t in zip(b["k"], b["t"]):
                if bpe.count(t) > limit:
                    rows += [(k, i, s, e, n, t[s:e]) for i, (s, e, n) in enumerate(pieces(t, bpe, limit, overlap))]
            yield pd.DataFrame(rows, columns=[key, "piece_no", "start_char", "end_char", "n_tokens", "piece"])

    kind = df.schema[key].dataType.simpleString()
    large = df.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.octet_length("t") > limit)
    return large.mapInPandas(run, f"`{key}` {kind}, piece_no int, start_char int, end_char int, n_tokens int, piece string")
