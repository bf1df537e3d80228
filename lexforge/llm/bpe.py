"""Token counts under an existing byte-level BPE vocabulary.

A text is cut into pieces by the vocabulary's pattern. Each distinct piece becomes a linked list of byte symbols; a priority queue
hands out the pair of lowest rank (leftmost among equals) and merges it until no pair has a rank. The number of surviving symbols is
the piece's count; a text's count is the sum over its pieces weighted by their frequency. The result equals the encoder's length.
"""

from __future__ import annotations

import base64
import heapq
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Where the public vocabulary lies; a parameter of every operator here.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: The published splitting pattern of this family of vocabularies (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Distinct pieces whose counts a worker remembers; beyond it the memory starts afresh and counts stay exact.
REMEMBERED = 400_000


class Bpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ranks, self.find, self.seen = ranks, regex.compile(pattern).findall, {}

    @classmethod
    def of(cls, blob: bytes) -> "Bpe":
        """From the bytes of a rank file: base64 symbol, blank, rank on each line."""
        pairs = (line.split() for line in blob.splitlines() if line.strip())
        return cls({base64.b64decode(a): int(b) for a, b in pairs})

    def ends(self, piece: bytes) -> list[int]:
        """End offsets of the symbols that survive all merges."""
        ranks, n = self.ranks, len(piece)
        if n == 1 or piece in ranks:
            return [n]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = []
        for i in range(n - 1):
            r = ranks.get(piece[i : i + 2])
            if r is not None:
                queue.append((r, i, i + 2))
        heapq.heapify(queue)
        alive = [True] * n
        while queue:
            _, i, end = heapq.heappop(queue)
            if not alive[i] or after[i] >= n:
                continue
            j = after[i]
            k = after[j]
            if k != end:
                continue  # one side has grown since this pair was queued
            alive[j], after[i] = False, k
            if k < n:
                before[k] = i
                r = ranks.get(piece[i : after[k]])
                if r is not None:
                    heapq.heappush(queue, (r, i, after[k]))
            h = before[i]
            if h >= 0:
                r = ranks.get(piece[h:k])
                if r is not None:
                    heapq.heappush(queue, (r, h, k))
        out, i = [], 0
        while i < n:
            i = after[i]
            out.append(i)
        return out

    def piece(self, piece: str) -> int:
        n = self.seen.get(piece)
        if n is None:
            if len(self.seen) >= REMEMBERED:
                self.seen.clear()
            n = self.seen[piece] = len(self.ends(piece.encode("utf-8", "surrogatepass")))
        return n

    def count(self, text: str | None) -> int | None:
        if text is None:
            return None
        piece = self.piece
        return sum(piece(p) * f for p, f in Counter(self.find(text)).items())

    def starts(self, text: str) -> list[int]:
        """Character offset at which each token starts; a token that starts inside a character counts at that character."""
        out, at = [], 0
        for p in self.find(text):
            if self.piece(p) == 1:
                out.append(at)
            else:
                raw = p.encode("utf-8", "surrogatepass")
                first = 0
                chars = [0] * (len(raw) + 1)
                c = -1
                for k, byte in enumerate(raw):
                    c += (byte & 0xC0) != 0x80
                    chars[k] = c
                for e in self.ends(raw):
                    out.append(at + chars[first])
                    first = e
            at += len(p)
        return out


_LOADED: dict[int, Bpe] = {}


def load(shared) -> Bpe:
    """The vocabulary of a broadcast, parsed once in each worker process."""
    key = shared.id if hasattr(shared, "id") else id(shared)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Bpe.of(shared.value)
    return _LOADED[key]


def share(spark: SparkSession, path: str = VOCABULARY):
    """Broadcast the rank file (under 1 MB; its size is checked)."""
    with open(path, "rb") as f:
        blob = f.read()
    if len(blob) > 64 << 20:
        raise ValueError("a vocabulary above 64 MB is not broadcast")
    return spark.sparkContext.broadcast(blob)


def with_token_counts(df: DataFrame, text: str, out: str = "n_tokens", vocabulary: str = VOCABULARY) -> DataFrame:
    """Add the number of tokens of a text column.

    Null text gives null, empty text 0. The text itself travels to Python and the other columns come back with it; pass only the
    columns that are needed. No shuffle. A column that already bears the name `out` is replaced.
    """
    shared = share(df.sparkSession, vocabulary)
    names = [c for c in df.columns if c != out]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = load(shared)
        for b in batches:
            b = b.copy()
            b[out] = pd.Series([bpe.count(x) if isinstance(x, str) else None for x in b[text]], dtype="Int64", index=b.index)
            yield b

    schema = T.StructType([f for f in df.select(*names).schema.fields] + [T.StructField(out, T.LongType())])
    return df.select(*names).mapInPandas(run, schema)
