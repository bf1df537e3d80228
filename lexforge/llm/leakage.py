"""Passages of held-out items inside documents: spaced seeds of four units find candidates, an alignment with substitutions verifies them."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words or ideographs of a seed. With one edit in six, L of them hold L - L/6 unchanged ones in L/6 + 1 runs at most; runs too short for a seed
#: of four take up to half of L, so seeds always cover a third of L or more (q-gram lemma): no passage within the rule is missed for want of seeds.
SEED = 4
#: The positions that each fixed mask compares; the second ignores one between them, so that a changed unit there hides nothing. The first, without a
#: gap, is the one that the bound above rests on: dropped and added units shift what follows, which no gapped mask survives.
MASKS = ((0, 1, 2, 3), (0, 1, 3, 4))
EXACT, LONG, EDITS = (15, 30), (30, 60), 6  # words and ideographs; one edit in EDITS
#: Test items up to this many bytes of text are held in every task; a larger set is taken in blocks.
BROADCAST_BYTES = 8 << 20
_UNIT = regex.compile(r"[\p{L}\p{M}]+")
_HAN = regex.compile(r"\p{Han}")
#: Marks of a page or folio between words, and inserted numbers, are not words (fixed values).
_PAGE = regex.compile(r"[\[({|<]\s*(?:p|pp|pag|page|f|fol|S|s|σελ|стр|p\.\s*\d+|col|л)?\.?\s*\d+\s*[rvab]?\s*[\])}|>]|\b(?:p|pp|fol|pag|σελ|стр)\.\s*\d+[rv]?", regex.I)


_UNSEEN = str.maketrans("", "", "\u00ad\u200b\u200c\u200d\u2060\ufeff")
_INVISIBLE = regex.compile("[\u00ad\u200b-\u200d\u2060\ufeff]")


def words(text: str) -> list[str]:
    """The raw words of a text, without numbers and page marks; words divided at a line's end are joined."""
    if _INVISIBLE.search(text):
        text = text.translate(_UNSEEN)
    text = _PAGE.sub(" ", text)
    if "-\n" in text:
        text = regex.sub(r"(?<=\p{L})-\n\s*(?=\p{Ll})", "", text)
    return _UNIT.findall(text)


def units(word: str) -> list[str]:
    """What is compared of a word: no case or accents; ideographs one by one."""
    w = unicodedata.normalize("NFKD", word).casefold()
    w = "".join([c for c in unicodedata.normalize("NFKD", w) if not unicodedata.combining(c)]).replace("ς", "σ")
    if _HAN.search(w):
        return list(w)
    return [w] if w else []


class Items:
    """The held-out passages, indexed by the hashes of their spaced seeds."""

    def __init__(self, rows: list[tuple[int, str]]):
        first = {}
        for _, t in rows:
            head = t.partition(":")[0] if t and ":" in t[:80] else None
            if head and head.isascii():
                first[head] = first.get(head, 0) + 1
        self.instructions = {h for h, n in first.items() if n > 2}
        self.vocabulary: dict[str, int] = {}
        self.items: list[tuple[int, np.ndarray, bool]] = []
        for k, t in rows:
            if not t:
                continue
            head, mark, rest = t.partition(":")
            parts = [u for w in words(rest if mark and head in self.instructions else t) for u in units(w)]
            ids = np.array([self.vocabulary.setdefault(u, len(self.vocabulary)) for u in parts], dtype=np.int64)
            signs = sum(bool(_HAN.match(u)) for u in parts) * 2 > len(parts)
            self.items.append((k, ids, signs))
        self.known: dict[str, tuple[int, ...]] = {}
        self.factors = np.random.default_rng(7).integers(1, 1 << 62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.tables = []
        keys, where = [], []
        for n, (_, ids, _) in enumerate(self.items):
            for m in range(len(MASKS)):
                h = self.hashes(ids, m)
                keys.append(h)
                where.append(np.stack([np.full(len(h), n), np.arange(len(h)), np.full(len(h), m)], 1))
        h = np.concatenate(keys) if keys else np.zeros(0, dtype=np.uint64)
        order = np.argsort(h, kind="stable")
        self.keys, self.where = h[order], np.concatenate(where)[order] if keys else np.zeros((0, 3), dtype=np.int64)
        self.some = np.zeros(1 << 20, dtype=bool)
        self.some[h >> np.uint64(44)] = True
        #: Seeds that a passage has at least: by the exact rule, and by the edited one (a third of its length, four units a seed)
        self.least = np.array([min(EXACT[s] - SEED + 1, -(-LONG[s] // (3 * SEED))) for _, _, s in self.items], dtype=np.int64)

    def hashes(self, ids: np.ndarray, mask: int) -> np.ndarray:
        """A hash for each position of a mask: the units that it compares, each times its own factor."""
        n = max(0, len(ids) - MASKS[mask][-1])
        x = ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        h = np.full(n, mask, dtype=np.uint64)
        for k, p in enumerate(MASKS[mask]):
            h += x[p : p + n] * self.factors[k]
        h ^= h >> np.uint64(31)
        return h * self.factors[63]

    def encode(self, text: str) -> list[int]:
        known, out = self.known, []
        for w in words(text):
            ids = known.get(w)
            if ids is None:
                if len(known) > 500_000:
                    known.clear()
                ids = known[w] = tuple(self.vocabulary.get(u, -1) for u in units(w))
            out += ids
        return out

    def candidates(self, texts: list[list[int]]) -> list[tuple[int, int, np.ndarray]]:
        """(text, item, hits) with hits = (position in text, position in item, mask); all texts of a batch are hashed at once."""
        sizes = np.array([len(t) + 12 for t in texts], dtype=np.int64)
        begins = np.r_[0, np.cumsum(sizes)]
        ids = np.full(int(begins[-1]), -1, dtype=np.int64)
        for t, at in zip(texts, begins):
            ids[at : at + len(t)] = t
        lone = ids < 0
        ids[lone] = -2 - np.flatnonzero(lone)  # words outside the vocabulary match nothing, not even one another
        found = []
        for m in range(len(MASKS)):
            h = self.hashes(ids, m)
            hit = np.flatnonzero(self.some[h >> np.uint64(44)])
            a, b = np.searchsorted(self.keys, h[hit], "left"), np.searchsorted(self.keys, h[hit], "right")
            n = b - a
            rows = np.repeat(a - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            at = np.repeat(hit, n)
            text = np.searchsorted(begins, at, "right") - 1
            found.append(np.column_stack([text, self.where[rows, 0], at - begins[text], self.where[rows, 1:]]))
        hits = np.concatenate(found)
        if not len(hits):
            return []
        hits = hits[np.lexsort((hits[:, 2] - hits[:, 3], hits[:, 1], hits[:, 0]))]
        cuts = np.flatnonzero((np.diff(hits[:, 0]) != 0) | (np.diff(hits[:, 1]) != 0)) + 1
        first, last = np.r_[0, cuts], np.r_[cuts, len(hits)]
        enough = last - first >= self.least[hits[first, 1]]
        return [(int(hits[s, 0]), int(hits[s, 1]), hits[s:e, 2:]) for s, e in zip(first[enough], last[enough])]

    def contains(self, ids: list[int], item: int, hits: np.ndarray) -> bool:
        """Whether the text holds the passage: by the exact rule on every diagonal with seeds enough, by the edited rule on a band around each group
        of them. `hits` are in the order of their diagonals."""
        _, test, signs = self.items[item]
        ids = np.asarray(ids, dtype=np.int64)
        exact, long = EXACT[signs], LONG[signs]
        if len(test) < exact:
            return False
        diagonal = hits[:, 0] - hits[:, 1]
        each, count = np.unique(diagonal, return_counts=True)
        if any(self._exact(ids, test, int(d), exact) for d in each[count > exact - SEED]):
            return True
        if len(test) < long:
            return False
        done = -(1 << 60)  # diagonals up to here need no alignment of their own
        slack = max(8, len(test) // EDITS + 2)
        first, last = np.searchsorted(diagonal, each - slack, "left"), np.searchsorted(diagonal, each + slack, "right")
        for d, a, b in zip(each, first, last):
            if d <= done or b - a < -(-long // (3 * SEED)):
                continue
            covered = np.zeros(len(test) + MASKS[-1][-1] + 1, dtype=np.int64)
            for m, mask in enumerate(MASKS):
                own = hits[a:b][hits[a:b, 2] == m, 1]
                for k in mask:
                    covered[own + k] = 1
            value = 3 * np.r_[0, np.cumsum(covered[: len(test)])] - np.arange(len(test) + 1)  # a third of a stretch is covered, or it is none
            if not (value[long:] >= np.minimum.accumulate(value[: len(test) + 1 - long])).any():
                continue
            done = d + 2
            if self._edited(ids, test, int(d), slack, long):
                return True
        return False

    @staticmethod
    def _exact(ids: np.ndarray, test: np.ndarray, d: int, least: int) -> bool:
        a, b = max(0, -d), min(len(test), len(ids) - d)
        same = test[a:b] == ids[a + d : b + d]
        gaps = np.flatnonzero(~np.r_[False, same, False])
        return bool((np.diff(gaps) - 1).max(initial=0) >= least)

    @staticmethod
    def _edited(ids: np.ndarray, test: np.ndarray, d: int, slack: int, least: int) -> bool:
        """Align the item to the band d +- slack of the text; then look for a stretch of the item with `least` words or more and no
        more than one edit in EDITS of them."""
        n = len(test)
        if n < least:
            return False
        width = 2 * slack + 1
        size = len(ids)
        places = np.arange(width)
        padded = np.full(size + n + 2 * width + 2 * abs(d), -1, dtype=np.int64)  # no word stands before or behind the text
        before = width + abs(d)
        padded[before : before + size] = ids
        previous = np.zeros(width, dtype=np.int64)  # cost at (0 item words, text position d - slack + j): free start
        back = []
        for i in range(1, n + 1):
            base = before + i - 1 + d - slack
            row = previous + (padded[base : base + width] != test[i - 1])
            moves = np.ones(width, dtype=np.int8)
            dropped = np.r_[previous[1:] + 1, 1 << 30]  # item word dropped
            moves[dropped < row] = 2
            row = np.minimum(row, dropped)
            added = np.minimum.accumulate(row - places) + places  # text words added
            moves[added < row] = 3
            back.append(moves)
            previous = added
        text = ids
        j = min(range(width), key=previous.tolist().__getitem__)
        i, cost = n, [0] * n
        while i:
            move = back[i - 1][j]
            if move == 1:
                p = i - 1 + d - slack + j
                cost[i - 1] += not (0 <= p < size and text[p] == test[i - 1])
                i -= 1
            elif move == 2:
                cost[i - 1] += 1
                i, j = i - 1, j + 1
            else:
                cost[i - 1] += 1
                j -= 1
        edits = np.r_[0, np.cumsum(cost)]
        value = np.arange(n + 1) - EDITS * edits  # words less six for each edit, up to each place
        low = np.minimum.accumulate(value[: n + 1 - least])
        most = (value[least:] - low).max()
        if most >= 0 or most < -4 * EDITS:
            return bool(most >= 0)
        # close to the limit the cheapest path of the whole item may lay an edit to the wrong side of the stretch's end: try every beginning
        starts = np.arange(n + 1 - least)[:, None]
        costs = np.zeros((len(starts), width), dtype=np.int64)
        for i in range(1, n + 1):
            base = before + i - 1 + d - slack
            row = costs + (padded[base : base + width] != test[i - 1])
            row[:, :-1] = np.minimum(row[:, :-1], costs[:, 1:] + 1)
            row = np.minimum.accumulate(row - places, axis=1) + places
            costs = np.where(starts < i, row, 0)
            length = i - starts[:, 0]
            if ((length >= least) & (costs.min(axis=1) * EDITS <= length)).any():
                return True
        return False


def leaks(documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", block_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(key, item): documents that hold a passage of an item, each pair once.

    The size of the items is checked: they are broadcast while they have at most `block_bytes` of text; a larger set is taken in blocks of that
    size, every block against all documents. Each task hashes its documents at every position under every mask and looks the hashes up, so
    documents never move. Null or empty texts and items without the least number of words give no row; repeated document rows give one pair.
    """
    spark = documents.sparkSession
    rows = items.select(F.col(item).alias("i"), F.col(item_text).alias("t")).where("t is not null")
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    kinds = f"`{key}` {documents.schema[key].dataType.simpleString()}, `{item}` {items.schema[item].dataType.simpleString()}"
    docs = documents.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.col("t").isNotNull())
    out = None
    for b in range(blocks):
        part = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == b)
        held = spark.sparkContext.broadcast([(r["i"], r["t"]) for r in part.collect()])

        def run(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            index = Items(held.value)
            for batch in batches:
                found = []
                keys = batch["k"].tolist()
                texts = [index.encode(t) for t in batch["t"]]
                for d, n, hits in index.candidates(texts):
                    if index.contains(texts[d], n, hits):
                        found.append((keys[d], index.items[n][0]))
                yield pd.DataFrame(found, columns=[key, item])

        one = docs.mapInPandas(run, kinds)
        out = one if out is None else out.unionByName(one)
    return out.distinct()
