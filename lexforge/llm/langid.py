"""Languages of documents and of their segments: a bidirectional gated recurrent network over bytes.

A position of the network is a frame of FRAME consecutive bytes of UTF-8. Two gated recurrent layers read the frames from either side; every position gets a
distribution over the languages, trained in numpy by backpropagation through time. Positions are pooled by sentence, sentences by segment
and document.
"""

from __future__ import annotations

import ctypes
import glob
import os
import re
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.llm import boilerplate
from lexforge.llm.boilerplate import Weights, fold, site_of
from lexforge.llm.segment import sentences
from lexforge.runtime import cut

LANGUAGES = ("grc", "la", "en", "el", "de", "fr", "es", "it", "ru", "zh", "sa")
#: Labels that name a language: other codes and words, folded (fixed values).
LABELS = {
    "grc": "grc grc-classical grc-koine ancient-greek greek-ancient classical-greek koine-greek altgriechisch grec-ancien", "la": "la lat latin lat-classical latina lateinisch", "en": "en eng english anglais englisch",
    "el": "el ell gre greek modern-greek greek-modern neugriechisch", "de": "de deu ger german deutsch allemand", "fr": "fr fra fre french francais franzosisch", "es": "es spa spanish espanol castellano castilian",
    "it": "it ita italian italiano", "ru": "ru rus russian русский", "zh": "zh zho chi lzh chinese classical-chinese literary-chinese mandarin 中文", "sa": "sa san sanskrit",
}
CODE = {label: code for code, labels in LABELS.items() for label in labels.split()}
NO_LABEL = {"", "und", "unknown", "none", "null", "n/a", "mul", "zxx", "mis", "?"}

FRAME, HIDDEN, WINDOW = 4, 20, 48  # bytes a frame, units a direction, frames a window at inference
#: Batches at least, windows in a batch, frames in a window of training.
STEPS, BATCH, TRAIN_FRAMES = 260, 176, 20
#: A sentence whose label has at least this probability needs no step of its own; rounds over disjoint slices of a table of several parts.
LEARNED, SLICES = 0.9, 12
SENTENCES_OF_A_SECOND, STANZA = 3, 6  # so many verses of another language count as three sentences
_END = re.compile(r"[.!?;।॥]+(?:[”»“\"’)]*(?:\s+|$))|[。！？]+”?\s*")
_CLOSED = regex.compile(r"[.!?;。！？।॥…][”»“\"’)]*\s*$")


def code_of(label: str | None) -> str | None:
    """The language that a label names; None where it names none."""
    if not isinstance(label, str):
        return None
    plain = regex.sub(r"[\s_()]+", "-", fold(label)).strip("-")
    return CODE.get(plain) or CODE.get(plain.split("-")[0])


# ---------------------------------------------------------------- the network


@contextmanager
def _one_thread():
    """Matrix products as small as these are slower in several threads; where the library can't be told so, nothing changes."""
    lib = None
    try:
        lib = ctypes.CDLL(glob.glob(os.path.join(os.path.dirname(os.path.dirname(np.__file__)), "numpy.libs", "*openblas*"))[0])
        names = [n for n in ("scipy_openblas_{}_num_threads64_", "openblas_{}_num_threads64_", "scipy_openblas_{}_num_threads", "openblas_{}_num_threads") if hasattr(lib, n.format("set"))]
        get, put = getattr(lib, names[0].format("get")), getattr(lib, names[0].format("set"))
        before = get()
        put(1)
    except (IndexError, OSError, AttributeError):
        lib = None
    try:
        yield
    finally:
        if lib is not None:
            put(before)


def _sigmoid(x):
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Network:
    """Parameters: for each direction byte tables E (FRAME x 256 x 3H), recurrence U (H x 3H), bias; read-out W (2H x languages)."""

    def __init__(self, classes: int = len(LANGUAGES), hidden: int = HIDDEN, seed: int = 1):
        g = np.random.default_rng(seed)
        self.h = hidden
        self.p = {"W": g.normal(0, 0.2, (2 * hidden, classes)).astype(np.float32), "c": np.zeros(classes, np.float32)}
        for d in "fb":
            self.p["E" + d] = g.normal(0, 0.25, (FRAME, 256, 3 * hidden)).astype(np.float32)
            self.p["U" + d] = (g.normal(0, 1, (hidden, 3 * hidden)) / np.sqrt(hidden)).astype(np.float32)
            self.p["a" + d] = np.zeros(3 * hidden, np.float32)

    def _run(self, frames: np.ndarray, d: str):
        """All states of one direction for frames (N x T x FRAME), with what the way back needs."""
        p, H = self.p, self.h
        n, t, _ = frames.shape
        x = p["a" + d] + sum(p["E" + d][k][frames[:, :, k]] for k in range(FRAME))
        h = np.zeros((n, H), np.float32)
        hs, kept = np.empty((t, n, H), np.float32), []
        for s in range(t) if d == "f" else range(t - 1, -1, -1):
            u = h @ p["U" + d]
            zr = _sigmoid(x[:, s, : 2 * H] + u[:, : 2 * H])
            z, r = zr[:, :H], zr[:, H:]
            c = np.tanh(x[:, s, 2 * H :] + r * u[:, 2 * H :])
            new = (1 - z) * c + z * h
            kept.append((s, h, z, r, c, u[:, 2 * H :]))
            h = new
            hs[s] = h
        return hs, kept

    def loss_and_gradients(self, frames: np.ndarray, labels: np.ndarray):
        p, H = self.p, self.h
        n, t, _ = frames.shape
        runs = {d: self._run(frames, d) for d in "fb"}
        both = np.concatenate([runs["f"][0], runs["b"][0]], axis=2)
        logits = both @ p["W"] + p["c"]
        logits -= logits.max(axis=2, keepdims=True)
        prob = np.exp(logits)
        prob /= prob.sum(axis=2, keepdims=True)
        loss = -np.log(prob[:, np.arange(n), labels] + 1e-9).mean()
        g = prob
        g[:, np.arange(n), labels] -= 1
        g /= n * t
        grads = {"W": both.reshape(-1, 2 * H).T @ g.reshape(-1, g.shape[2]), "c": g.sum(axis=(0, 1))}
        back = g @ p["W"].T
        for k, d in enumerate("fb"):
            dh_out, U = back[:, :, k * H : (k + 1) * H], p["U" + d]
            dx = np.empty((n, t, 3 * H), np.float32)
            dU, dh = np.zeros_like(U), np.zeros((n, H), np.float32)
            for s, h, z, r, c, uc in reversed(runs[d][1]):
                dh = dh + dh_out[s]
                dc = dh * (1 - z) * (1 - c * c)
                dz = dh * (h - c) * z * (1 - z)
                dr = dc * uc * r * (1 - r)
                dx[:, s] = np.concatenate([dz, dr, dc], axis=1)
                du = np.concatenate([dz, dr, dc * r], axis=1)
                dU += h.T @ du
                dh = dh * z + du @ U.T
            grads["U" + d], grads["a" + d] = dU, dx.sum(axis=(0, 1))
            dE = np.zeros_like(p["E" + d])
            flat = dx.reshape(-1, 3 * H)
            for k2 in range(FRAME):
                order = np.argsort(frames[:, :, k2].ravel(), kind="stable")
                ids = frames[:, :, k2].ravel()[order]
                first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
                dE[k2][ids[first]] = np.add.reduceat(flat[order], first, axis=0)
            grads["E" + d] = dE
        return float(loss), grads

    def train(self, draw, steps: int = STEPS, rate: float = 0.012, part: tuple[float, float] = (0.0, 1.0)) -> float:
        """Adam over `steps` batches that `draw` gives; `part` tells from where to where on its way the training goes, by which its rate falls."""
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        loss = 0.0
        for i in range(1, steps + 1):
            value, grads = self.loss_and_gradients(*draw())
            loss = value if i == 1 else 0.95 * loss + 0.05 * value
            lr = rate * min(1.0, i / 20) * (1 - 0.9 * (part[0] + (part[1] - part[0]) * i / steps))
            for k, g in grads.items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                self.p[k] -= (lr * (m[k] / (1 - 0.9**i)) / (np.sqrt(v[k] / (1 - 0.99**i)) + 1e-7)).astype(np.float32)
        return loss

    def ready(self) -> None:
        """Tables of byte pairs for each gate and for the candidate state: a frame of four bytes costs two look-ups in each. The gates are
        halved beforehand, as a sigmoid is taken from tanh of the half. Every table and array of a step lies in one piece."""
        H = self.h
        self.tables = {}
        for d in "fb":
            E, a, U = self.p["E" + d], self.p["a" + d], self.p["U" + d]
            pairs = [(E[k][:, None, :] + E[k + 1][None, :, :]).reshape(65536, -1) + (a if k == 0 else 0) for k in range(0, FRAME, 2)]
            part = lambda x, q, by: np.ascontiguousarray(by * x[:, q * H : (q + 1) * H], dtype=np.float32)
            self.tables[d] = [([part(x, q, by) for x in pairs], part(U, q, 0.5)) for q, by in ((0, 0.5), (1, 0.5), (2, 1.0))]

    def positions(self, frames: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Log-probabilities (T x N x languages); windows are padded at the end, where both directions idle."""
        p, H = self.p, self.h
        n, t, _ = frames.shape
        pair = [np.ascontiguousarray((frames[:, :, 2 * k].astype(np.int64) * 256 + frames[:, :, 2 * k + 1]).T) for k in range(FRAME // 2)]
        logits = np.broadcast_to(p["c"], (t, n, len(p["c"]))).copy()
        gates, c, more = np.empty((2, n, H), np.float32), np.empty((n, H), np.float32), np.empty((n, H), np.float32)
        z, r = gates
        for k, d in enumerate("fb"):
            (tz, uz), (tr, ur), (tc, uc) = self.tables[d]
            W = p["W"][k * H : (k + 1) * H]
            h = np.zeros((n, H), np.float32)
            states = np.empty((t, n, H), np.float32)
            for s in range(t) if d == "f" else range(t - 1, -1, -1):
                for out, tables, u in ((z, tz, uz), (r, tr, ur)):
                    np.matmul(h, u, out=out)
                    for q, table in enumerate(tables):
                        np.take(table, pair[q][s], axis=0, out=more, mode="clip")
                        out += more
                np.tanh(gates, out=gates)
                gates += 1  # twice the gates: uc is halved for the one, h below for the other
                np.matmul(h, uc, out=c)
                c *= r
                for q, table in enumerate(tc):
                    np.take(table, pair[q][s], axis=0, out=more, mode="clip")
                    c += more
                np.tanh(c, out=c)
                h -= c
                h *= 0.5
                h *= z
                h += c
                if d == "b":
                    h[lengths <= s] = 0
                states[s] = h
            logits += (states.reshape(-1, H) @ W).reshape(t, n, -1)
        # states lie between -1 and 1, so the logits are bounded by the weights and need no shift
        logits -= np.log(np.exp(logits) @ np.ones((logits.shape[2], 1), np.float32))
        return logits


def pool(network: Network, units: list[bytes], block: int = 1024) -> np.ndarray:
    """Mean log-probabilities over the positions of each unit (bytes of a sentence)."""
    total = np.zeros((len(units), len(LANGUAGES)))
    count = np.ones(len(units))
    windows, owner = [], []
    span = FRAME * WINDOW
    for k, raw in enumerate(units):
        count[k] = max(1, -(-len(raw) // FRAME))
        for s in range(0, len(raw), span):
            windows.append(raw[s : s + span])
            owner.append(k)
    order = sorted(range(len(windows)), key=lambda i: len(windows[i]))
    for b in range(0, len(order), block):
        part = order[b : b + block]
        longest = -(-len(windows[part[-1]]) // FRAME)
        lengths = np.array([-(-len(windows[i]) // FRAME) for i in part])
        padded = b"".join([windows[i].ljust(longest * FRAME) for i in part])
        frames = np.frombuffer(padded, dtype=np.uint8).reshape(len(part), longest, FRAME)
        logs = network.positions(frames, lengths)
        inside = (np.arange(longest)[:, None] < lengths[None, :]).astype(np.float32)
        np.add.at(total, [owner[i] for i in part], np.einsum("tnl,tn->nl", logs, inside))
    return total / count[:, None]


# ---------------------------------------------------------------- sentences of a page


def prose(text: str, weights: Weights, site: str = "", lines: list[tuple[int, str]] | None = None) -> list[tuple[int, str]]:
    """(offset, sentence) of all lines of a text but those of the page; a verse or heading is a unit of its own. Offsets count in the restored text; `lines` are
    those of a text that is restored."""
    lines = boilerplate._lines(text, whole=True) if lines is None else lines
    gone = set(boilerplate.page_lines(text, weights, site, lines, short=True))
    out, at, last = [], 0, 1
    for n, line in lines:
        at += n - last  # line breaks
        last = n
        if n not in gone:
            s = 0
            for m in _END.finditer(line):
                e = m.end()
                if e - s > 20:  # abbreviations stay with their sentence
                    out.append((at + s, line[s:e]))
                    s = e
            if s < len(line):
                out.append((at + s, line[s:]))
        at += len(line)
    return out


def _drawer(pools: list[list[bytes]], g: np.random.Generator, due: list[tuple[int, bytes]] = ()):
    """Batches of windows: those that are `due` in their turn, and beside them windows drawn evenly from the languages, half a batch at least."""
    present = [k for k, x in enumerate(pools) if x]
    left = iter(due)
    span = TRAIN_FRAMES * FRAME

    def draw():
        labels, frames = g.choice(present, BATCH), np.full((BATCH, span), 32, dtype=np.uint8)
        turn = dict(enumerate(islice(left, BATCH // 2)))
        for j in range(BATCH):
            if j in turn:
                labels[j], raw = turn[j]
                s = 0
            else:
                raw = pools[labels[j]][g.integers(len(pools[labels[j]]))]
                s = int(g.integers(max(1, len(raw) - 24)))
            cut = np.frombuffer(raw[s : s + span], dtype=np.uint8)
            frames[j, : len(cut)] = cut
        return frames.reshape(BATCH, TRAIN_FRAMES, FRAME), labels

    return draw


def _round(network: Network, pools: list[list[bytes]], g: np.random.Generator, steps: int, done: float, upto: float, main: bool) -> list[dict[bytes, np.ndarray]]:
    """Trains a network on the sentences of each language, from the share `done` of the way to `upto`.

    In a main round every sentence is read first: those that the network assigns elsewhere with confidence are left out, as labels may be wrong in places, and all windows of those
    that it hasn't learned get their step, however many they are; the gradient of the others is near nothing. Gives the log-probabilities of the learned sentences of each language.
    """
    learned: list[dict[bytes, np.ndarray]] = [{} for _ in pools]
    due: list[tuple[int, bytes]] = []
    if main:
        network.ready()
        span = TRAIN_FRAMES * FRAME
        for k, units in enumerate(pools):
            if not units:
                continue
            once = list(dict.fromkeys(units))
            logs = pool(network, once)
            wrong = (logs.argmax(axis=1) != k) & (logs.max(axis=1) >= np.log(0.45))
            open_ = ~wrong & (logs[:, k] < np.log(LEARNED))
            learned[k] = {once[i]: logs[i].astype(np.float16) for i in np.flatnonzero(~wrong & ~open_)}
            bad = {once[i] for i in np.flatnonzero(wrong)}
            pools[k] = [u for u in units if u not in bad] or units
            due += [(k, once[i][s : s + span]) for i in np.flatnonzero(open_) for s in range(0, len(once[i]), span)]
        due = [due[i] for i in g.permutation(len(due))]
    network.train(_drawer(pools, g, due), max(steps, -(-len(due) // (BATCH // 2))), part=(done, upto))
    return learned


def train(rows: list[tuple[str, str]], weights: Weights, seed: int = 5) -> Network:
    """A network from all of the (text, language) rows: after a first short training every sentence is read, and the second takes up those that aren't learned (see `_round`)."""
    g = np.random.default_rng(seed)
    pools: list[list[bytes]] = [[] for _ in LANGUAGES]
    for text, lang in rows:
        pools[LANGUAGES.index(lang)] += _units(prose(text, weights))
    if not any(pools):
        raise ValueError("no labelled text to train on")
    network = Network(seed=seed)
    for _, _, steps, done, upto, main in _rounds(1):
        _round(network, pools, g, steps, done, upto, main)
    return network


def _units(found: list[tuple[int, str]]) -> list[bytes]:
    raw = (s.strip().encode("utf-8", "replace") for _, s in found)
    return [x for x in raw if len(x) >= 40]


def _rounds(parts: int) -> list[tuple[int, int, int, float, float, bool]]:
    """(first slice, slice behind the last, steps, share done before, share done behind, whether main) of each round; the main rounds read every slice once."""
    first = STEPS // 3
    if parts == 1:
        return [(0, SLICES, first, 0.0, 1 / 3, False), (0, SLICES, STEPS - first, 1 / 3, 1.0, True)]
    warm = [(k, k + 1, first // 2, k / 6, (k + 1) / 6, False) for k in range(2)]
    # the first main round has the most to learn and so the fewest slices
    return warm + [(low, high, (STEPS - first) // 3, (3 + 2 * k) / 9, (5 + 2 * k) / 9, True) for k, (low, high) in enumerate(((0, 2), (2, 6), (6, SLICES)))]


#: What is kept of a page that a main round read: its text compressed, with its size; (start, end, whether learned) of its sentences; the log-probabilities of the learned ones.
_READ = "z binary, size int, spans binary, logs binary"


def _page(z: bytes, size: int, spans: bytes, logs: bytes) -> tuple[list[tuple[int, str]], np.ndarray, np.ndarray]:
    """(offset, sentence), which of them are read, and their log-probabilities."""
    t = pa.decompress(z, decompressed_size=size, codec="zstd", asbytes=True).decode("utf-8", "surrogatepass")
    at = np.frombuffer(spans, dtype=np.int32).reshape(-1, 3)
    if not len(at):
        return [(0, t)], np.zeros(1, dtype=bool), np.zeros((0, len(LANGUAGES)))
    return [(s, t[s:e]) for s, e in at[:, :2].tolist()], at[:, 2] > 0, np.frombuffer(logs, dtype=np.float16).reshape(-1, len(LANGUAGES)).astype(float)


def train_all(pages: DataFrame, weights: Weights, seed: int = 5) -> tuple[Network, DataFrame]:
    """A network from all pages (see boilerplate.restored) whose label names a language; and every page once, as (k, t, site, a, z, size, spans, logs): those without
    such a label as they are, the others as the main round that read them left them (see _READ), without t.

    In each round every part of the pages trains a copy of the network on its own sentences, and the copies are averaged by the number of their sentences; each page is in one slice, by a hash of
    its key, and every slice is read by one main round. Copies (some 500 KB) are averaged in groups before they come to the driver.
    """
    spark = pages.sparkSession
    parts = pages.rdd.getNumPartitions()
    groups = max(1, int(np.sqrt(parts)))
    labelled = pages.where(F.col("by").isNotNull()).select("k", "t", "site", "by", "a", F.pmod(F.xxhash64(F.col("k").cast("string"), F.lit(SLICES)), F.lit(SLICES)).alias("slice"))
    network = Network(seed=seed)
    names, any_text = sorted(network.p), False
    kind = f"g int, n double, p binary, k {pages.schema['k'].dataType.simpleString()}, a string, {_READ}"
    columns = [x.split()[0] for x in kind.split(", ")]
    read = pages.where(F.col("by").isNull()).select("k", "t", "site", "a", *(F.lit(None).cast(x.split()[1]).alias(x.split()[0]) for x in _READ.split(", ")))
    for at, (low, high, steps, done, upto, main) in enumerate(_rounds(parts)):
        held = spark.sparkContext.broadcast((network.p, weights))

        def copies(batches: Iterator[pd.DataFrame], at=at, steps=steps, done=done, upto=upto, main=main, held=held) -> Iterator[pd.DataFrame]:
            p, w = held.value
            pools: list[list[bytes]] = [[] for _ in LANGUAGES]
            kept = []
            for b in batches:
                for k, t, site, by, a in zip(b["k"], b["t"], b["site"], b["by"], b["a"]):
                    found = prose(t, w, site, boilerplate.kept_lines(t))
                    lang = LANGUAGES.index(by)
                    pools[lang] += _units(found)
                    if main:
                        raw = t.encode("utf-8", "surrogatepass")
                        kept.append((k, a, lang, pa.compress(raw, codec="zstd", asbytes=True), len(raw), np.array([(s, s + len(x), 0) for s, x in found], dtype=np.int32).reshape(-1, 3)))
            size = sum(map(len, pools))
            learned: list[dict[bytes, np.ndarray]] = [{} for _ in pools]
            if size:
                part = TaskContext.get().partitionId()
                net = Network()
                net.p = {k: v.copy() for k, v in p.items()}
                with _one_thread():
                    learned = _round(net, pools, np.random.default_rng([seed, at, part]), steps, done, upto, main)
                yield pd.DataFrame([(part % groups, float(size), np.concatenate([net.p[k].ravel() for k in names]).astype(np.float32).tobytes(), *[None] * (len(columns) - 3))], columns=columns)
            for start in range(0, len(kept), 512):
                rows = []
                for k, a, lang, z, length, spans in kept[start : start + 512]:
                    t = pa.decompress(z, decompressed_size=length, codec="zstd", asbytes=True).decode("utf-8", "surrogatepass")
                    got = [learned[lang].get(t[s:e].strip().encode("utf-8", "replace")) for s, e in spans[:, :2].tolist()]
                    spans[:, 2] = [x is not None for x in got]
                    logs = [x.tobytes() for x in got if x is not None]
                    rows.append((None, None, None, k, a, z, length, spans.tobytes(), b"".join(logs)))
                yield pd.DataFrame(rows, columns=columns)

        def mean(b: pd.DataFrame) -> pd.DataFrame:
            total = sum(n * np.frombuffer(p, dtype=np.float32).astype(np.float64) for n, p in zip(b["n"], b["p"]))
            return pd.DataFrame({"g": b["g"][:1], "n": [b["n"].sum()], "p": [(total / b["n"].sum()).astype(np.float32).tobytes()]})

        out = labelled.where((F.col("slice") >= low) & (F.col("slice") < high)).mapInPandas(copies, kind)
        if main:
            out = cut(out)
            read = read.unionByName(out.where(F.col("g").isNull()).select("k", "a", *columns[5:]), allowMissingColumns=True)
        got = out.where(F.col("g").isNotNull()).select("g", "n", "p").groupBy("g").applyInPandas(mean, "g int, n double, p binary").orderBy("g").collect()
        if got:
            any_text = True
            flat = sum(r["n"] * np.frombuffer(r["p"], dtype=np.float32).astype(np.float64) for r in got) / sum(r["n"] for r in got)
            start = 0
            for k in names:
                size = network.p[k].size
                network.p[k] = flat[start : start + size].astype(np.float32).reshape(network.p[k].shape)
                start += size
        held.unpersist()
    if not any_text:
        raise ValueError("no labelled text to train on")
    return network, read


def named(label: str):
    """The language that a stored label names, by code or word, as a column; null where it names none."""
    names = F.create_map(*[F.lit(x) for pair in CODE.items() for x in pair])
    plain = F.trim(F.lower(F.regexp_replace(F.col(label), r"[\s_()]+", "-")), F.lit("-"))
    return F.coalesce(F.try_element_at(names, plain), F.try_element_at(names, F.split(plain, "-")[0]))


def models(pages: DataFrame) -> tuple[Network, Weights]:
    """The network and the weights of page lines, both from all pages (see `pages_of`)."""
    return readings(pages)[1:]


def readings(pages: DataFrame) -> tuple[DataFrame, Network, Weights]:
    """All pages with what training read of them (see `train_all`), and the models: a sentence that the network gave to its label with a probability of LEARNED needn't be read again."""
    weights = boilerplate.fit_all(pages)
    network, read = train_all(pages, weights)
    return read, network, weights


def pages_of(items: DataFrame, key: str, text: str, label: str, url: str | None = None) -> DataFrame:
    """The restored pages with the language that their label names (`by`) and the label as it came (`a`)."""
    return boilerplate.restored(items, key, text, url, named(label), label)


def _found(df: DataFrame, key: str, text: str, network: Network, weights: Weights, url: str | None, also: str | None, kinds: str, rows_of, counted: bool = True, ready: bool = False) -> DataFrame:
    """mapInPandas over texts: `rows_of` makes the result rows of (key, also, segments of the text). Texts that are `ready` are restored, and `url` holds their site; beside them may stand what training read (see `readings`)."""
    held = df.sparkSession.sparkContext.broadcast((network.p, weights))  # some hundred KB, whatever the input
    names = [x.strip().split()[0].strip("`") for x in kinds.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        net = Network()
        net.p, w = held.value
        net.ready()
        for whole in batches:
            for at in range(0, len(whole), 512):
                b = whole.iloc[at : at + 512]
                docs, units = [], []
                for k, t, u, a, *kept in zip(*(b[x] for x in b.columns)):
                    if kept and isinstance(kept[0], bytes):
                        found, known, have = _page(kept[0], int(kept[1]), *kept[2:])
                    elif not isinstance(t, str) or not t.strip():
                        continue
                    else:
                        found = (prose(t, w, u or "", boilerplate.kept_lines(t)) if ready else prose(t, w, site_of(u))) or [(0, t)]
                        known, have = np.zeros(len(found), dtype=bool), None
                    docs.append((k, a, found, known, have, len(units)))
                    units += [s.strip().encode("utf-8", "replace") for (_, s), x in zip(found, known.tolist()) if not x]
                once = {u: k for k, u in enumerate(dict.fromkeys(units))}  # a sentence that comes again is read once
                logs = pool(net, list(once))[[once[u] for u in units]] if units else np.zeros((0, len(LANGUAGES)))
                rows = []
                for k, a, found, known, have, first in docs:
                    own = np.empty((len(found), len(LANGUAGES)))
                    own[~known] = logs[first : first + int((~known).sum())]
                    if have is not None:
                        own[known] = have
                    rows += rows_of(k, a, segments(found, own, counted))
                yield pd.DataFrame(rows, columns=names)

    null = F.lit(None).cast("string")
    return df.select(F.col(key).alias("k"), F.col(text).alias("t"), (F.col(url) if url else null).alias("u"), (F.col(also) if also else null).alias("a"), *(x for x in ("z", "size", "spans", "logs") if ready and "z" in df.columns)).mapInPandas(run, kinds)


def languages(df: DataFrame, key: str, text: str, network: Network, weights: Weights, url: str | None = None, ready: bool = False) -> DataFrame:
    """(key, segment_no, start_pos, end_pos, language, confidence, sentences, share): the segments of every text.

    Neighbouring sentences of one language form a segment; a stretch of a language with fewer than SENTENCES_OF_A_SECOND whole sentences in
    the document takes the language around it. `sentences` and `share` tell of the language in the document; positions count in the restored
    text. Null, empty and blank texts give no row. Each row is handled alone; no shuffle.
    """
    kind = df.schema[key].dataType.simpleString()
    kinds = f"`{key}` {kind}, segment_no int, start_pos long, end_pos long, language string, confidence double, sentences int, share double"
    return _found(df, key, text, network, weights, url, None, kinds, lambda k, a, found: [(k, *x) for x in found], ready=ready)


def document_languages(df: DataFrame, key: str, text: str, label: str, network: Network, weights: Weights, url: str | None = None, ready: bool = False) -> DataFrame:
    """(key, label, language, languages, confidence): the main language of every text, all its languages, and the label as it came.

    The main language is that of the largest share, among equals the first by code. Null, empty and blank texts give no row. Each row is handled alone; no shuffle.
    """

    def rows(k, a, found):
        share = {x[3]: x[6] for x in found}
        main = min(share, key=lambda x: (-share[x], x))
        sure = [(x[4], x[2] - x[1] + 1) for x in found if x[3] == main]
        return [(k, a, main, sorted(share), sum(c * n for c, n in sure) / sum(n for _, n in sure))]

    kind = df.schema[key].dataType.simpleString()
    return _found(df, key, text, network, weights, url, label, f"`{key}` {kind}, label string, language string, languages array<string>, confidence double", rows, counted=False, ready=ready)


def _whole(found: list[tuple[int, str]], own: np.ndarray) -> int:
    """Whole sentences among the marked pieces, neighbouring pieces read together."""
    runs, last = [], -2
    for i in np.flatnonzero(own):
        if i == last + 1 and found[i][0] - (found[last][0] + len(found[last][1])) < 2:
            runs[-1] += "\n" * (found[i][0] - (found[last][0] + len(found[last][1]))) + found[i][1]
        else:
            runs.append(found[i][1])
        last = i
    return sum(1 for r in runs for s, e in sentences(r) if e - s >= 12 and _CLOSED.search(r[max(s, e - 12) : e]))


def _stanza(found: list[tuple[int, str]], own: np.ndarray) -> bool:
    """Whether STANZA neighbouring lines without an end mark (verses) are among the marked pieces."""
    run = 0
    for i, x in enumerate(own):
        run = run + 1 if x and len(found[i][1]) >= 12 else 0
        if run >= STANZA:
            return True
    return False


def segments(found: list[tuple[int, str]], logs: np.ndarray, counted: bool = True) -> list[tuple]:
    """Segments of one document from the pooled log-probabilities of its sentences; the whole sentences of a document in one language are counted
    if they are wanted."""
    weight = np.array([len(s) for _, s in found], dtype=float)
    best = logs.argmax(axis=1)
    if not counted and (best == best[0]).all():
        k = int(best[0])
        p = np.exp(weight @ logs / weight.sum())
        return [(0, found[0][0] + 1, found[-1][0] + len(found[-1][1]), LANGUAGES[k], float(p[k] / p.sum()), None, 1.0)]
    sure = np.exp(np.partition(logs, -2, axis=1)[:, -2] - logs.max(axis=1)) < 0.5
    whole = np.array([len(s) >= 12 and bool(_CLOSED.search(s[-12:])) and len(s.strip()) >= 12 for _, s in found])
    one = np.unique(best)
    count = {int(k): int((whole & sure & (best == k)).sum()) for k in one}
    if len(one) == 1:
        k = int(one[0])
        p = np.exp((logs * weight[:, None]).sum(axis=0) / weight.sum())
        return [(0, found[0][0] + 1, found[-1][0] + len(found[-1][1]), LANGUAGES[k], float(p[k] / p.sum()), count[k], 1.0)]
    main = int((logs * weight[:, None]).sum(axis=0).argmax())
    votes = {int(k): weight[best == k].sum() for k in one}
    if votes.get(main, 0) < max(votes.values()):
        main = max(votes, key=votes.get)
    for k, n in count.items():
        if k != main and n >= SENTENCES_OF_A_SECOND - 1:
            count[k] = _whole(found, (best == k) & sure)
        if k != main and count[k] < SENTENCES_OF_A_SECOND and _stanza(found, (best == k) & sure & ~whole):
            count[k] = SENTENCES_OF_A_SECOND
    kept = {main, *(k for k, n in count.items() if n >= SENTENCES_OF_A_SECOND)}
    label = np.array([k if k in kept else main for k in best])
    # a lone doubtful sentence goes with its neighbours
    for i in range(1, len(label) - 1):
        if label[i - 1] == label[i + 1] != label[i] and not sure[i]:
            label[i] = label[i - 1]
    out, s = [], 0
    share = {k: float(weight[label == k].sum() / weight.sum()) for k in set(label)}
    for i in range(1, len(label) + 1):
        if i == len(label) or label[i] != label[s]:
            k = label[s]
            mean = (logs[s:i] * weight[s:i, None]).sum(axis=0) / weight[s:i].sum()
            p = np.exp(mean - mean.max())
            out.append((len(out), found[s][0] + 1, found[i - 1][0] + len(found[i - 1][1]), LANGUAGES[k], float(p[k] / p.sum()), count[k], share[k]))
            s = i
    return out
