"""Exact search of any number of phrases in any number of texts.

Every text is read once per ``PER_PASS`` phrases, in windows: a rolling hash finds the places where the first characters
of a phrase may stand, a second look takes the hash of the whole phrase there. What is found is cut out of the text and
joined to the phrases as a string, so a hash never decides what matches; only found passages are shuffled. The hashes of
the phrases lie in the shared folder, sorted out per pass, and are read by the tasks.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kledger.session import arrow_uri, place, written

HEADS = (1, 2, 3, 8, 16)
"""A phrase is looked for by its first so many characters: the largest of these that it has."""
WINDOW = 1 << 18
PER_PASS = 2_000_000
_BASE = 0x9E3779B97F4A7C15
_SPREAD = np.uint64(0xD6E8FEB86659FD93)


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64."""
    out = []
    for b in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.full(n, b, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


class _Sums:
    """Hashes of any substrings of one array of code points."""

    def __init__(self, cp: np.ndarray):
        up, self.down = _powers(1 << (len(cp) + 1).bit_length())
        self.sums = np.zeros(len(cp) + 1, np.uint64)
        np.cumsum((cp.astype(np.uint64) + np.uint64(1)) * up[: len(cp)], out=self.sums[1:])

    def every(self, size: int) -> np.ndarray:
        """Of all windows of ``size`` characters."""
        d = self.sums[size:] - self.sums[:-size]
        return d * self.down[: len(d)]

    def at(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        return (self.sums[start + size] - self.sums[start]) * self.down[start] + size.astype(np.uint64) * _SPREAD


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _head(size: int) -> int:
    return max(h for h in HEADS if h <= size)


def _hashed(batches):
    """Phrases -> (n_head, head, size, whole): lengths and hashes of their beginning and of themselves."""
    for pdf in batches:
        out = []
        for q in pdf["q"]:
            s, zero, n = _Sums(_points(q)), np.zeros(1, np.int64), len(q)
            out.append((_head(n), int(s.every(_head(n))[0].view(np.int64)), n, int(s.at(zero, np.array([n]))[0].view(np.int64))))
        yield pd.DataFrame(out, columns=["n_head", "head", "size", "whole"])


class _Index:
    """The hashes of one pass: per head length a bitmap, the sorted heads, and the phrase lengths that go on from each."""

    def __init__(self, t: pd.DataFrame):
        self.longest = int(t["size"].max()) if len(t) else 0
        self.whole = np.unique(t["whole"].to_numpy().view(np.uint64))
        self.heads = []
        for n_head, own in t.groupby("n_head"):
            own = own[["head", "size"]].drop_duplicates()
            head, size = own["head"].to_numpy().view(np.uint64), own["size"].to_numpy(np.int64)
            order = np.lexsort((size, head))
            keys, first = np.unique(head[order], return_index=True)
            shift = np.uint64(64 - max(16, min(27, (16 * len(keys)).bit_length())))
            bits = np.zeros(1 << (64 - int(shift)), bool)
            bits[(keys * _SPREAD) >> shift] = True
            self.heads.append((int(n_head), shift, bits, keys, np.append(first, len(order)), size[order]))

    def places(self, cp: np.ndarray, ends: np.ndarray, starts: int) -> tuple[np.ndarray, np.ndarray]:
        """(position, length) of what may be a phrase among the first ``starts`` positions; none crosses ``ends``."""
        sums, at, long = _Sums(cp), [], []
        for n_head, shift, bits, keys, first, sizes in self.heads:
            if len(cp) < n_head:
                continue
            h = sums.every(n_head)[:starts]
            pos = np.flatnonzero(bits[(h * _SPREAD) >> shift])
            k = np.minimum(np.searchsorted(keys, h[pos]), len(keys) - 1)
            pos, k = pos[keys[k] == h[pos]], k[keys[k] == h[pos]]
            n = first[k + 1] - first[k]
            size = sizes[np.repeat(first[k] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            pos = np.repeat(pos, n)
            ok = pos + size <= ends[np.searchsorted(ends, pos, side="right")]
            pos, size = pos[ok], size[ok]
            w = sums.at(pos, size)
            ok = self.whole[np.minimum(np.searchsorted(self.whole, w), len(self.whole) - 1)] == w
            at.append(pos[ok])
            long.append(size[ok])
        return (np.concatenate(at), np.concatenate(long)) if at else (np.zeros(0, np.int64),) * 2


_HELD: dict[tuple, _Index] = {}


def _index(uri: str, number: int, passes: int) -> _Index:
    """The index of one pass, read from the shared folder once per worker."""
    from pyarrow import dataset, fs

    key = (uri, number, passes)
    if key not in _HELD:
        _HELD.clear()
        store, base = fs.FileSystem.from_uri(uri)
        own = []
        for b in dataset.dataset(base, filesystem=store, format="parquet").to_batches():
            t = b.to_pandas()
            own.append(t[t["whole"].to_numpy().view(np.uint64) % np.uint64(passes) == number])
        _HELD[key] = _Index(pd.concat(own) if own else pd.DataFrame({c: np.zeros(0, np.int64) for c in ("n_head", "head", "size", "whole")}))
    return _HELD[key]


def _found(index: _Index, texts: list[str]) -> dict[tuple[int, str], int]:
    """How often a passage that may be a phrase stands in each pair of texts, by pair."""
    out: dict[tuple[int, str], int] = {}
    text, ends = "".join(texts), np.cumsum([len(t) for t in texts])
    cp = _points(text)
    for lo in range(0, len(cp), WINDOW):
        part = cp[lo : lo + WINDOW + index.longest]
        pos, size = index.places(part, np.append(ends[(ends > lo) & (ends < lo + len(part))] - lo, [len(part)]), WINDOW)
        row = np.searchsorted(ends, pos + lo, side="right") // 2
        for r, p, n in zip(row.tolist(), (pos + lo).tolist(), size.tolist(), strict=True):
            key = (r, text[p : p + n])
            out[key] = out.get(key, 0) + 1
    return out


def passages(notes: DataFrame, phrases: DataFrame, title: Column, body: Column) -> DataFrame:
    """(note_id, q, tf, doc_len): how often each phrase ``q`` stands in a note, overlaps included. ``phrases`` holds each once."""
    hashes = written(phrases.select("q").mapInPandas(_hashed, "n_head int, head bigint, size int, whole bigint"), "phrase-hashes")
    uri, passes = arrow_uri(place(hashes)), max(1, -(-hashes.count() // PER_PASS))
    view = notes.select("note_id", title.alias("title"), body.alias("body"))

    def scan(number: int):
        def run(batches):
            index = _index(uri, number, passes)
            for b in batches:
                at = 0
                while at < b.num_rows:
                    texts: list[str] = []
                    first, held = at, 0
                    while at < b.num_rows and held < WINDOW:
                        texts += [b.column(1)[at].as_py(), b.column(2)[at].as_py()]
                        held += len(texts[-1]) + len(texts[-2])
                        at += 1
                    found = _found(index, texts) if index.heads else {}
                    rows, q = [r for r, _ in found], [q for _, q in found]
                    size = [max(len(texts[2 * r]) - 2, 0) + max(len(texts[2 * r + 1]) - 2, 0) for r in rows]
                    ids = b.column(0).take(pa.array([first + r for r in rows], pa.int64()))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(q, pa.string()), pa.array(list(found.values()), pa.int64()), pa.array(size, pa.int64())], ["note_id", "q", "tf", "doc_len"])

        return run

    out = None
    for number in range(passes):
        part = view.mapInArrow(scan(number), "note_id string, q string, tf bigint, doc_len bigint")
        out = part if out is None else out.unionByName(part)
    return out.join(phrases.select("q"), "q", "left_semi")
