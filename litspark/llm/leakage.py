"""Held-out passages inside a corpus: size-partitioned MinHash containment search, then exact checks.

Passages are cut into overlapping blocks; a block's sketch is the bottom-k MinHash of its five-word shingles, k being all
of a block's shingles unless stated otherwise, so that no shingle of a passage is overlooked.  Texts are partitioned by
size: the longer a text is, the more shingles it holds by chance, so the hits that make a candidate rise with the size
class, but never beyond the whole shingles that a true run keeps at the least (``fewest_hits``), so that no true run is
too short for a long text.  Candidates are verified by exact shingle containment around the hit and by an alignment of
the words (all candidates of a batch at once, in numpy), which must hold ``min_words`` running words of the passage with at most one edit in ``per_edit`` words.

Scale: the passages are a stated query set.  They are sent to the tasks in groups of at most ``group_items`` passages
and ``group_words`` words (a bound on what is broadcast), one pass over the corpus per group, so a larger query set
means more passes, not larger broadcasts.  A text is searched whole, in the Arrow batch it lies in: no shuffle.

Defined results: null and empty texts and passages match nothing; texts of any length are searched whole; passages shorter than ``min_words`` match nothing;
repeated texts and passages each count; results are per document and passage, once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from litspark.llm.textnorm import clean

SHINGLE = 5
_PIECE = re.compile(r"[^\W_]+")
_MIX = np.array([1, 1000003, 998244353, 777767777, 4294967291], dtype=np.uint64)


def shingle_hashes(ids: np.ndarray) -> np.ndarray:
    """64-bit hashes of the runs of five word ids."""
    n = len(ids) - SHINGLE + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    x = ids.astype(np.uint64) + np.uint64(1)
    h = np.zeros(n, dtype=np.uint64)
    for i in range(SHINGLE):
        h = (h ^ (x[i : i + n] * _MIX[i])) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


class Passages:
    """One group of passages, indexed: vocabulary, sketch hashes and where in which passage they stand."""

    def __init__(self, items: list[tuple[int, str]], block: int = 20, stride: int = 8, k: int = 16) -> None:
        self.items = items
        self.vocab: dict[str, int] = {}
        self.tokens: list[np.ndarray] = []
        self.word_of: list[np.ndarray] = []  # the passage's own (blank-separated) word of each token
        self.shingles: list[dict[int, list[int]]] = []
        entries: list[tuple[int, int, int]] = []
        for n, (_, passage) in enumerate(items):
            ids, own = [], []
            for w, word in enumerate(clean(passage or "").split()):
                for piece in _PIECE.findall(word):
                    ids.append(self.vocab.setdefault(piece, len(self.vocab)))
                    own.append(w)
            arr = np.array(ids, dtype=np.int64)
            self.tokens.append(arr)
            self.word_of.append(np.array(own, dtype=np.int64))
            hashes = shingle_hashes(arr)
            places: dict[int, list[int]] = {}
            for p, h in enumerate(hashes.tolist()):
                places.setdefault(h, []).append(p)
            self.shingles.append(places)
            sketch: set[int] = set()
            for start in range(0, max(1, len(hashes) - (block - SHINGLE + 1) + stride), stride):
                sketch.update(np.sort(hashes[start : start + block - SHINGLE + 1])[:k].tolist())
            entries += [(h, n, p) for h in sketch for p in places[h]]
        entries.sort()
        self.hash = np.array([e[0] for e in entries], dtype=np.uint64)
        self.item = np.array([e[1] for e in entries], dtype=np.int64)
        self.place = np.array([e[2] for e in entries], dtype=np.int64)
        self.unknown = len(self.vocab)


def size_class(n: int) -> int:
    """0 for texts up to 256 words, then one class per doubling."""
    return max(0, (max(n, 1) - 1).bit_length() - 8)


def fewest_hits(min_words: int, per_edit: int) -> int:
    """Whole shingles that a run of at least ``min_words`` words keeps when its edits are spread for the worst."""
    kept = lambda n: n - n // per_edit - (SHINGLE - 1) * (n // per_edit + 1)
    return max(1, min(kept(n) for n in range(min_words, min_words + per_edit * SHINGLE + 1)))


def _aligned(p: np.ndarray, d: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray]:
    """Banded edit alignments of many passages with stretches of text, one per row, all at once.

    p: tokens of the passages, padded with -1; d: text tokens from ``band`` before to ``band`` behind each passage, padded
    with -2.  Returns per passage token whether it is matched, and how many text tokens are inserted before it.
    """
    m, n = p.shape
    width, big = 2 * band + 1, np.int32(1 << 20)
    lengths = (p >= 0).sum(axis=1)
    along = np.arange(width, dtype=np.int32)
    prev = np.zeros((m, width), dtype=np.int32)  # text tokens before the passage are free
    last = np.where((lengths == 0)[:, None], prev, big)
    steps = np.zeros((n, m, width), dtype=np.int8)
    for i in range(n):
        # diagonal c of row i uses text token i + c
        straight = prev + (p[:, i : i + 1] != d[:, i : i + width])
        dropped = np.concatenate([prev[:, 1:] + 1, np.full((m, 1), big, dtype=np.int32)], axis=1)
        best = np.minimum(straight, dropped)
        row = np.minimum.accumulate(best - along, axis=1) + along
        steps[i] = np.where(row < best, 3, np.where(straight <= dropped, 1, 2))
        prev = row
        last[lengths == i + 1] = row[lengths == i + 1]
    matched, inserted = np.zeros((m, n), dtype=bool), np.zeros((m, n + 1), dtype=np.int32)
    at, c, who = lengths.copy(), last.argmin(axis=1), np.flatnonzero(lengths > 0)
    while len(who):
        i, k = at[who], c[who]
        how = steps[i - 1, who, k]
        matched[who, i - 1] |= (how == 1) & (p[who, i - 1] == d[who, i - 1 + k])
        inserted[who, i] += how == 3
        c[who] = k + (how == 2) - (how == 3)
        at[who] = i - (how != 3)
        who = who[at[who] > 0]
    return matched, inserted


def longest_run(edits: np.ndarray, per_edit: int) -> int:
    """Words of the longest run of the passage with at most one edit in ``per_edit`` words; edits: per word."""
    # prefix value f = words - per_edit * edits; a run from a to b is good where f(b) >= f(a)
    f, best = 0.0, 0
    lowest: list[tuple[float, int]] = [(0.0, 0)]  # strictly falling prefix minima: (value, place)
    for b, e in enumerate(edits.tolist(), 1):
        f += 1 - per_edit * e
        if f < lowest[-1][0]:
            lowest.append((f, b))
        lo, hi = 0, len(lowest) - 1
        while lo < hi:
            mid = (lo + hi) // 2
            if lowest[mid][0] <= f:
                hi = mid
            else:
                lo = mid + 1
        if lowest[lo][0] <= f:
            best = max(best, b - lowest[lo][1])
    return best


def verify(flat: np.ndarray, bounds: np.ndarray, cases: list[tuple[int, int, int]], px: Passages, min_words: int, per_edit: int, band: int = 16, cells: int = 8_000_000) -> list[int]:
    """Words of the longest good run of each case (0 if below ``min_words``).

    cases: (text, passage, diagonal: place in ``flat`` minus place in the passage).  Cases of similar length are aligned
    together, in blocks of at most ``cells`` cells (or one case).
    """
    order = sorted(range(len(cases)), key=lambda x: len(px.tokens[cases[x][1]]))
    out, at = [0] * len(cases), 0
    while at < len(order):
        end = at + 1
        while end < len(order) and (end + 1 - at) * len(px.tokens[cases[order[end]][1]]) * (2 * band + 1) <= cells:
            end += 1
        block, at = order[at:end], end
        n = len(px.tokens[cases[block[-1]][1]])
        p = np.full((len(block), n), -1, dtype=np.int64)
        where = np.array([cases[x][2] - band for x in block])[:, None] + np.arange(n + 2 * band)
        low, high = (np.array([bounds[cases[x][0] + y] for x in block])[:, None] for y in (0, 1))
        d = np.where((where >= low) & (where < high), flat[np.clip(where, 0, len(flat) - 1)], -2)
        for r, x in enumerate(block):
            p[r, : len(px.tokens[cases[x][1]])] = px.tokens[cases[x][1]]
        matched, inserted = _aligned(p, d, band)
        for r, x in enumerate(block):
            word_of = px.word_of[cases[x][1]]
            k = len(word_of)
            # edits per word of the passage; a word is wrong if any of its pieces is
            wrong = np.bincount(word_of, weights=~matched[r, :k]) > 0
            edits = wrong + np.bincount(word_of, weights=inserted[r, :k])
            # a run of min_words or more is good if f rises or stays from its begin to its end
            f = np.concatenate([[0], np.cumsum(1 - per_edit * edits)])
            if len(f) > min_words and (f[min_words:] >= np.minimum.accumulate(f)[:-min_words]).any():
                out[x] = longest_run(edits, per_edit)
    return out


def search_batch(keys: list[int], texts: list[str], px: Passages, min_words: int, per_edit: int, base_hits: int, need: float) -> list[tuple[int, int, int]]:
    """(key, item id, words of the longest run) of the passages found in each text."""
    vocab, unknown = px.vocab, px.unknown
    parts, bounds = [], [0]
    for t in texts:
        ids = [vocab.get(w, unknown) for w in _PIECE.findall(clean(t))]
        parts.append(np.array(ids + [unknown] * SHINGLE, dtype=np.int64))
        bounds.append(bounds[-1] + len(parts[-1]))
    if not parts or not len(px.hash):
        return []
    flat = np.concatenate(parts)
    known = flat != unknown
    run = known.copy()
    for i in range(1, SHINGLE):
        run[: len(run) - i] &= known[i:]
    run[len(run) - SHINGLE + 1 :] = False
    pos = np.flatnonzero(run)
    hashes = np.zeros(len(pos), dtype=np.uint64)
    x = flat.astype(np.uint64) + np.uint64(1)
    for i in range(SHINGLE):
        hashes = (hashes ^ (x[pos + i] * _MIX[i])) * np.uint64(0x9E3779B97F4A7C15)
        hashes ^= hashes >> np.uint64(29)
    left = np.searchsorted(px.hash, hashes, "left")
    count = np.searchsorted(px.hash, hashes, "right") - left
    hit = count > 0
    pos, left, count = pos[hit], left[hit], count[hit]
    if not len(pos):
        return []
    dpos = np.repeat(pos, count)
    entry = np.repeat(left, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    doc = np.searchsorted(np.array(bounds), dpos, "right") - 1
    item, diag = px.item[entry], dpos - px.place[entry]
    # hits of one passage along one stretch of diagonal (copies with edits drift a little): cells of 16, each also seen half a cell later
    classes = np.array([size_class(bounds[i + 1] - bounds[i]) for i in range(len(texts))])
    least = np.minimum(base_hits + classes, fewest_hits(min_words, per_edit))
    tried: dict[tuple[int, int, int], None] = {}
    for half in (0, 8):
        cell = (diag + half) >> 4
        order = np.lexsort((diag, cell, item, doc))
        k = np.stack([doc[order], item[order], cell[order]])
        starts = np.flatnonzero(np.concatenate([[True], (k[:, 1:] != k[:, :-1]).any(axis=0)]))
        ends = np.append(starts[1:], k.shape[1])
        enough = ends - starts >= least[k[0, starts]]
        for s, e in zip(starts[enough].tolist(), ends[enough].tolist(), strict=True):
            # exact shingle containment: the share of the passage's shingles between the first and the last hit
            span = np.sort(px.place[entry[order[s:e]]])
            if (e - s) / max(int(span[-1] - span[0]) + 1, min_words - SHINGLE) < need:
                dense = int((np.searchsorted(span, span + min_words, "right") - np.arange(len(span))).max())
                if dense / (min_words - SHINGLE) < need:
                    continue
            along = diag[order[s:e]]  # sorted
            change = np.flatnonzero(np.concatenate([[True], along[1:] != along[:-1]]))
            at = int(along[change[np.diff(np.append(change, len(along))).argmax()]])
            tried.setdefault((int(k[0, s]), int(k[1, s]), at))
    # the same alignment, found from both cells, is made once
    cases = list({(dc, it, at >> 2): (dc, it, at) for dc, it, at in tried}.values())
    found: dict[tuple[int, int], int] = {}
    for (dc, it, _), got in zip(cases, verify(flat, np.array(bounds), cases, px, min_words, per_edit), strict=True):
        if got:
            found[dc, it] = max(found.get((dc, it), 0), got)
    return [(keys[dc], px.items[it][0], n) for (dc, it), n in found.items()]


def contained_passages(
    docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, passage: str, min_words: int = 30, per_edit: int = 8,
    base_hits: int = 6, need: float = 0.2, group_items: int = 2_000, group_words: int = 400_000,
) -> DataFrame:
    """doc_id, item_id, run_words for every document with at least ``min_words`` running words of the passage.

    items are the query set: held-out passages, far fewer than documents, read to the driver in groups.
    """
    groups: list[list[tuple[int, str]]] = [[]]
    used = 0
    for row in items.selectExpr(f"`{item_key}` as k", f"`{passage}` as p").where("p is not null").orderBy("k", "p").toLocalIterator():
        n = len(row.p.split())
        if groups[-1] and (len(groups[-1]) >= group_items or used + n > group_words):
            groups.append([])
            used = 0
        groups[-1].append((row.k, row.p))
        used += n
    narrow = docs.selectExpr(f"`{key}` as k", f"`{text}` as t").where("t is not null and k is not null")
    schema = "doc_id long, item_id long, run_words int"
    out: DataFrame | None = None
    for group in groups:

        def run(batches: Iterator[pd.DataFrame], group: list[tuple[int, str]] = group) -> Iterator[pd.DataFrame]:
            px = Passages(group)
            for b in batches:
                keys, texts = b["k"].tolist(), b["t"].tolist()
                for i in range(0, len(keys), 2000):
                    rows = search_batch(keys[i : i + 2000], texts[i : i + 2000], px, min_words, per_edit, base_hits, need)
                    yield pd.DataFrame(rows, columns=["doc_id", "item_id", "run_words"])

        part = narrow.mapInPandas(run, schema)
        out = part if out is None else out.unionByName(part)
    return out.groupBy("doc_id", "item_id").agg({"run_words": "max"}).withColumnRenamed("max(run_words)", "run_words")

