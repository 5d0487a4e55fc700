"""Test passages that leak into a corpus, fully, partly or slightly altered.

Method: containment search with MinHash sketches, partitioned by size. Every passage is cut into
windows of each length from the shortest stretch that counts to just below twice that, since any longer leak holds one of
these; a window is a short test item. Windows are partitioned by their number of words and of distinct shingles, and each
partition gets its own sketch size: the least number of MinHash values (the smallest shingle hashes) of which
at least one surely lies among the shingles that stay intact under the alterations allowed at that length. A
document is a candidate for a passage if its shingle set contains a sketch value (containment is tested
one-sidedly, so a long document costs no recall). Candidates are verified by exact shingle containment: some window must have as
many shingles in the document as its partition says stay intact. What passes is aligned word by word: the
shared shingles are extended into the longest common stretch, within the allowed alterations.

Shingles here have four words, not five: in twelve words with one altered and one interruption only
a run of four is sure to stay whole. So few stay whole at worst that the sketches hold nearly all shingles of a passage.
"""

from __future__ import annotations

import functools
import math
import re
import sys
import unicodedata
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

SHINGLE = 4
#: Successive words of a passage that make a leak.
STRETCH = 12
#: One word in so many may be changed, added or dropped.
ONE_IN = 8
#: Longest notice, in words, that may interrupt a stretch once.
NOTICE = 24
#: Passages per block; a block is what a worker holds at a time.
BLOCK = 20_000

_WORD = re.compile(r"[^\W_]+")
#: Signs inside words that don't count, and with them every mark that stands on another letter.
_SIGNS = frozenset("\u2019\u2018'`\u00b4\u02bc\u00ad\u2060\ufeff") | {chr(c) for c in range(0x200B, 0x2010)}
_DROP = _SIGNS | {chr(c) for c in range(sys.maxunicode + 1) if unicodedata.combining(chr(c))}
_MULT = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    """Words of a text without case, marks, punctuation and spacing."""
    if not text:
        return []
    if text.isascii():
        return _WORD.findall(text.replace("'", "").replace("`", "").lower())
    text = unicodedata.normalize("NFKD", text)
    for c in _DROP.intersection(text):
        text = text.replace(c, "")
    return _WORD.findall(text.casefold())


def sketch_size(shingles: int, intact: int) -> int:
    """MinHash values needed so that one of them surely is among the intact shingles."""
    return max(1, shingles - max(1, intact) + 1)


@functools.lru_cache(maxsize=64)
def least_intact(length: int = STRETCH) -> int:
    """Shingles that stay whole in a window of this length, at worst: the altered words and the one
    interruption cut it into runs, and the worst cut makes them equal."""
    edits = length // ONE_IN
    runs = edits + 2
    left = length - edits
    q, r = divmod(left, runs)
    return sum(max(0, n - SHINGLE + 1) for n in [q + 1] * r + [q] * (runs - r))


def _mix(ids: np.ndarray) -> np.ndarray:
    """Hashes of all shingles that start at each position but the last ones."""
    n = len(ids) - SHINGLE + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    h = np.zeros(n, dtype=np.uint64)
    for k in range(SHINGLE):
        h = (h ^ ids[k : k + n].astype(np.uint64)) * _MULT
        h ^= h >> np.uint64(29)
    return h


class PassageIndex:
    """Sketches of a block of passages, and what is needed to verify candidates."""

    def __init__(self, passages: Iterable[tuple[int, str | None]]):
        self.vocab: dict[str, int] = {}
        self.items: list[tuple[int, np.ndarray]] = []
        found: dict[int, list[tuple[int, int, bool]]] = defaultdict(list)
        self.partitions: dict[tuple[int, int], int] = {}
        for item, text in passages:
            w = words(text)
            if len(w) < STRETCH:
                continue
            ids = np.array([self.vocab.setdefault(x, len(self.vocab) + 1) for x in w], dtype=np.int64)
            h = _mix(ids)
            wanted: set[int] = set()
            every = len(set(h.tolist()))
            for n in range(STRETCH, min(len(w), 2 * STRETCH - 1) + 1):
                if len(wanted) == every:
                    break
                intact = least_intact(n)
                for at in range(len(w) - n + 1):
                    part = np.unique(h[at : at + n - SHINGLE + 1])
                    k = self.partitions.setdefault((n, len(part)), sketch_size(len(part), intact - (n - SHINGLE + 1 - len(part))))
                    wanted |= set(part[:k].tolist())
            for j, x in enumerate(h.tolist()):
                found[x].append((len(self.items), j, x in wanted))
            self.items.append((item, ids))
        self.shingles = np.array(sorted(found), dtype=np.uint64)
        self.found = dict(found)

    def hits(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """(position, shingle) for the passages' shingles among those of ids."""
        h = _mix(ids)
        if not len(self.shingles) or not len(h):
            return []
        at = np.searchsorted(self.shingles, h)
        at[at == len(self.shingles)] = 0
        pos = np.flatnonzero(self.shingles[at] == h)
        return list(zip(pos.tolist(), h[pos].tolist(), strict=True))

    def search(self, ids: list[int]) -> list[int]:
        """Item ids whose passages the document with these word ids gives away."""
        by_item: dict[int, list[tuple[int, int]]] = defaultdict(list)
        candidates: set[int] = set()
        for i, h in self.hits(np.array(ids, dtype=np.int64)):
            for item, j, sketched in self.found[h]:
                by_item[item].append((i, j))
                if sketched:
                    candidates.add(item)
        return [self.items[k][0] for k in candidates if contained({j for _, j in by_item[k]}) and leaks(ids, self.items[k][1].tolist(), by_item[k])]


def contained(places: set[int]) -> bool:
    """Whether some window of the passage has as many shingles in the document, which start at these places, as a
    leak of its length leaves intact."""
    p = sorted(places)
    for n in range(STRETCH, 2 * STRETCH):
        m = least_intact(n)
        if any(b - a <= n - SHINGLE for a, b in zip(p, p[m - 1 :], strict=False)):
            return True
    return False


def _reach(d: list[int], p: list[int], i: int, j: int, step: int) -> dict[tuple[int, int], int]:
    """Passage words gained from (i, j) in one direction, by (edits, notices) spent."""
    nd, np_ = len(d), len(p)

    def slide(i: int, j: int) -> tuple[int, int]:
        while 0 <= i < nd and 0 <= j < np_ and d[i] == p[j] and d[i]:
            i += step
            j += step
        return i, j

    start = j
    out: dict[tuple[int, int], int] = {}
    most = STRETCH * 2 // ONE_IN
    # places to go on from, with the words that must still match behind a notice
    states: dict[tuple[int, int], set[tuple[int, int, int]]] = {(0, 0): {(i, j, 0)}}
    for e in range(most):
        for n in (0, 1):
            for a, b, need in states.get((e, n), ()):
                y, z = slide(a, b)
                left = max(0, need - abs(z - b))
                # a stretch ends on a matching word, never on an alteration
                if not left and (z != b or (e, n) == (0, 0)):
                    out[(e, n)] = max(out.get((e, n), 0), abs(z - start))
                if not 0 <= z < np_:
                    continue
                if n == 0:
                    # behind the notice some word must match within the edits that are left
                    near = {p[z + step * v] for v in range(most - e) if 0 <= z + step * v < np_} - {0}
                    to = states.setdefault((e, 1), set())
                    for k in range(1, NOTICE + 1):
                        x = y + step * k
                        if not 0 <= x < nd:
                            break
                        if any(0 <= x + step * u < nd and d[x + step * u] in near for u in range(most - e)):
                            to.add((x, z, 2))
                if e + 1 < most:
                    states.setdefault((e + 1, n), set()).update(((y + step, z + step, left), (y + step, z, left), (y, z + step, left)))
    return out


def leaks(d: list[int], p: list[int], seeds: list[tuple[int, int]]) -> bool:
    """Whether d repeats at least STRETCH successive words of p.

    seeds are places (in d, in p) where a shingle is shared. A longer stretch that is within the
    allowed alterations has a part of STRETCH to 2*STRETCH-1 words that is, so no more than the
    edits of such a part need be tried.
    """
    done: set[tuple[int, int]] = set()
    runs: dict[tuple[int, int], int] = {}
    for i, j in seeds:
        runs[i, j] = runs.get((i - 1, j - 1), 0) + 1
        if runs[i, j] > STRETCH - SHINGLE:  # word for word
            return True
    for i, j in seeds:
        if (i - 1, j - 1) in done:
            done.add((i, j))
            continue
        done.add((i, j))
        right = _reach(d, p, i, j, 1)
        left = _reach(d, p, i - 1, j - 1, -1)
        for (e, n), r in right.items():
            for (f, m), s in left.items():
                if n + m <= 1 and r + s >= STRETCH and (e + f) * ONE_IN <= r + s:
                    return True
    return False


def leaked_items(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", passage: str = "passage") -> DataFrame:
    """(doc_id, item_id): documents that repeat at least 12 successive words of an item's passage.

    Case, marks, punctuation and spacing don't count; one word in eight of the stretch may be
    altered and one notice may interrupt it. Null, blank and shorter texts and passages give no
    row; each pair comes once even if a document repeats an item twice; equal documents under
    different ids all come out; whole texts are searched; other columns are pruned. Items are
    taken in blocks of BLOCK, so their number is free; documents are read once per block and never
    shuffled.
    """
    spark = docs.sparkSession
    kinds = T.StructType([T.StructField(doc_id, docs.schema[doc_id].dataType), T.StructField(item_id, items.schema[item_id].dataType)])
    result = None
    block: list[tuple[int, str | None]] = []

    def search(rows: list[tuple[int, str | None]]) -> DataFrame:
        held = spark.sparkContext.broadcast(rows)
        names = [doc_id, item_id]
        item_type = to_arrow_type(items.schema[item_id].dataType)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = _index(held)
            get = index.vocab.get
            for batch in batches:
                at: list[int] = []
                out: list[int] = []
                for k, t in enumerate(batch.column(1)):
                    w = words(t.as_py())
                    if len(w) < STRETCH - STRETCH // ONE_IN:
                        continue
                    got = set(index.search([get(x, 0) for x in w]))
                    at += [k] * len(got)
                    out += sorted(got)
                if at:
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(out, type=item_type)], names=names)

        return docs.select(doc_id, text).mapInArrow(run, kinds)

    for r in items.select(item_id, passage).where(items[passage].isNotNull()).toLocalIterator():
        block.append((r[0], r[1]))
        if len(block) == BLOCK:
            result = search(block) if result is None else result.unionByName(search(block))
            block = []
    if block or result is None:
        result = search(block) if result is None else result.unionByName(search(block))
    # two rows of items may share an id
    return result if items.select(item_id).distinct().count() == items.count() else result.distinct()


@functools.lru_cache(maxsize=2)
def _built(key: int, held) -> PassageIndex:
    return PassageIndex(held.value)


def _index(held) -> PassageIndex:
    return _built(held._jbroadcast_id if hasattr(held, "_jbroadcast_id") else id(held), held)


def brute_leaks(d: list[str], p: list[str]) -> bool:
    """Plain check for tests: tries every stretch of the passage against every place, by edit distance,
    with and without one cut-out of the document."""

    def within(a: list[str], b: list[str], most: int) -> bool:
        if abs(len(a) - len(b)) > most:
            return False
        row = list(range(len(b) + 1))
        for x in a:
            new = [row[0] + 1]
            for k, y in enumerate(b):
                new.append(min(row[k] + (x != y), row[k + 1] + 1, new[-1] + 1))
            row = new
        return row[-1] <= most

    for n in range(STRETCH, min(len(p), 2 * STRETCH - 1) + 1):
        most = n // ONE_IN
        for j in range(len(p) - n + 1):
            part = p[j : j + n]
            for i in range(len(d)):
                for m in range(n - most, n + most + 1):
                    if i + m <= len(d) and within(part, d[i : i + m], most):
                        return True
    return False


def expected_candidates(shingles: int, sketch: int, intact: int) -> float:
    """Chance that a sketch of this size holds none of the intact shingles."""
    if sketch > shingles - intact:
        return 0.0
    return math.comb(shingles - intact, sketch) / math.comb(shingles, sketch)
