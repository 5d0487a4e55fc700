"""Encoding of whole texts with a public byte-level BPE vocabulary.

A text is cut by the tokenizer's pattern; each piece is encoded by a backtracking encoder: an
Aho-Corasick automaton gives the longest vocabulary entry at every position, and two neighbours
may stand side by side only if BPE would not have merged across their border, which the table of
merges decides (pair compatibility). A position that leads nowhere is marked and never tried
again, so the time is linear in the piece for a bounded longest entry. Decoding looks tokens up in one byte
string through an offset table.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Fixed value: the pattern that cuts texts for this family of vocabularies.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces remembered per worker before its memory is emptied; a matter of speed only.
REMEMBERED = 400_000
#: Longer pieces are encoded anew each time.
REMEMBER_UP_TO = 64


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class BacktrackingBpe:
    """Exact BPE over bytes for a rank file: one line per token, base64 and rank."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, "rb") as f:
            rows = [line.split() for line in f if line.strip()]
        ranks = {base64.b64decode(a): int(b) for a, b in rows}
        self.ids = {t.decode("latin-1"): r for t, r in ranks.items()}
        size = max(ranks.values()) + 1
        self.texts: list[str] = [""] * size
        for t, r in self.ids.items():
            self.texts[r] = t
        self.lens = [len(t) for t in self.texts]
        self.auto = ahocorasick.Automaton()
        for t, r in self.ids.items():
            self.auto.add_word(t, r)
        # the longest shorter entry that starts a token
        self.shorter = [-1] * size
        for t, r in self.ids.items():
            for n in range(len(t) - 1, 0, -1):
                if (s := self.ids.get(t[:n])) is not None:
                    self.shorter[r] = s
                    break
        self.auto.make_automaton()
        self.left = list(range(size))
        self.right = list(range(size))
        self.merged: dict[tuple[int, int], int] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        for r in range(size):
            t = self.texts[r]
            if len(t) < 2:
                continue
            a = self.shorter[r]
            while a >= 0:
                b = self.ids.get(t[self.lens[a] :])
                if b is not None and a < r and b < r and self._compatible(a, b):
                    self.left[r], self.right[r] = a, b
                    self.merged[(a, b)] = r
                    break
                a = self.shorter[a]
        self.fits.clear()
        self.cut = regex.compile(PIECES).findall
        self.known: dict[str, tuple[int, ...]] = {}
        # offset table for decoding
        self.blob = "".join(self.texts).encode("latin-1")
        self.offsets = np.concatenate([[0], np.cumsum(self.lens)])

    def _compatible(self, a: int, b: int) -> bool:
        """Whether BPE leaves a border between a and b: undo merges on both sides, latest first, and
        look for a merge over the border that would have come earlier."""
        limit = 1 << 62
        while True:
            over = self.merged.get((a, b))
            if over is not None and over < limit:
                return False
            if a > b:
                limit, a = a, self.right[a]
                if a == limit:
                    limit, b = b + 1, self.left[b]
                    if b + 1 == limit:
                        return True
            else:
                limit, b = b + 1, self.left[b]
                if b + 1 == limit:
                    limit, a = a, self.right[a]
                    if a == limit:
                        return True

    def compatible(self, a: int, b: int) -> bool:
        ok = self.fits.get((a, b))
        if ok is None:
            if len(self.fits) > 4 * REMEMBERED:
                self.fits.clear()
            ok = self.fits[(a, b)] = self._compatible(a, b)
        return ok

    def piece(self, text: str) -> tuple[int, ...]:
        """Ids of one piece."""
        s = text.encode("utf-8", "replace").decode("latin-1")
        whole = self.ids.get(s)
        if whole is not None:
            return (whole,)
        n = len(s)
        longest = [-1] * n
        lens, shorter = self.lens, self.shorter
        for end, r in self.auto.iter(s):
            start = end - lens[r] + 1
            if longest[start] < 0 or lens[r] > lens[longest[start]]:
                longest[start] = r
        open_ = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        at = 0
        token = longest[0] if n else -1
        while token >= 0:
            last = out[-1] if out else -1
            while True:
                end = at + lens[token]
                if open_[end] and (last < 0 or self.compatible(last, token)):
                    out.append(token)
                    at = end
                    token = longest[at] if at < n else -1
                    break
                if shorter[token] >= 0:
                    token = shorter[token]
                    continue
                open_[at] = 0
                out.pop()
                at -= lens[last]
                token = last
                # the token that led here is tried in its shorter forms, its end being closed now
                break
        return tuple(out)

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text, special strings being ordinary text; None and "" give []."""
        if not text:
            return []
        out: list[int] = []
        known = self.known
        for p in self.cut(text):
            ids = known.get(p)
            if ids is None:
                ids = self.piece(p)
                if len(p) <= REMEMBER_UP_TO:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[p] = ids
            out += ids
        return out

    def decode(self, ids: Iterable[int]) -> str:
        o, blob = self.offsets, self.blob
        return b"".join(blob[o[i] : o[i + 1]] for i in ids).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> BacktrackingBpe:
    return BacktrackingBpe(path)


def encode_texts(df: DataFrame, id_col: str, text_col: str, vocabulary: str = "byte_bpe_50k.tiktoken", ids_col: str = "ids") -> DataFrame:
    """(id_col, ids_col) with the token ids of every text, without special tokens.

    A null text and an empty text both give the empty list; blank and very long texts are encoded
    whole; equal rows all come out; an empty table gives none; other columns are pruned. vocabulary
    is the name of a rank file of the public tokenizers package, or a path.
    """
    path = vocabulary if "/" in vocabulary else None
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField(ids_col, T.ArrayType(T.IntegerType(), False), False)])
    item = pa.field("element", pa.int32(), nullable=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path or vocabulary_path(vocabulary))
        for batch in batches:
            start, rows = 0, batch.num_rows
            texts = batch.column(1)
            while start < rows:
                flat: list[int] = []
                offsets = [0]
                end = start
                while end < rows and len(flat) < 2_000_000:
                    flat += enc.encode(texts[end].as_py())
                    offsets.append(len(flat))
                    end += 1
                ids = pa.ListArray.from_arrays(pa.array(np.asarray(offsets, dtype=np.int32)), pa.array(np.asarray(flat, dtype=np.int32)), type=pa.list_(item))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, end - start), ids], names=[id_col, ids_col])
                start = end

    return df.select(id_col, text_col).mapInArrow(run, schema)
