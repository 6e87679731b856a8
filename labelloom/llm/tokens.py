"""Token counts of a byte-level BPE with word ends, by rank-synchronous merging.

The pre-tokens of a batch lie end to end in one numpy array. In every step each
of them looks up the ranks of its adjacent pairs and merges its lowest-ranked
pair everywhere it occurs, all pre-tokens at once; those without a pair leave
the array. What is left of a pre-token are its tokens. Each distinct pre-token
of a batch is merged once; counts of earlier ones are kept in a bounded memo.

Defined cases: null and empty texts have no tokens; the strings of added special
tokens count as one token each, as in the tokenizer's default; texts are worked
on whole, a few at a time, so memory follows the longest text, not the batch.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from labelloom.llm.texts import numbered

CHUNK_CHARS = 2_000_000  # texts merged together
MEMO = 300_000  # pre-tokens whose counts are remembered
NO_RANK = np.iinfo(np.int64).max


def byte_symbols() -> list[str]:
    """The character that stands for each byte: printable Latin-1 as itself, the others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return [chr(b) if b in set(shown) else chr(256 + hidden.index(b)) for b in range(256)]


def known_classes(pattern: str) -> str:
    """The pattern with Unicode white space, and without letters and digits this Python does not know yet."""
    recent = [
        c
        for c in regex.findall("[\\p{L}\\p{N}]", "".join(map(chr, range(0x80, 0xD800))))
        if unicodedata.category(c) == "Cn"
    ]
    for kind in ("\\p{L}", "\\p{N}") if recent else ():
        pattern = pattern.replace(kind, f"[{kind}--[{''.join(recent)}]]")
    return pattern.replace("\\s", "\\p{White_Space}")


class Merger:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, end = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        self.size = len(vocab)
        signs = byte_symbols()
        self.inner = np.array([vocab[c] for c in signs], dtype=np.int64)
        self.last = np.array([vocab[c + end] for c in signs], dtype=np.int64)
        pairs = [p.split(" ") if isinstance(p, str) else p for p in spec["model"]["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order, made[order]
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(known_classes(split["pattern"]["Regex"]), regex.V1)
        added = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, added))) if added else None
        self.memo: dict[str, int] = {}

    def normal(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # no final-sigma rule
        return text.lower()

    def pre_tokens(self, text: str) -> tuple[list[str], int]:
        """The pre-tokens, and how many special tokens stand between them."""
        if self.special is None or not self.special.search(text):
            return self.pattern.findall(self.normal(text)), 0
        parts = self.special.split(text)
        return [w for p in parts for w in self.pattern.findall(self.normal(p))], len(parts) - 1

    def merged_sizes(self, pieces: list[str]) -> np.ndarray:
        """How many symbols survive in each (non-empty) pre-token."""
        raw = [p.encode("utf-8", "replace") for p in pieces]
        sizes = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        flat = np.frombuffer(b"".join(raw), dtype=np.uint8)
        ends = np.cumsum(sizes)
        sym = self.inner[flat]
        sym[ends - 1] = self.last[flat[ends - 1]]
        owner = np.repeat(np.arange(len(raw)), sizes)
        left = np.ones(len(raw), dtype=np.int64)
        keep = sizes[owner] > 1
        sym, owner = sym[keep], owner[keep]
        while len(sym):
            key = sym[:-1] * self.size + sym[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.where((self.keys[at] == key) & (owner[:-1] == owner[1:]), self.ranks[at], NO_RANK)
            rank, at = np.append(rank, NO_RANK), np.append(at, 0)
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            spans = np.diff(np.append(starts, len(owner)))
            lowest = np.minimum.reduceat(rank, starts)
            done = lowest == NO_RANK
            left[owner[starts[done]]] = spans[done]
            hit = np.flatnonzero((rank == np.repeat(lowest, spans)) & (rank != NO_RANK))
            # a pair of equal symbols may overlap itself: every other one of a run counts
            run = np.maximum.accumulate(np.where(np.diff(hit, prepend=-2) != 1, np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - run) % 2 == 0]
            sym[hit] = self.made[at[hit]]
            alive = np.repeat(~done, spans)
            alive[hit + 1] = False
            sym, owner = sym[alive], owner[alive]
        return left

    def counts(self, texts: list[str]) -> np.ndarray:
        found = [self.pre_tokens(t) for t in texts]
        sizes = np.array([len(w) for w, _ in found], dtype=np.int64)
        total = np.array([s for _, s in found], dtype=np.int64)
        if not sizes.sum():
            return total
        codes, kinds = numbered(w for ws, _ in found for w in ws)
        fresh = [k for k in kinds if k not in self.memo]
        if len(self.memo) + len(fresh) > MEMO:
            self.memo.clear()
            fresh = kinds
        if fresh:
            self.memo.update(zip(fresh, self.merged_sizes(fresh).tolist(), strict=True))
        per_kind = np.array([self.memo[k] for k in kinds], dtype=np.int64)
        owner = np.repeat(np.arange(len(texts)), sizes)
        return total + np.bincount(owner, weights=per_kind[codes], minlength=len(texts)).astype(np.int64)


@lru_cache(maxsize=2)
def merger(path: str) -> Merger:
    return Merger(path)


def token_counts(path: str):
    """A function of a text column: its number of tokens under the tokenizer file at ``path``."""

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        m, out, chunk, chars = merger(path), [], [], 0
        for t in texts.fillna(""):
            chunk.append(t)
            chars += len(t)
            if chars > CHUNK_CHARS:
                out.append(m.counts(chunk))
                chunk, chars = [], 0
        if chunk:
            out.append(m.counts(chunk))
        return pd.Series(np.concatenate(out) if out else np.array([], dtype=np.int64))

    return count


def with_tokens(df, path: str, text: str = "text", name: str = "n_tokens"):
    """``df`` with the column ``name`` added; one of that name is replaced."""
    counted: Column = token_counts(path)(F.col(text))
    return df.withColumn(name, counted)
