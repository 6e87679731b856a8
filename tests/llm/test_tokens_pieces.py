"""Token counts and sampled segmentations."""

import itertools
import math

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from labelloom.llm import pieces, tokens

BPE = public_tokenizers.path("word_bpe_49k.json")
SP = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    "", "   ", "aaaaaaa bbbb", "ΣΑΣ İstanbul", "é a<|endoftext|>b<|startoftext|><|endoftext|>", "it's WE'LL 12345 ½",
    "漢字かな 𝕏 👩‍👩‍👧", "x\u0085y​z\x1cq w", "zz" * 700, "\x00\x01", "ﬁ ß Å", "The quick brown fox. " * 50,
]


def test_counts_equal_library():
    library = Tokenizer.from_file(BPE)
    want = [len(x.ids) for x in library.encode_batch(TEXTS, add_special_tokens=False)]
    assert tokens.Merger(BPE).counts(TEXTS).tolist() == want


def test_counts_odd_rows(odd_docs):
    rows = tokens.with_tokens(odd_docs, BPE).collect()
    library = Tokenizer.from_file(BPE)
    assert all(r["n_tokens"] == len(library.encode(r["text"] or "", add_special_tokens=False).ids) for r in rows)
    assert tokens.with_tokens(odd_docs.limit(0), BPE).count() == 0
    with pytest.raises(ValueError):
        tokens.with_tokens(odd_docs, BPE, name="n")


def segmentations(v, word):
    plain = {v.chars[i] for t in v.tables.values() for i in t[1].tolist()}
    for cuts in itertools.product([0, 1], repeat=len(word) - 1):
        parts, last = [], 0
        for i, c in enumerate([*cuts, 1], 1):
            if c:
                parts.append(word[last:i])
                last = i
        if all(p in plain for p in parts):
            yield tuple(parts)


def test_samples_follow_the_law_without_replacement():
    v = pieces.Vocabulary(SP)
    every = list(segmentations(v, "▁thes"))
    log = {v.chars[i]: p for t in v.tables.values() for i, p in zip(t[1].tolist(), t[2].tolist())}
    p = {s: math.exp(sum(log[x] for x in s)) for s in every}
    total = sum(p.values())
    p = {s: x / total for s, x in p.items()}
    n = 4000
    drawn = pieces.segment(v, ["thes"] * n, pieces.mix(np.arange(n, dtype=np.uint64)), 2)
    names = [[tuple(v.chars[i] for i in x[0]) for x in r] for r in drawn]
    assert all(a != b for a, b in names)
    for s, share in p.items():
        first = sum(r[0] == s for r in names) / n
        second = sum(r[1] == s for r in names) / n
        want = sum(x * share / (1 - x) for o, x in p.items() if o != s)
        assert first == pytest.approx(share, abs=0.04) and second == pytest.approx(want, abs=0.04)
    assert all(r[0][2] >= r[1][2] for r in drawn)
    assert all(x[1] == pytest.approx(math.log(p[s]), abs=1e-6) for r, w in zip(drawn, names) for x, s in zip(r, w))


def test_all_segmentations_come_out_once():
    v = pieces.Vocabulary(SP)
    every = set(segmentations(v, "▁the"))
    got = pieces.segment(v, ["the"], np.array([9], dtype=np.uint64), 50)[0]
    assert {tuple(v.chars[i] for i in x[0]) for x in got} == every and len(got) == len(every)


def test_round_trip_and_batches():
    v = pieces.Vocabulary(SP)
    seeds = np.arange(len(TEXTS), dtype=np.uint64)
    together = pieces.segment(v, TEXTS, seeds, 3)
    for t, s, r in zip(TEXTS, seeds, together):
        assert len({tuple(x[0]) for x in r}) == len(r)
        assert all(v.model.decode(x[0].tolist()) == v.model.decode(v.model.encode(t)) for x in r)
        alone = pieces.segment(v, [t], np.array([s]), 3)[0]
        assert [x[0].tolist() for x in alone] == [x[0].tolist() for x in r]


def test_samples_odd_rows(odd_docs):
    rows = pieces.sampled(odd_docs, SP).collect()
    by = {}
    for r in rows:
        by.setdefault(r["key"], []).append(r)
    assert len(by[1]) == 4 and len(by[2]) == 1 and by[2][0]["ids"] == [] and len(by[None]) == 2
    assert len(by[4][0]["ids"]) > 30_000
    assert pieces.sampled(odd_docs.limit(0), SP).count() == 0
