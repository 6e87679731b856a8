"""Quality rules, mixing and the Jaccard join."""

import math
import random
import re
from collections import Counter

import pytest
import xxhash

from labelloom.llm import jaccard, mixing, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def base(text):
    w = WORD.findall(text or "")
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {i + k for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    failed = len(w) < 10 or 100 * len(hit) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit), failed


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def hash_word(w):
    return signed(xxhash.xxh64(w.encode(), seed=42).intdigest())


def hash_pair(a, b):
    first = xxhash.xxh64(a.to_bytes(8, "little", signed=True), seed=42).intdigest()
    return signed(xxhash.xxh64(b.to_bytes(8, "little", signed=True), seed=first).intdigest())


def grams(text):
    h = [hash_word(w) for w in WORD.findall(text or "")]
    return [x % quality.BUCKETS for x in h], [hash_pair(a, b) % quality.BUCKETS for a, b in zip(h, h[1:])]


def test_quality_equals_brute_force(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(60)] + ["é|", "##", "the"]
    texts = ["".join(rng.choice(vocab) + rng.choice([" ", "\n", "\t", "\x0b "]) for _ in range(rng.randrange(0, 80))) for _ in range(80)]
    texts += ["a b c d e " * 4, "same line of words\nsame line of words\n\n \n", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    good = set(range(0, 40, 3))
    labels = spark.createDataFrame([(i, int(i in good), 0) for i in range(0, 60)], "doc_id long, quality int, toxic int")
    raw, target = Counter(), Counter()
    for i, t in enumerate(texts):
        for g in grams(t):
            raw.update(g)
            if i in good:
                target.update(g)
    raws, targets = sum(raw.values()), sum(target.values())
    ratio = {
        b: math.log((target[b] + quality.PRIOR * c / raws) / (targets + quality.PRIOR)) - math.log(c / raws)
        for b, c in raw.items()
    }
    for r in quality.judge(docs, labels).collect():
        text = texts[r["row"]["doc_id"]]
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == base(text)
        parts = grams(text)
        if parts[0]:
            score = sum(sum(ratio[b] for b in g) / len(g) for g in parts if g)
            assert r["score"] == pytest.approx(score, abs=1e-9)
            assert r["kept"] == (not r["base_failed"] and score >= quality.THRESHOLD)
        else:
            assert r["score"] is None and not r["kept"]


def test_quality_odd_rows(odd_docs, few_labels):
    assert quality.judge(odd_docs, few_labels).count() == odd_docs.count()
    kept = quality.keep_good(odd_docs, few_labels)
    assert kept.columns == odd_docs.columns
    assert sorted((r["doc_id"] or 0, r["row"]) for r in kept.collect()) == [(1, "x"), (1, "x"), (4, "z")]
    assert quality.judge(odd_docs, few_labels.limit(0)).filter("kept").count() == 4
    assert quality.judge(odd_docs.limit(0), few_labels).count() == 0


def sets_of(rows):
    out = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        out[i] = frozenset(tuple(w[k : k + 4]) for k in range(len(w) - 3)) if len(w) >= 4 else frozenset([tuple(w)] if w else [])
    return out


def brute_components(sets):
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            inter = len(sets[a] & sets[b])
            if inter and 100 * inter >= 85 * (len(sets[a]) + len(sets[b]) - inter):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for _ in range(12):
        source = [rng.choice("abcdefghij") + str(rng.randrange(500)) for _ in range(rng.randrange(3, 120))]
        if rng.random() < 0.5:
            source += passage
        for _ in range(rng.randrange(1, 9)):
            copy = list(source)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = f"n{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(copy).upper() if rng.random() < 0.2 else " ".join(copy)))
    rows += [(len(rows) + 1, None), (len(rows) + 2, ""), (len(rows) + 3, "One two"), (len(rows) + 4, "one  TWO")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc"]: (r["n"], r["component"]) for r in jaccard.linked(docs).collect()}
    assert got == brute_components(sets_of(rows))


def test_jaccard_odd_rows(odd_docs):
    rows = jaccard.linked(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert all(r["component"] == r["doc"] for r in rows)
    kept = jaccard.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count()
    assert jaccard.linked(odd_docs.limit(0)).count() == 0


def test_mixing_meets_targets(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(600):
        kind = i % 3
        w = [f"w{rng.randrange(300)}" for _ in range(30)] + ([["|"], ["trash"]][kind - 1] * 3 if kind else [])
        rows.append((i, " ".join(w)))
        labels.append((i, int(kind != 1), int(kind == 2)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = mixing.mixed(docs, table, (0.8, 0.15, 0.05)).toPandas()
    mass = [(found["rate"] * found["n_tokens"] * found[f"p_{d}"]).sum() for d in mixing.DOMAINS]
    assert [m / sum(mass) for m in mass] == pytest.approx([0.8, 0.15, 0.05], abs=2e-3)
    ids = [r["doc_id"] for r in found["row"]]
    best = found[[f"p_{d}" for d in mixing.DOMAINS]].to_numpy().argmax(axis=1)
    assert sum(b == i % 3 for i, b in zip(ids, best)) > 0.99 * len(ids)
    assert (found["rate"] >= 0).all()


def test_mixing_odd_rows(odd_docs, few_labels):
    assert mixing.mixed(odd_docs, few_labels).count() == odd_docs.count()
    assert mixing.remixed(odd_docs, few_labels.limit(0)).columns == odd_docs.columns
    assert mixing.mixed(odd_docs.limit(0), few_labels).count() == 0
