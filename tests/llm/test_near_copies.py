"""Near copies at the values of the pipeline's stage, and other shingle lengths."""

import random
import re
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from labelloom.llm import jaccard  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, percent, shingle):
    sets, up = {}, {}
    for i, t in rows:
        w = WORD.findall((t or "").lower())
        sets[i] = {tuple(w[k : k + shingle]) for k in range(len(w) - shingle + 1)} or ({tuple(w)} if w else set())
        up[i] = i

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            inter = len(sets[a] & sets[b])
            if inter and 100 * inter >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def copies(seed):
    """Texts with copies that have single words changed or a passage added, around the threshold."""
    rng = random.Random(seed)
    rows = []
    for _ in range(10):
        source = [rng.choice("abcdefghij") + str(rng.randrange(500)) for _ in range(rng.randrange(3, 300))]
        for k in range(rng.randrange(2, 8)):
            copy = list(source)
            if k % 2:
                copy += [f"n{rng.randrange(10**6)}" for _ in range(len(copy) * rng.randrange(15, 30) // 100)]
            else:
                for _ in range(len(copy) * rng.randrange(0, 5) // 100):
                    copy[rng.randrange(len(copy))] = f"n{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(copy)))
    return rows + [(len(rows) + 1, None), (len(rows) + 2, "One two three four"), (len(rows) + 3, "one two  THREE four")]


@pytest.mark.parametrize("percent,shingle", [(80, 5), (70, 3), (60, 1)])
def test_jaccard_equals_brute_force_at_other_values(spark, percent, shingle):
    rows = copies(7)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc"]: (r["n"], r["component"]) for r in jaccard.linked(docs, percent=percent, shingle=shingle).collect()}
    assert got == brute(rows, percent, shingle)


def test_stage_drops_near_copies_of_five_words_and_eighty_percent(spark):
    words = [f"w{i}" for i in range(1000)]
    edited = list(words)
    for i in range(21):
        edited[20 + 45 * i] = f"e{i}"
    added = words + [f"n{i}" for i in range(200)]
    other = [f"o{i}" for i in range(1000)]
    far = other + [f"f{i}" for i in range(260)]  # below 0.8
    texts = [words, edited, added, other, far]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.one_of_each(spark, docs, "")
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 3, 4]


def test_second_contraction_starts_from_one_link_a_text(spark, monkeypatch):
    given, stars, checked = [], [], []
    contract, verify = jaccard.components, jaccard.verified

    def counted(links, a, b):
        given.append(links.count())
        label = contract(links, a, b)
        stars.append(label.count())
        return label

    def noted(pairs, sets, percent):
        checked.append(verify(pairs, sets, percent))
        return checked[-1]

    monkeypatch.setattr(jaccard, "components", counted)
    monkeypatch.setattr(jaccard, "verified", noted)
    words = [f"w{i}" for i in range(600)]
    rows = [(k, " ".join(words[10 * k : 10 * k + 300])) for k in range(20)]  # a chain: each text links with the next few
    found = jaccard.linked(spark.createDataFrame(rows, "doc_id long, text string"), percent=80, shingle=5).collect()
    assert {r["component"] for r in found} == {0} and len(found) == len(rows)
    assert given[0] > stars[0] == given[1] - checked[1].count()
