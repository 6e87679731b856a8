"""Byte-level BPE against the tokenizer library and a plain merge loop."""

import random
from hashlib import sha256

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from labelloom.llm import bytepairs, queries

tiktoken = pytest.importorskip("tiktoken")
public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bytepairs.read_ranks(PATH), special_tokens={}
    )


def ids_of(texts):
    ids, sizes = bytepairs.coder(PATH).encode(texts)
    out, at = [], 0
    for n in sizes:
        out.append(ids[at : at + n].tolist())
        at += n
    return out


def test_pattern_is_the_files_own():
    assert bytepairs.SPLIT == public_tokenizers.PATTERN


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=80), max_size=8))
def test_any_text(library, texts):
    assert ids_of(texts) == [library.encode_ordinary(t) for t in texts]
    assert bytepairs.coder(PATH).decode(*bytepairs.coder(PATH).encode(texts)) == [t.encode() for t in texts]


def leftmost(word, ranks):
    parts = [bytes([b]) for b in word]
    while True:
        options = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not options:
            return [ranks[p] for p in parts]
        i = min(options)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_both_recursions_contract_leftmost_first():
    coder, rng = bytepairs.coder(PATH), random.Random(4)
    short = [bytes(rng.choice(b"theraing") for _ in range(rng.randrange(2, bytepairs.LONG))) for _ in range(150)]
    long = [bytes(rng.choice(b) for _ in range(n)) for b in (b"a", b"-=", b"there", b"\xe3\x81\x82") for n in (49, 50, 120, 301)]
    for words in (short, long, short + long):
        ids, sizes = coder.merged(words)
        want = [leftmost(w, coder.ranks) for w in words]
        assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_code_points(library):
    """One of each class change: every code point of the first planes next to letters, digits and signs."""
    texts = [f"a{chr(c)}b 1{chr(c)}2 {chr(c)}!" for c in range(0x3000) if not 0xD800 <= c < 0xE000]
    assert ids_of(texts) == [library.encode_ordinary(t) for t in texts]


def test_memo_may_overflow(library, monkeypatch):
    monkeypatch.setattr(bytepairs, "MEMO", 5)
    monkeypatch.setattr(bytepairs, "WORDS", 2)
    coder = bytepairs.Coder(PATH)
    for texts in (["one two three"], ["four five six seven eight"], ["one four"]):
        assert coder.encode(texts)[0].tolist() == [i for t in texts for i in library.encode_ordinary(t)]


def test_query_and_odd_rows(spark, odd_docs, library, tmp_path):
    odd_docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, queries.op11_byte_level_bpe(spark, str(tmp_path)).collect()), key=str)
    want = []
    for r in odd_docs.collect():
        ids = library.encode_ordinary(r.text or "")
        digest = sha256(" ".join(map(str, ids)).encode()).hexdigest()
        want.append((r.doc_id, len(ids), digest, sha256((r.text or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_columns_lists_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (2, None, None)], "id int, text string, ids string")
    out = bytepairs.decoded(bytepairs.encoded(df, PATH), PATH)
    assert out.columns == ["id", "text", "ids", "decoded"]
    assert [(r.ids, bytes(r.decoded)) for r in out.orderBy("id").collect()] == [([64, 275], b"a b"), ([], b"")]
    lists = spark.createDataFrame([(1, [64, None, 275]), (2, None), (3, [])], "id int, ids array<int>")
    assert [bytes(r.decoded) for r in bytepairs.decoded(lists, PATH).orderBy("id").collect()] == [b"a b", b"", b""]
    assert bytepairs.encoded(df.limit(0), PATH).collect() == []


def test_unknown_id_raises():
    import numpy as np

    with pytest.raises(ValueError):
        bytepairs.coder(PATH).decode(np.array([50_300], dtype=np.int32), np.array([1]))


def test_longest_short_words_and_equal_runs(library):
    """Places up to the last one before ``LONG``, in many words of one query."""
    coder = bytepairs.Coder(PATH)
    words = [b"a" * n for n in range(2, bytepairs.LONG + 1)] + [b"-=" * (bytepairs.LONG // 2), b"qzxj" * (bytepairs.LONG // 4)]
    ids, sizes = coder.merged(words)
    want = [leftmost(w, coder.ranks) for w in words]
    assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_each_distinct_word_is_looked_up_once():
    """Words are numbered before they are looked up, so repeats in a chunk cost no look-up."""

    class Counted(dict):
        asked = 0

        def __getitem__(self, word):
            self.asked += 1
            return super().__getitem__(word)

    coder = bytepairs.Coder(PATH)
    coder.memo = Counted()
    ids, sizes = coder.encode(["the cat the cat the cat", "", " cat the" * 50, "the\0 cat"])
    assert coder.memo.asked == len(coder.memo) == 4 and sizes.sum() == len(ids)
    assert coder.decode(ids, sizes) == [b"the cat the cat the cat", b"", b" cat the" * 50, b"the\0 cat"]
