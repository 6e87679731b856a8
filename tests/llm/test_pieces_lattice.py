"""The lattice that a worker keeps, and the sets of far steps that are not looked at."""

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from labelloom.llm import pieces

SP = public_tokenizers.path("piece_bpe_32k.model")
RNG = np.random.default_rng(3)
TEXTS = [
    " ".join(RNG.choice(["the", "there", "in", "counting", "ab漢cd", "𝕏", "▁▁x", "a▁", "Straße", "zz" * 9], size=n).tolist())
    for n in (1, 2, 60, 3_000)
] + ["", "x", "▁", "▁▁", "no end▁", "\x00 \x01", "漢字" * 400]
SEEDS = pieces.mix(np.arange(len(TEXTS), dtype=np.uint64))


def plain(found):
    return [[(x[0].tolist(), *x[1:]) for x in samples] for samples in found]


@pytest.fixture(scope="module")
def whole():
    """Every step of every path looked at."""
    with pytest.MonkeyPatch.context() as m:
        m.setattr(pieces, "FIRST_STEPS", 10**9)
        return plain(pieces.segment(pieces.Vocabulary(SP), TEXTS, SEEDS, 3))


def test_words_are_built_once():
    v = pieces.Vocabulary(SP)
    first = plain(pieces.segment(v, TEXTS, SEEDS, 3))
    edges = len(v.lattice.share)
    assert edges and plain(pieces.segment(v, TEXTS[::-1], SEEDS[::-1], 3)) == first[::-1] and len(v.lattice.share) == edges


@pytest.mark.parametrize(("first", "far"), [(1, 1), (1, 7), (96, 1024)])
def test_far_steps_lose_nothing(whole, monkeypatch, first, far):
    monkeypatch.setattr(pieces, "FIRST_STEPS", first)
    monkeypatch.setattr(pieces, "FAR_STEPS", far)
    assert plain(pieces.segment(pieces.Vocabulary(SP), TEXTS, SEEDS, 3)) == whole


def test_full_lattice_starts_anew(whole, monkeypatch):
    monkeypatch.setattr(pieces, "LATTICE_CHARS", 5)
    v = pieces.Vocabulary(SP)
    alone = [plain(pieces.segment(v, [t], SEEDS[i : i + 1], 3))[0] for i, t in enumerate(TEXTS)]
    assert [[x[0] for x in s] for s in alone] == [[x[0] for x in s] for s in whole]
    assert all(a[1:] == pytest.approx(b[1:]) for s, t in zip(alone, whole) for a, b in zip(s, t))


class Caught:
    """Takes the place of a frame: gives what would run in a worker."""

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        return run


@pytest.mark.parametrize("whole_partition", [True, False])
def test_a_worker_keeps_no_words_between_partitions(spark, whole_partition):
    run, v = pieces.sampled(Caught(), SP), pieces.vocabulary(SP)
    columns = [pa.array(range(len(TEXTS)), pa.int64()), pa.array(TEXTS, pa.string()), pa.array(SEEDS.view(np.int64))]
    batch = pa.RecordBatch.from_arrays(columns, names=["key", "text", "seed"])
    found = run(iter([batch, batch]))
    first = next(found)
    assert first.num_rows and len(v.lattice.numbers)
    if whole_partition:
        assert [b.num_rows for b in found] == [first.num_rows]
    else:
        found.close()  # a reader that needs no more rows
    assert len(v.lattice.numbers) == len(v.lattice.share) == 0
    assert sum(getattr(v.lattice, f"_{name}").room.nbytes for name in pieces.NAMES) < 100_000
    assert list(run(iter([]))) == [] and next(run(iter([batch]))).equals(first)


def test_single_and_many_seeds_agree():
    some = SEEDS[:4]
    many = pieces.uniform(some, 5, np.int64(7) + np.zeros(4, dtype=np.int64), 1 << 41)
    assert many.tolist() == [pieces.one_uniform(int(s), 5, 7, 1 << 41) for s in some]
