"""Sampled SentencePiece segmentations without replacement, and their decoding.

A text's segmentations are the paths of a lattice of vocabulary pieces; pieces
never cross a word start, so the lattice is a chain of word lattices, each built
once for every distinct word that a worker keeps during a partition. A path's probability is the product of
its pieces' probabilities (Zipf's law over the vocabulary's ranks, single bytes
for characters without a piece). Every set of paths has one perturbed value, the
maximum over its paths of log probability plus Gumbel noise. The search starts
from all paths and takes the set with the largest value: a path drawn from it
is the next sample, and the set splits into what leaves that path at each step,
whose values are Gumbels cut off at the parent's. So samples come out distinct
and in falling order; the exact mass of a set (the backward sums of the
lattice) is the bound of the A-star search. The inclusion score of a sample is the
probability to exceed the first value that was not taken.

Draws depend on the row's seed, sample and place only, not on the batch.

Defined cases: null and empty texts have one empty segmentation; a text with
fewer than k segmentations gives all it has; whole texts whatever their length;
rows with equal keys and texts get equal samples; a null key is a key of its own.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLES = 2
CHUNK_CHARS = 300_000  # texts worked on together
LATTICE_CHARS = 1_000_000  # characters of the distinct words that a worker keeps in its lattice
MARK = "▁"
BASE = np.uint64(0x9E3779B97F4A7C15)
FULL = (1 << 64) - 1
FIRST_STEPS, FAR_STEPS = 96, 1024  # steps of a path that are looked at first for the sets that leave it, and at a time
MOST_NOISE = 38.0  # above the largest Gumbel noise: -log(-log(1 - 2**-53)) = 36.7
SCHEMA = "key long, sample int, ids array<int>, log_prob double, value double, log_inclusion double"


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def mixed(seeds: np.ndarray, *counters) -> np.ndarray:
    for c in counters:
        if isinstance(c, int):
            seeds = mix(seeds + np.uint64((c + 1) * int(BASE) & FULL))
        else:
            seeds = mix(seeds + c.astype(np.uint64) * BASE + BASE)
    return seeds


def uniform(seeds: np.ndarray, *counters) -> np.ndarray:
    """Numbers in (0, 1) that depend on the arguments only."""
    return ((mixed(seeds, *counters) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def one_mixed(x: int, *counters: int) -> int:
    """``mixed`` of a single seed."""
    for c in counters:
        x = (x + (c + 1) * int(BASE)) & FULL
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & FULL
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & FULL
        x ^= x >> 31
    return x


def one_uniform(seed: int, *counters: int) -> float:
    return ((one_mixed(seed, *counters) >> 11) + 0.5) * 2.0**-53


class Vocabulary:
    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        plain = [
            i for i in range(n)
            if not (self.model.is_byte(i) or self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_unused(i))
        ]
        logs = -np.log(np.arange(len(plain) + 2, dtype=float) + 10.0)
        logs -= np.log(np.exp(logs).sum())
        self.byte_log = float(logs[-1]) - 2.0
        self.byte_id = np.array([self.model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], dtype=np.int32)
        self.chars = [self.model.id_to_piece(i) for i in range(n)]
        # per length the pieces and the beginnings of longer ones (id -1): a look-up ends where nothing goes on
        by_size: dict[int, dict[str, tuple[int, float]]] = {}
        for rank, i in enumerate(plain):
            piece = self.chars[i]
            for size in range(1, len(piece)):
                by_size.setdefault(size, {}).setdefault(piece[:size], (-1, 0.0))
            by_size.setdefault(len(piece), {})[piece] = (i, float(logs[rank]))
        self.tables = {}
        for size, found in sorted(by_size.items()):
            codes = np.frombuffer("".join(found).encode("utf-32-le"), dtype=np.uint32).reshape(-1, size)
            h = np.zeros(len(found), dtype=np.uint64)
            for k in range(size):
                h = (h + codes[:, k]) * BASE
            order = np.argsort(h)
            ids = np.array([i for i, _ in found.values()], dtype=np.int32)[order]
            self.tables[size] = (h[order], ids, np.array([p for _, p in found.values()])[order], Places(h[order]))
        self.lattice = Lattice(self)

    def forget(self) -> None:
        """Gives the memory of the lattice back: workers outlive their tasks, and other stages run beside them."""
        self.lattice = Lattice(self)
        pa.default_memory_pool().release_unused()

    def known(self, words: list[str]) -> tuple[Lattice, np.ndarray]:
        """The lattice with all these words, and the number each has there; it starts anew when it is full."""
        if len(self.lattice.begin) > LATTICE_CHARS:
            self.lattice.clear()
        codes = np.fromiter(map(self.lattice.numbers.__getitem__, words), dtype=np.int32, count=len(words))
        self.lattice.grow()
        return self.lattice, codes


class Places:
    """Where 64-bit keys are in their sorted array: a start by their first bits, then a few steps on."""

    def __init__(self, keys: np.ndarray):
        bits = max(4 * len(keys), 2).bit_length()
        self.shift = np.uint64(64 - bits)
        buckets = (keys >> self.shift).view(np.int64)
        self.steps = int(np.bincount(buckets).max())
        self.start = np.searchsorted(buckets, np.arange(1 << bits)).astype(np.int32)
        self.keys = np.append(keys, np.uint64(FULL))

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, whether the key is there)."""
        k = self.start[(wanted >> self.shift).view(np.int64)]
        for _ in range(self.steps):
            behind = self.keys[k] < wanted
            if not behind.any():
                break
            k += behind
        return k, self.keys[k] == wanted


class Numbers(dict):
    """Numbers words in the order in which they are first asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class Growing:
    """An array with room at its end."""

    def __init__(self, dtype):
        self.room, self.n = np.empty(1024, dtype=dtype), 0

    def __len__(self) -> int:
        return self.n

    def extend(self, values: np.ndarray) -> None:
        end = self.n + len(values)
        if end > len(self.room):
            room = np.empty(max(end, len(self.room) * 3 // 2), dtype=self.room.dtype)
            room[: self.n] = self.room[: self.n]
            self.room = room
        self.room[self.n : end] = values
        self.n = end


NAMES = ("begin", "root", "source", "after", "piece", "share", "low")


class Lattice:
    """The word lattices of distinct words, laid out as one graph that grows by words; edges are sorted by source
    character, then by length. Per edge: its piece, log probability at its source (``share``), the probability of
    the edges before it there (``low``) and the last edge of its target, -1 at the word's end (``after``)."""

    def __init__(self, vocabulary: Vocabulary):
        self.tables, self.byte_log = vocabulary.tables, vocabulary.byte_log
        self._begin, self._root, self._source, self._after, self._piece = (Growing(np.int32) for _ in range(5))
        self._share, self._low = Growing(np.float64), Growing(np.float64)
        self.clear()

    def clear(self) -> None:
        self.numbers = Numbers()
        for name in NAMES:
            getattr(self, f"_{name}").n = 0
        self._show()

    def _show(self) -> None:
        for name in NAMES:
            held = getattr(self, f"_{name}")
            setattr(self, name, held.room[: held.n])

    def grow(self) -> None:
        """Adds the words that were numbered since."""
        words = list(islice(reversed(self.numbers), len(self.numbers) - len(self._root)))[::-1]
        if not words:
            return
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        ends = np.cumsum(sizes)
        left = (np.repeat(ends, sizes) - np.arange(len(code))).astype(np.int32)  # characters from here to the word's end
        sources, spans, pieces, logs, slots = [], [], [], [], []
        single = np.zeros(len(code), dtype=bool)
        degree = np.zeros(len(code), dtype=np.int32)  # edges that start here so far
        at, hashes = np.arange(len(code), dtype=np.int32), np.zeros(len(code), dtype=np.uint64)
        for size, (_, ids, p, places) in self.tables.items():  # 1, 2, ... without a gap
            if size > 1:
                longer = left[at] >= size
                at, hashes = at[longer], hashes[longer]
            if not len(at):
                break
            hashes += code[at + (size - 1)]
            hashes *= BASE
            k, hit = places.find(hashes)
            at, hashes, k = at[hit], hashes[hit], k[hit]
            piece = ids[k]
            whole = piece >= 0
            start = at[whole]
            if size == 1:
                single[start] = True
            slots.append(degree[start])
            degree[start] += 1
            sources.append(start), spans.append(np.full(len(start), size, dtype=np.int32))
            pieces.append(piece[whole]), logs.append(p[k[whole]])
        alone = np.flatnonzero(~single).astype(np.int32)  # characters spelt in bytes
        c = code[alone]
        n_bytes = 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000)
        sources.append(alone), spans.append(np.ones(len(alone), dtype=np.int32))
        pieces.append(-1 - c.astype(np.int32)), logs.append(n_bytes * self.byte_log)
        slots.append(degree[alone])
        degree[alone] += 1
        begin = np.cumsum(degree) - degree
        place = np.concatenate(slots)  # by source, then in the order of their lengths
        place += begin[np.concatenate(sources)]
        piece, span, log = (np.empty(len(place), dtype=x[0].dtype) for x in (pieces, spans, logs))
        piece[place], span[place], log[place] = map(np.concatenate, (pieces, spans, logs))
        source = np.repeat(np.arange(len(code), dtype=np.int32), degree)
        # backward sums, from the word ends to the starts; one more node per word, its end
        node = np.arange(len(code), dtype=np.int32) + np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        mass = np.zeros(len(code) + len(words))
        distance = left[source]
        own = node[source]
        target = own + span
        short = distance.astype(np.uint16) if distance.max() < 1 << 16 else distance
        by_distance = np.argsort(short, kind="stable")
        cuts = np.searchsorted(short[by_distance], np.arange(1, int(sizes.max()) + 2).astype(short.dtype))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if a == b:
                continue
            e = by_distance[a:b]
            from_ = own[e]
            first = np.flatnonzero(np.append(True, from_[1:] != from_[:-1]))
            mass[from_[first]] = np.logaddexp.reduceat(log[e] + mass[target[e]], first)
        share = log + mass[target] - mass[own]
        p = np.exp(share)
        low = np.zeros(len(p))
        several = begin
        for slot in range(1, int(degree.max())):
            several = begin[degree > slot] + slot
            low[several] = low[several - 1] + p[several - 1]
        edges, chars = len(self._share), len(self._begin)
        last = (begin + degree + (edges - 1)).astype(np.int32)
        goes_on = span < distance
        after = np.full(len(p), -1, dtype=np.int32)
        after[goes_on] = last[(source + span)[goes_on]]
        self._root.extend(last[ends - sizes])
        self._begin.extend(begin + edges)
        self._source.extend(source + np.int32(chars))
        self._after.extend(after), self._piece.extend(piece), self._share.extend(share), self._low.extend(low)
        self._show()

    def walk(self, at: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(edges in item order, how many each item has): a path drawn from the node with the last edge ``at`` to its
        word's end, without a step where that is -1."""
        sizes, active = np.zeros(len(at), dtype=np.int64), np.flatnonzero(at >= 0)
        at, seeds = at[active], seeds[active]
        taken = []
        while len(active):
            u = uniform(seeds, len(taken))
            edge = at.astype(np.int64)
            before = np.flatnonzero(u < self.low[edge])
            while len(before):
                edge[before] -= 1
                before = before[u[before] < self.low[edge[before]]]
            taken.append((active, edge))
            at = self.after[edge]
            on = at >= 0
            sizes[active[~on]] = len(taken)
            active, at, seeds = active[on], at[on], seeds[on]
        edges = np.empty(int(sizes.sum()), dtype=np.int32)
        starts = np.cumsum(sizes) - sizes
        for step, (items, edge) in enumerate(taken):
            edges[starts[items] + step] = edge
        return edges, sizes


def cut_off(log_mass: np.ndarray, bound: float, u: np.ndarray) -> np.ndarray:
    """Gumbel values of sets with these log masses, given that they stay below the bound."""
    with np.errstate(divide="ignore", over="ignore"):
        return log_mass - np.log(np.exp(log_mass - bound) - np.log(u))


class Search:
    """Samples of one text, best first. A set is (value, path, step, edges it must not take there)."""

    def __init__(self, lattice: Lattice, seed: int, begin: int, end: int, k: int):
        self.lattice, self.seed, self.begin, self.end, self.k = lattice, seed, begin, end, k  # words from begin to end
        self.paths: list[tuple[np.ndarray, np.ndarray, float]] = []  # edges, where each word's edges end, value
        self.heap: list[tuple] = []

    def add(self, edges: np.ndarray, ends: np.ndarray, value: float, since: int, banned: tuple[int, ...]) -> None:
        """A path drawn from a set: splits the rest of the set at every step from ``since`` on."""
        number = len(self.paths)
        self.paths.append((edges, ends, value))
        if len(edges) <= since:
            return
        state = np.uint64(one_mixed(self.seed, number, 1 << 40))
        reached = np.cumsum(self.lattice.share[edges[:since]])[-1] if since else 0.0
        found: list[tuple[float, int]] = []  # the best sets, more are never taken
        at, size = since, FIRST_STEPS
        while at < len(edges):
            # a set that leaves the path here or later holds at most the mass reached: few can still be among the best
            bar = found[self.k][0] if len(found) > self.k else -np.inf
            if reached + MOST_NOISE < bar:
                break
            share = self.lattice.share[edges[at : at + size]]
            sums = share.copy()
            sums[0] += reached
            before = np.cumsum(sums, out=sums) - share
            u = np.minimum(uniform(state, np.arange(at - since, at - since + len(share))), 1 - 2.0**-53)
            least = 0.0 if bar == -np.inf else math.exp(-math.exp(min(reached - bar + 0.01, 7.0)))
            some = np.flatnonzero(u >= least)
            taken = np.exp(share[some])
            if banned and at == since and len(some) and some[0] == 0:
                taken[0] += np.exp(self.lattice.share[list(banned)]).sum()
            with np.errstate(divide="ignore"):
                rest = before[some] + np.log1p(-np.minimum(taken, 1.0))
            rest[taken > 1 - 1e-12] = -np.inf
            values = cut_off(rest, value, u[some])
            best = np.argpartition(-values, self.k)[: self.k + 1] if len(values) > self.k else np.arange(len(values))
            found += zip(values[best].tolist(), (some[best] + at).tolist())
            found = sorted(found, reverse=True)[: self.k + 1]
            reached, at, size = sums[-1], at + size, FAR_STEPS
        for v, s in found:
            if v > -np.inf:
                own = (*banned, int(edges[since])) if s == since else (int(edges[s]),)
                heapq.heappush(self.heap, (-v, number, s, own))

    def branch(self):
        """Takes the best set: (value, path's edges, path's word ends, word, first edge, step, banned)."""
        value, number, step, banned = heapq.heappop(self.heap)
        edges, ends, _ = self.paths[number]
        source, begin = int(self.lattice.source[edges[step]]), self.lattice.begin
        a, b = int(begin[source]), int(begin[source + 1]) if source + 1 < len(begin) else len(self.lattice.share)
        free = np.array([e for e in range(a, b) if e not in banned])
        p = np.exp(self.lattice.share[free])
        u = one_uniform(self.seed, step, number, len(banned), 1 << 41)
        at = np.searchsorted(np.cumsum(p), u * p.sum(), side="right")
        edge = int(free[min(at, len(free) - 1)])
        return -value, edges, ends, int(np.searchsorted(ends, step, side="right")), edge, step, banned


def split_words(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct words, each with the marks before it, the words of normalised texts as their numbers, how many each has)."""
    odd = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
    if any(" " in t for t in texts):
        found = pa.array([odd.findall(t) for t in texts], pa.list_(pa.string()))
    else:
        spaced = [" ".join(odd.findall(t)) if MARK + MARK in t else t.replace(MARK, f" {MARK}") for t in texts]
        found = pc.split_pattern(pa.array([t[t[0] == " " :] if t else None for t in spaced], pa.string()), " ")
    words = found.flatten().dictionary_encode()
    kinds = words.dictionary.to_numpy(zero_copy_only=False).tolist()
    return kinds, words.indices.to_numpy(), found.value_lengths().fill_null(0).to_numpy().astype(np.int64)


def segment(vocabulary: Vocabulary, texts: list[str], seeds: np.ndarray, k: int) -> list[list[tuple]]:
    """Per text its samples (edges' ids, log probability, perturbed value, log inclusion score)."""
    words, codes, sizes = split_words([vocabulary.model.normalize(t) if t else "" for t in texts])
    ends = np.cumsum(sizes)
    starts = ends - sizes
    lattice, numbers = vocabulary.known(words)
    roots = lattice.root[numbers][codes]
    place = np.arange(len(codes)) - np.repeat(starts, sizes)
    own = mixed(np.repeat(seeds, sizes), place)
    edge, sizes = lattice.walk(roots, mixed(own, 0))
    stop = np.append(0, np.cumsum(sizes))
    searches = []
    for seed, a, b in zip(seeds.tolist(), starts.tolist(), ends.tolist(), strict=True):
        s = Search(lattice, seed, a, b, k)
        top = -math.log(-math.log(one_uniform(seed, 0, 0, 0, 1 << 42)))
        s.add(edge[stop[a] : stop[b]], stop[a + 1 : b + 1] - stop[a], top, 0, ())
        searches.append(s)
    for sample in range(1, k):
        taken = [(s, *s.branch()) for s in searches if len(s.paths) == sample and s.heap]
        if not taken:
            break
        nodes, seed = [], []
        for s, _, _, _, word, first, _, _ in taken:
            nodes.append(roots[s.begin + word : s.end].copy())
            nodes[-1][0] = lattice.after[first]
            seed.append(own[s.begin + word : s.end])
        edge, sizes = lattice.walk(np.concatenate(nodes), mixed(np.concatenate(seed), sample))
        stop = np.append(0, np.cumsum(sizes))
        b = 0
        for s, value, edges, word_ends, word, first, step, banned in taken:
            a, b = b, b + s.end - s.begin - word
            path = np.concatenate([edges[:step], [first], edge[stop[a] : stop[b]]], dtype=np.int32)
            s.add(path, np.append(word_ends[:word], stop[a + 1 : b + 1] + (step + 1 - stop[a])), value, step, banned)
    return finished(vocabulary, lattice, searches)


def spelt(vocabulary: Vocabulary, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids with the bytes of characters that have no piece (negative entries) in their places, how many each has)."""
    sizes = np.ones(len(piece), dtype=np.int64)
    odd = np.flatnonzero(piece < 0)
    if not len(odd):
        return piece, sizes
    kinds, which = np.unique(piece[odd], return_inverse=True)
    coded = [vocabulary.byte_id[list(chr(-1 - p).encode("utf-8", "replace"))] for p in kinds.tolist()]
    sizes[odd] = np.array([len(c) for c in coded])[which]
    table = np.array([np.resize(c, 4) for c in coded])
    ids = np.repeat(piece, sizes)
    starts = (np.cumsum(sizes) - sizes)[odd]
    for k in range(4):
        some = sizes[odd] > k
        ids[starts[some] + k] = table[which[some], k]
    return ids, sizes


def finished(vocabulary: Vocabulary, lattice: Lattice, searches: list[Search]) -> list[list[tuple]]:
    paths = [edges for s in searches for edges, _, _ in s.paths]
    edges = np.concatenate(paths) if paths else np.zeros(0, dtype=np.int32)
    ids, sizes = spelt(vocabulary, lattice.piece[edges])
    share = lattice.share[edges]
    at, stop, begin, out = iter(paths), np.append(0, np.cumsum(sizes)), 0, []
    for s in searches:
        bar = -s.heap[0][0] if s.heap else -np.inf  # the first value that was not taken
        samples = []
        for _, _, value in s.paths:
            end = begin + len(next(at))
            log_prob = float(share[begin:end].sum())
            gap = log_prob - bar
            score = 0.0 if bar == -np.inf else gap if gap < -30 else float(np.log(-np.expm1(-np.exp(min(gap, 700.0)))))
            samples.append((ids[stop[begin] : stop[end]], log_prob, float(value), score))
            begin = end
        out.append(samples)
    return out


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def sampled(rows: DataFrame, path: str, key: str = "doc_id", text: str = "text", k: int = SAMPLES, seed: int = 0) -> DataFrame:
    """(key, sample, ids, log_prob, value, log_inclusion): up to k distinct segmentations per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)

        def out(keys, texts, seeds) -> pa.RecordBatch:
            found = segment(v, texts, np.array(seeds, dtype=np.int64).view(np.uint64), k)
            flat = [(key, i, *x) for key, samples in zip(keys, found, strict=True) for i, x in enumerate(samples)]
            sizes = np.cumsum([0, *[len(x[2]) for x in flat]]).astype(np.int32)
            ids = np.concatenate([x[2] for x in flat]) if flat else np.array([], dtype=np.int32)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([x[0] for x in flat], pa.int64()),
                    pa.array([x[1] for x in flat], pa.int32()),
                    pa.ListArray.from_arrays(pa.array(sizes), pa.array(ids, pa.int32())),
                    *[pa.array([x[c] for x in flat], pa.float64()) for c in (3, 4, 5)],
                ],
                names=["key", "sample", "ids", "log_prob", "value", "log_inclusion"],
            )

        try:
            for batch in batches:
                held: tuple[list, list, list] = ([], [], [])
                chars = 0
                for one in zip(*[batch.column(c) for c in range(3)], strict=True):
                    row = [x.as_py() for x in one]
                    row[1] = row[1] or ""
                    for h, x in zip(held, row, strict=True):
                        h.append(x)
                    chars += len(row[1])
                    if chars > CHUNK_CHARS:
                        yield out(*held)
                        held, chars = ([], [], []), 0
                if held[0]:
                    yield out(*held)
        finally:
            batch = None  # the last one, which would be held until the worker's next task
            v.forget()

    given = rows.select(
        F.col(key).cast("long").alias("key"), F.col(text).alias("text"), F.xxhash64(F.lit(seed), F.col(key)).alias("seed")
    )
    return given.mapInArrow(run, SCHEMA)


def decoded(path: str, ids: Column) -> Column:
    """The text of token ids."""

    def decode(column: pd.Series) -> pd.Series:
        model = vocabulary(path).model
        return pd.Series([None if x is None else model.decode([int(i) for i in x]) for x in column], dtype=object)

    return F.pandas_udf(decode, "string")(ids)
