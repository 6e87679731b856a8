"""Byte-level BPE encoding and decoding by recursive queries inside each partition.

A text is split by the tokenizer's pattern. The words that a task meets for the
first time become token-position rows, one per byte; a recursive query joins
each adjacent pair with the merge table and contracts each word's leftmost pair
of minimum rank until no pair of any word is in the table. Decoding joins the
ids of a text with the vocabulary and aggregates the pieces in their order.

A word of more than ``LONG`` bytes would need as many rounds as it has merges.
There, all places of the minimum rank are contracted in one round (every other
one of a run of equal tokens), unless the new token could be part of a pair of
lower rank, which the merge table states (``early``); then only the leftmost
is. Contracting leftmost first gives the same result: the pairs that arise have
higher ranks, so the other places stay the minimum.

Both directions work on a few texts at a time, so memory follows the longest
text. Defined cases: null and empty texts have no ids, null and empty id lists
decode to no bytes; strings of special tokens are ordinary text; a null in an id
list is skipped, an unknown id raises; repeated rows are rows of their own. An
added column takes the place of one of that name.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

CHUNK_CHARS = 1_000_000  # texts worked on together
CHUNK_IDS = 500_000
WORDS = 40_000  # words of one recursive query
MEMO = 500_000  # words whose ids are remembered
LONG = 48  # less than 64
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""  # the rank files' own pattern

PAIRED = """
    select s.*, rank, early, (rank << 32) | pos as code
    from (select *, lead(token) over (partition by word order by pos) as following from step where not done) s
    left join merges on pair = (token << 20) | following
"""
ONE_BY_ONE = """
with recursive step(place, token, done) as (
    select (word << 6) | pos, token, false from start_rows
    union all (
        with paired as materialized (
            select s.*, place >> 6 as word, rank, (rank << 32) | ((place & 63) << 6) | (next_place & 63) as code
            from (
                select *, lead(token) over in_order as following, lead(place) over in_order as next_place
                from step where not done window in_order as (order by place)
            ) s left join merges on pair = case when next_place >> 6 = place >> 6 then (token << 20) | following end
        ), least as (
            select word, min(code) as least_code from paired group by word
        )
        select place, case when code = least_code then rank else token end, least_code is null
        from paired join least using (word) where least_code is null or place & 63 <> least_code & 63
    )
)
select place >> 6 as word, token from step where done order by place
"""  # the place in a word of at most LONG bytes takes six bits; a code holds the rank, the pair's place and its second token's
ALL_AT_ONCE = f"""
with recursive step(word, pos, token, done) as (
    select word, pos, token, false from start_rows
    union all
    select word, pos, case when taken then rank else token end, least_code is null
    from (
        select *, lag(taken) over (partition by word order by pos) as absorbed from (
            select *, lowest and (not early or code = least_code) and (not repeated or (place - first_place) % 2 = 0) as taken from (
                select *, max(case when lowest and not coalesce(lowest_before, false) then place end)
                    over (partition by word order by pos) as first_place
                from (
                    select *, lag(lowest) over (partition by word order by pos) as lowest_before, token = following as repeated
                    from (
                        select *, coalesce(rank = least_code >> 32, false) as lowest,
                            row_number() over (partition by word order by pos) as place
                        from (select *, min(code) over (partition by word) as least_code from ({PAIRED}))
                    )
                )
            )
        )
    ) where least_code is null or absorbed is distinct from true
)
select word, token from step where done order by word, pos
"""
DECODED = """
select row_no, array_to_string(list(piece order by pos), '') as text
from ids join pieces using (token) group by row_no order by row_no
"""


def split_pattern(pattern: str = SPLIT) -> regex.Pattern:
    """The pattern with white space as Unicode defines it."""
    return regex.compile(pattern.replace("\\s", "\\p{White_Space}").replace("\\S", "[^\\p{White_Space}]"), regex.V1)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def merge_table(ranks: dict[bytes, int]) -> pa.Table:
    """(pair, rank, early): every split of a token into two tokens; ``early`` if the token is itself a part of
    a token of lower rank."""
    early, pairs = set(), []
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            a, b = ranks.get(token[:i]), ranks.get(token[i:])
            if a is not None and b is not None:
                pairs.append(((a << 20) | b, rank))
                early.update(x for x in (a, b) if x > rank)
    return pa.table(
        {
            "pair": pa.array([p for p, _ in pairs], pa.int64()),
            "rank": pa.array([r for _, r in pairs], pa.int64()),
            "early": [r in early for _, r in pairs],
        }
    )


class Coder:
    def __init__(self, path: str):
        self.ranks = read_ranks(path)
        self.words = split_pattern()
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self.db = duckdb.connect(config={"threads": 1, "preserve_insertion_order": True})
        self.db.register("merges_in", merge_table(self.ranks))
        self.db.register(
            "pieces_in",
            pa.table({"token": pa.array(self.ranks.values(), pa.int32()), "piece": [t.decode("latin-1") for t in self.ranks]}),
        )
        self.db.execute("create table merges as from merges_in; create table pieces as from pieces_in")
        self.forget()

    def forget(self) -> None:
        self.memo: dict[str, int] = {}
        self.flat = np.zeros(0, dtype=np.int32)
        self.sizes = np.zeros(0, dtype=np.int64)

    def merged(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words end to end, and how many each has."""
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        owner = np.repeat(np.arange(len(words)), sizes)
        rows = pa.table(
            {
                "word": owner,
                "pos": np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes),
                "token": self.single[np.frombuffer(b"".join(words), dtype=np.uint8)],
            }
        )
        self.db.register("start_rows", rows)
        found = self.db.execute(ALL_AT_ONCE if sizes.max() > LONG else ONE_BY_ONE).fetchnumpy()
        self.db.unregister("start_rows")
        return np.asarray(found["token"], dtype=np.int32), np.bincount(np.asarray(found["word"]), minlength=len(words))

    def learn(self, words: list[str]) -> None:
        """Remember the ids of words that are not known yet."""
        raw = [w.encode() for w in words]
        sizes = np.ones(len(words), dtype=np.int64)
        whole = np.fromiter((self.ranks.get(r, -1) for r in raw), dtype=np.int64, count=len(raw))
        order = np.lexsort((np.fromiter(map(len, raw), dtype=np.int64, count=len(raw)), whole < 0))  # long ones last
        first = int((whole >= 0).sum())
        parts = [whole[order[:first]].astype(np.int32)]
        rest = order[first:]
        lengths = [len(raw[i]) for i in rest]
        cut = int(np.searchsorted(lengths, LONG + 1))
        for begin, end in [(0, cut), (cut, len(rest))]:
            for at in range(begin, end, WORDS):
                batch = rest[at : min(at + WORDS, end)]
                ids, n = self.merged([raw[i] for i in batch])
                parts.append(ids)
                sizes[batch] = n
        at = len(self.sizes)
        self.memo.update((words[i], at + k) for k, i in enumerate(order))
        self.flat = np.concatenate([self.flat, *parts])
        self.sizes = np.concatenate([self.sizes, sizes[order]])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts end to end, and how many each has."""
        found = [self.words.findall(t) for t in texts]
        counts = [0, *map(len, found)]
        words = pa.array(list(chain.from_iterable(found)), pa.string()).dictionary_encode()
        del found
        kinds = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        fresh = [w for w in kinds if w not in self.memo]
        if len(self.memo) + len(fresh) > MEMO:
            self.forget()
            fresh = kinds
        if fresh:
            self.learn(fresh)
        slots = np.fromiter(map(self.memo.__getitem__, kinds), dtype=np.int64, count=len(kinds))[words.indices.to_numpy()]
        starts = np.cumsum(self.sizes) - self.sizes
        n = self.sizes[slots]
        ids = self.flat[np.repeat(starts[slots] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        ends = np.concatenate([[0], np.cumsum(n)])[np.cumsum(counts)]
        return ids, np.diff(ends)

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        self.db.register(
            "ids", pa.table({"row_no": np.repeat(np.arange(len(sizes)), sizes), "pos": np.arange(len(ids)), "token": ids})
        )
        if len(ids) and self.db.execute("select 1 from ids anti join pieces using (token) limit 1").fetchall():
            raise ValueError("an id is not in the vocabulary")
        texts = dict(self.db.execute(DECODED).fetchall())
        self.db.unregister("ids")
        return [texts.get(i, "").encode("latin-1") for i in range(len(sizes))]


@lru_cache(maxsize=2)
def coder(path: str) -> Coder:
    return Coder(path)


def _runs(sizes: Iterable[int], most: int) -> Iterator[tuple[int, int]]:
    """Consecutive rows of at most ``most`` in total, or one row."""
    begin = total = end = 0
    for end, size in enumerate(sizes, 1):
        if total and total + size > most:
            yield begin, end - 1
            begin, total = end - 1, 0
        total += size
    if end > begin:
        yield begin, end


def _with(batch: pa.RecordBatch, name: str, column: pa.Array) -> pa.RecordBatch:
    columns = {c: batch.column(c) for c in batch.schema.names if c != name}
    return pa.RecordBatch.from_pydict({**columns, name: column})


def _schema(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*(f for f in df.schema.fields if f.name != name), T.StructField(name, kind)])


def encoded(df: DataFrame, path: str, text: str = "text", name: str = "ids") -> DataFrame:
    """``df`` with the ids of the text (array of int) under the rank file at ``path``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text)
            for a, b in _runs((len(t.as_py() or "") for t in texts), CHUNK_CHARS):
                ids, sizes = coder(path).encode([t or "" for t in texts.slice(a, b - a).to_pylist()])
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
                yield _with(batch.slice(a, b - a), name, pa.ListArray.from_arrays(offsets, pa.array(ids)))

    return df.mapInArrow(run, _schema(df, name, T.ArrayType(T.IntegerType())))


def decoded(df: DataFrame, path: str, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """``df`` with the bytes (binary) that the ids stand for."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(ids)
            lengths = lists.value_lengths().fill_null(0).to_pylist()
            for a, b in _runs(lengths, CHUNK_IDS):
                part = lists.slice(a, b - a)
                flat, sizes = part.flatten(), np.array(lengths[a:b], dtype=np.int64)
                if flat.null_count:
                    lost = np.concatenate([[0], np.cumsum(flat.is_null().to_numpy(zero_copy_only=False))])
                    ends = np.concatenate([[0], np.cumsum(sizes)])
                    sizes, flat = np.diff(ends - lost[ends]), flat.drop_null()
                texts = coder(path).decode(flat.to_numpy(), sizes)
                yield _with(batch.slice(a, b - a), name, pa.array(texts, pa.binary()))

    return df.mapInArrow(run, _schema(df, name, T.BinaryType()))
