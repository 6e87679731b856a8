"""The Merkle manifest against a plain recursive tree."""

import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from labelloom.llm import manifest, queries


def h(s):
    return sha256(s.encode()).hexdigest()


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i : i + 16])) for i in range(0, len(out[-1]), 16)])
    return out


def siblings(levels, i):
    """(left, right) level by level."""
    for nodes in levels[:-1]:
        first = i - i % 16
        yield "".join(nodes[first:i]), "".join(nodes[i + 1 : first + 16])
        i //= 16


def brute(leaves):
    """leaves: (group, key, leaf, changed) -> sorted (key, leaf, subroot, root, proof, folded)."""
    groups = {}
    for row in leaves:
        groups.setdefault("" if row[0] is None else "=" + row[0], []).append(row)
    names = sorted(groups, key=lambda g: g.encode())
    for g in names:
        groups[g].sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
    trees = [levels_of([r[2] for r in groups[g]]) for g in names]
    top = levels_of([t[-1][0] for t in trees])
    out = []
    for k, g in enumerate(names):
        for i, (_, key, leaf, changed) in enumerate(groups[g]):
            path = [*siblings(trees[k], i), *siblings(top, k)]
            node = changed or leaf
            for a, b in path:
                node = h(a + node + b)
            out.append((key, leaf, trees[k][-1][0], top[-1][0], h("".join(a + b for a, b in path)), node))
    return sorted(out, key=str)


def run(spark, leaves):
    df = spark.createDataFrame(leaves, "group string, key long, leaf string, changed string")
    return sorted((tuple(r) for r in manifest.manifest(df).collect()), key=str)


def test_blocks_groups_and_odd_rows(spark):
    rows = [("big", i, h(f"b{i}"), h("x") if i % 7 == 0 else None) for i in range(manifest.BLOCK + 300)]
    rows += [(None, i, h(f"n{i}"), None) for i in range(17)]
    rows += [("one", 5, h("one"), None), ("é", None, h("null key"), h("y")), ("é", 2**60 + 1, h("large key"), None)]
    rows += [("two", 3, h("same"), None), ("two", 3, h("same"), None), ("", 4, h("empty name"), None)]
    rows += [(f"g{i}", i, h(f"g{i}"), None) for i in range(20)]
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("n", [1, 2, 16, 17, 256, 257])
def test_sizes_of_one_group(spark, n):
    rows = [("a", i, h(str(i)), None) for i in range(n)]
    assert run(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_open_tree_extends_witnesses_as_runs_close():
    tree, nodes = manifest.OpenTree(2), [h(str(i)) for i in range(40)]
    kept = [tree.append(n) for n in nodes]
    assert [len(w) for w in kept] == [1] * 32 + [0] * 8  # only runs that are complete have reached their leaves
    root = tree.root()
    assert root == levels_of(nodes)[-1][0]
    assert all(manifest.folded(n, w) == root for n, w in zip(nodes, kept))


def test_leaf_text_and_tampering(spark, tmp_path):
    rows = [(i, t, "en", s, len(t or "")) for i, (t, s) in enumerate([("Ab", "x"), (None, None), ("é\nZ", "x"), ("", ""), ("low", "y")] * 3)]
    rows += [(None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.withColumn("leaf", F.lit("clashing")).write.parquet(f"{tmp_path}/documents.parquet")

    def part(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def leaf(doc_id, text, lang, source, n_chars):
        return h("".join(map(part, (doc_id, source, lang, n_chars, text))))

    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    leaves = []
    for doc_id, text, *rest in rows:
        hit = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0
        changed = leaf(doc_id, text.translate(low) if text is not None else None, *rest) if hit else None
        leaves.append((rest[1], doc_id, leaf(doc_id, text, *rest), changed))
    got = sorted((tuple(r) for r in queries.op13_merkle_manifest(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted(((*r, r[5] == r[3]) for r in brute(leaves)), key=str)
    assert {r[6] for r in got} == {True, False}
