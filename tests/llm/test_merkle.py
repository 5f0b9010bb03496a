"""The manifest against a tree built by plain recursion."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from panel360.llm import merkle, queries


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def climb(nodes):
    """All levels over some digests, the last of one node."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([digest(*below[i:i + 8]) for i in range(0, len(below), 8)])
    return levels


def siblings(levels, at):
    out = []
    for nodes in levels[:-1]:
        first = at - at % 8
        out.append((nodes[first:at], nodes[at + 1:first + 8]))
        at //= 8
    return out


def plain(leaves):
    """(tree, order, leaf, changed) rows with subroot, root, proof, folded root."""
    trees = {}
    for row in sorted(leaves, key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
        trees.setdefault(row[0], []).append(row)
    names = sorted(trees, key=lambda n: (n is not None, (n or "").encode()))
    built = {n: climb([r[2] for r in trees[n]]) for n in names}
    forest = climb([built[n][-1][0] for n in names])
    for at, name in enumerate(names):
        for i, (_, order, leaf, changed) in enumerate(trees[name]):
            path = siblings(built[name], i) + siblings(forest, at)
            node = changed or leaf
            for left, right in path:
                node = digest(*left, node, *right)
            yield (name, order, leaf, built[name][-1][0], forest[-1][0],
                   "".join(d for a, b in path for d in (*a, *b)), node)


def check(spark, leaves):
    table = spark.createDataFrame([(*r, "x") for r in leaves],
                                  "lang string, doc_id long, leaf string, changed string, PROOF string")
    got = merkle.manifest(table.repartition(5), "lang", "doc_id", changed="changed").collect()
    rows = sorted(((r.lang, r.doc_id, r.leaf, r.subroot, r.root, r.proof, r.folded_root) for r in got), key=repr)
    assert rows == sorted(plain(leaves), key=repr)
    assert all(r.verified == (r.folded_root == r.root) for r in got)


def sample(rng, n, names):
    rows = []
    for i in range(n):
        leaf = digest(str(rng.randint(0, n)))
        key = rng.choice([None, 5, i, i, i, i, i, -i])
        rows.append((rng.choice(names), key, leaf, digest(leaf) if rng.random() < 0.4 else None))
    # Equal keys of a tree get equal leaves and changes, else which of two ties is which is open.
    first = {(r[0], r[1], r[2]): r[3] for r in rows}
    return [(*r[:3], first[r[:3]]) for r in rows]


@pytest.mark.parametrize("n", [1, 2, 8, 9, 65, 700])
def test_against_recursion(spark, n):
    rng = random.Random(n)
    check(spark, sample(rng, n, ["en"]))
    check(spark, sample(rng, n, ["en", "en", "en", "en", None, "", "é", "z", "Z", "😀", "ﬀ"]))


def test_many_trees(spark):
    rng = random.Random(2)
    check(spark, sample(rng, 400, [f"t{i}" for i in range(90)]))


def test_more_than_one_tier(spark):
    """More nodes than one task's subtree holds."""
    n = merkle.FANOUT ** merkle.LEVELS + 9
    leaves = [("en", i, digest(str(i)), digest("c") if i % 4001 == 0 else None) for i in range(n)]
    leaves += [("de", 1, digest("d"), None)]
    table = spark.createDataFrame(leaves, "lang string, doc_id long, leaf string, changed string")
    made = merkle.manifest(table, "lang", "doc_id", changed="changed").orderBy("lang", "doc_id")
    got = [(r.lang, r.doc_id, r.leaf, r.subroot, r.root, r.proof, r.folded_root) for r in made.collect()]
    assert got == sorted(plain(leaves))


def test_equal_rows_are_each_a_leaf(spark):
    check(spark, [("en", 3, digest("same"), digest("c"))] * 300 + [(None, None, digest("n"), None)] * 20)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "lang string, doc_id long, leaf string, note string")
    made = merkle.manifest(empty, "lang", "doc_id")
    assert made.collect() == [] and made.columns == ["lang", "doc_id", "leaf", "note", *merkle.ADDED]


def test_query(spark, tmp_path):
    rng = random.Random(4)
    docs = [(i if i != 7 else None, rng.choice([None, "", "A b\nÉ", "x" * 200_000, "Über A"]),
             rng.choice(["en", "fr", None]), rng.choice([None, "s"]), rng.choice([None, 12])) for i in range(90)]
    spark.createDataFrame(docs, queries.SCHEMAS["documents"]).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_merkle_manifest(spark, str(tmp_path)).collect()
    leaves, keys = [], {}
    for key, text, lang, source, n in docs:
        def leaf(body):
            return digest(*map(field, (key, source, lang, n, body)))
        low = text and "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        hit = key is not None and zlib.crc32(str(key).encode()) % 3 == 0
        leaves.append((lang, key, leaf(text), leaf(low) if hit else None))
        keys[key] = lang
    want = [(o, leaf, sub, root, digest(proof), node, node == root)
            for _, o, leaf, sub, root, proof, node in plain(leaves)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert not all(r.verified for r in got) and any(r.verified for r in got)


def test_leaf_digest(spark):
    row = spark.sql("SELECT 12L AS a, CAST(NULL AS STRING) AS b, '' AS c, 'é' AS d").select(
        merkle.leaf_digest(*map(F.col, "abcd"))).first()[0]
    assert row == digest("2:12-0:2:é")
