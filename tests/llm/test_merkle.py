"""Merkle manifests against a plain tree."""

import hashlib

from pyspark.sql import functions as F

from docquarry.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def plain_tree(level):
    """Root, and per leaf the siblings from below, None where there is none."""
    proofs, below = [[] for _ in level], [[i] for i in range(len(level))]
    while len(level) > 1:
        runs = [range(i, min(i + 2, len(level))) for i in range(0, len(level), 2)]
        for run in runs:
            for i in run:
                for leaf in below[i]:
                    proofs[leaf].append(level[i ^ 1] if len(run) == 2 else None)
        below = [[leaf for i in run for leaf in below[i]] for run in runs]
        level = [h(*[level[i] for i in run]) for run in runs]
    return level[0], proofs


def plain_manifest(rows):
    """``leaf, subroot, root, digest of the siblings`` of every row, sorted."""
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = []
    for lang in langs:
        own = sorted(((r[0] is not None, r[0] or 0, leaf_of(r)) for r in rows if r[2] == lang))
        leaves = [leaf for _, _, leaf in own]
        trees.append((leaves, *plain_tree(leaves)))
    root, above = plain_tree([sub for _, sub, _ in trees])
    return sorted((leaf, sub, root, h(*[s for s in proof + up if s]))
                  for (leaves, sub, proofs), up in zip(trees, above) for leaf, proof in zip(leaves, proofs))


def check(spark, rows):
    docs = spark.createDataFrame(
        [(*r, 1, 2, 3) for r in rows],
        "doc_id bigint, source string, lang string, n_chars bigint, text string, leaf int, tree int, idx int")
    found = merkle.verified(merkle.manifest(docs)).withColumn("p", merkle.proof_digest(F.col("proof"))).collect()
    assert sorted((r.leaf, r.subroot, r.root, r.p) for r in found) == plain_manifest(rows)
    assert all(r.verified for r in found)
    return found


def test_trees_of_many_sizes(spark):
    sizes = {"a": 1, "b": 2, "c": 3, "d": 255, "e": 256, "f": 257, "é": 700, None: 5, "": 33}
    rows = [(i, f"s{i % 3}", lang, i, f"text {i} é") for lang, n in sizes.items() for i in range(n)]
    found = check(spark, rows)
    assert {r.position for r in found if r.lang == "f"} == set(range(257))


def test_nulls_ties_and_repeats(spark):
    rows = [(None, None, None, None, None)] * 2 + [(7, "x", "en", 1, "")] * 3 + [(7, "x", "en", 1, "other"), (-3, "", "en", 0, "a\n:b" * 9)]
    check(spark, rows)


def test_groups_of_single_rows(spark):
    check(spark, [(i, "s", f"l{i}", i, "t") for i in range(11)])
    check(spark, [(5, "s", "en", 1, "t")])


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id bigint, source string, lang string, n_chars bigint, text string")
    assert merkle.manifest(docs).count() == 0


def test_a_change_is_found(spark):
    rows = [(i, "s", "en" if i % 3 else "fr", i, f"t{i}") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string")
    made = merkle.manifest(docs, carry={"other": merkle.leaf_digest(
        "doc_id", "source", "lang", "n_chars", F.when(F.col("doc_id") == 9, F.lit("forged")).otherwise(F.col("text")))})
    tried = merkle.verified(made, "other").collect()
    assert {r.doc_id for r in tried if not r.verified} == {9}
    swapped = merkle.verified(made.withColumn("proof", F.concat(F.lit(b"\1"), F.expr("substring(proof, 2)"))))
    assert swapped.where("verified").count() < 50
