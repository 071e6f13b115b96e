"""Merkle proofs against a plain tree."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from burstlens.llm import merkle


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(*values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(digests, arity):
    """Root, and for every leaf the (before, after) of each level."""
    steps, at = [[] for _ in digests], list(range(len(digests)))
    while len(digests) > 1:
        runs = [digests[i : i + arity] for i in range(0, len(digests), arity)]
        for i, a in enumerate(at):
            run, slot = runs[a // arity], a % arity
            steps[i].append(("".join(run[:slot]), "".join(run[slot + 1 :])))
            at[i] = a // arity
        digests = [sha("".join(run)) for run in runs]
    return digests[0], steps


def expected(rows, arity):
    """Sorted (group, id, leaf, subroot, root, proof)."""
    key = lambda v: (v is not None, v if v is not None else 0)
    groups = {}
    for g, i, text in rows:
        groups.setdefault(g, []).append((i, leaf(i, g, text)))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda r: (key(r[0]), r[1]))
        trees[g] = tree([h for _, h in groups[g]], arity)
    root, above = tree([trees[g][0] for g in order], arity)
    return sorted(
        (
            (g, i, h, trees[g][0], root, steps + above[k])
            for k, g in enumerate(order)
            for (i, h), steps in zip(groups[g], trees[g][1], strict=True)
        ),
        key=str,
    )


def proofs(spark, rows, arity):
    df = spark.createDataFrame(rows, "lang string, doc_id long, text string").repartition(3)
    df = df.withColumn("Root", F.lit("old")).withColumn(
        "leaf", merkle.leaf_digest({c: F.col(c) for c in ("doc_id", "lang", "text")})
    )
    return merkle.with_proofs(df, "lang", ["doc_id"], arity=arity)


def rows_of(seed, n):
    r = random.Random(seed)
    langs = ["en"] * 9 + ["de", "é", "z", None, ""]
    ids = [None] + list(range(n))
    return [(r.choice(langs), r.choice(ids), r.choice([None, "", "añb", "x" * 99])) for _ in range(n)]


CASES = {
    "many": (rows_of(1, 150), 2),
    "three": (rows_of(2, 90), 3),
    "lone": ([("en", 5, "a")], 2),
    "lone groups": ([("en", 5, "a"), (None, 5, "a"), ("de", None, None)], 2),
    "equal rows": ([("en", 1, "a")] * 5, 2),
}


@pytest.mark.parametrize("name, levels", [("many", 12), *((name, 2) for name in CASES)])
def test_proofs_equal_a_plain_tree(spark, monkeypatch, name, levels):
    rows, arity = CASES[name]
    monkeypatch.setattr(merkle, "LEVELS", levels)
    found = proofs(spark, rows, arity).withColumns(
        {"again": merkle.folded(F.col("leaf"), F.col("proof")),
         "changed": merkle.folded(F.sha2(F.lit("other"), 256), F.col("proof")),
         "short": merkle.proof_digest(F.col("proof"))}
    ).collect()
    got = [(r.lang, r.doc_id, r.leaf, r.subroot, r.root, [tuple(s) for s in r.proof]) for r in found]
    assert sorted(got, key=str) == expected(rows, arity)
    assert all(r.again == r.root for r in found)
    assert all(r.changed != r.root for r in found)
    assert all(r.short == sha("".join(a + b for a, b in r.proof)) for r in found)


def test_no_rows(spark):
    assert proofs(spark, [], 2).collect() == []


def test_windows_are_bounded_by_blocks(spark):
    nodes = spark.range(10).selectExpr("0L as tree", "id as pos", "'a' as digest", "10L as total")
    plan = merkle._round(nodes, 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "SinglePartition" not in plan
    assert "Python" not in plan
