import hashlib
import zlib

from pyspark.sql import functions as F

from llm_cases import EDGES
from marquee.llm import merkle as M

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, grp int, path string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def tree(leaves):
    """Root, and for every leaf its siblings with their side."""
    level, at, proofs = list(leaves), list(range(len(leaves))), [[] for _ in leaves]
    while len(level) > 1:
        for k, i in enumerate(at):
            sibling = i ^ 1
            proofs[k].append(("", None) if sibling >= len(level) else (level[sibling], sibling > i))
            at[k] = i // 2
        level = [H(*level[i:i + 2]) for i in range(0, len(level), 2)]
    return level[0], proofs


def brute(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    per = {x: sorted([(r[0] is not None, r[0] or 0, leaf(r), r) for r in rows if r[2] == x], key=lambda t: t[:3]) for x in langs}
    trees = {x: tree([t[2] for t in v]) for x, v in per.items()}
    root, upper = tree([trees[x][0] for x in langs]) if langs else (None, [])
    out = []
    for n, x in enumerate(langs):
        for k, (*_, h, r) in enumerate(per[x]):
            steps = trees[x][1][k] + upper[n]
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            node = leaf((*r[:3], r[3] + 1, r[4])) if hit else h
            for sibling, right in steps:
                node = H(node, sibling) if right is not False else H(sibling, node)
            out.append((r[0], h, trees[x][0], root, H(*[s for s, _ in steps]), node, node == root))
    return sorted(out, key=str)


def got(docs):
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    tampered = M.digest(*[F.when(hit, F.col("n_chars") + 1).otherwise(F.col("n_chars")) if c == "n_chars" else c for c in M.FIELDS])
    rows = M.verify(docs, tampered).select("doc_id", "leaf", "subroot", "root", M.proof_digest(F.col("path")), "folded_root", "verified").collect()
    return sorted([tuple(r) for r in rows], key=str)


def test_equals_brute_force(spark, monkeypatch):
    rows = [(d, None if i % 3 else "s", [None, "en", "", "é"][i % 4], None if i % 5 == 0 else i, t) for i, (d, t) in enumerate(EDGES)]
    rows += [(i, "src", "de", i * 7, f"text {i}") for i in range(37)] + [(99, "a", "fr", 3, "one")] + [(50, "s", "de", 1, "same")] * 3
    frame = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA).repartition(5)
    want = brute(rows)
    assert got(frame) == want
    assert any(not r[-1] for r in want)
    monkeypatch.setattr(M, "ONE_TASK_NODES", 2)
    assert got(frame) == want


def test_one_row_and_none(spark):
    rows = [(3, None, None, None, None)]
    frame = spark.createDataFrame([(*rows[0], "x", 1, "y")], SCHEMA)
    assert got(frame) == brute(rows)
    assert got(frame.limit(0)) == []
