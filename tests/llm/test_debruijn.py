"""Removal of repeated word windows against a scan of all windows."""

import hashlib
import random

import pytest

from roadspark.llm.debruijn import compact, digest, nodes, word_dedup


def brute(rows, size):
    first = {}
    for d, t in rows:
        w = (t or "").encode().split()
        for i in range(len(w) - size + 1) if d is not None else ():
            key = tuple(w[i : i + size])
            first[key] = min(first.get(key, (d, i)), (d, i))
    out = []
    for d, t in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - size + 1) if d is not None else ():
            if first[tuple(w[i : i + size])] < (d, i):
                gone[i : i + size] = [True] * size
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def case():
    draw = random.Random(3)
    word = lambda: draw.choice("a b cc Ñ dd e | f. g".split(" ")) + draw.choice(["", "1", "2", "x"])
    text = lambda n: [word() for _ in range(n)]
    common, other = text(70), text(40)
    rows = []
    for i in range(60):
        cut = draw.randrange(0, 40)
        own = text(draw.randrange(0, 60)) + common[cut : cut + draw.randrange(10, 70)] + (other if i % 3 == 0 else []) + text(5)
        rows.append((i, " \n\t"[i % 3].join(own)))
    rows += [(60 + i, rows[2 * i][1]) for i in range(8)]
    rows += [(70, "z " * 90), (71, "q p " * 60 + "z " * 30), (72, " ".join(common + text(3) + common)), (73, "w" * 50_000), (74, " ".join(common[:19])), (75, " ".join(common[:20]))]
    return rows + [(5, rows[5][1]), (6, rows[9][1]), (None, " ".join(common)), (80, None), (81, ""), (82, " ".join(common * 30))]


@pytest.mark.parametrize("size,gram", [(20, 7), (6, 3)])
def test_matches_brute_force(spark, size, gram):
    rows = case()
    docs = spark.createDataFrame([(a, b, 1, 2) for a, b in rows], "doc_id long, text string, a int, start int").repartition(5)
    got = sorted((tuple(r) for r in digest(word_dedup(docs, size=size, gram=gram)).collect()), key=repr)
    assert got == brute(rows, size)


def test_unbranched_paths_compact(spark):
    seen = []  # windows 1-2-3-4 in two texts; after 2 the second text goes on otherwise
    for doc, path in ((1, [1, 2, 3, 4]), (2, [1, 2, 5]), (3, [3, 4])):
        for i, w in enumerate(path):
            seen.append((w, 0, doc, 0, i, path[i + 1] if i + 1 < len(path) else None, path[i - 1] if i else None))
    found = spark.createDataFrame(seen, "a long, b long, doc_id long, row long, start long, after long, before long")
    got = sorted((r["a"], r["windows"]) for r in compact(nodes(found)).collect())
    assert got == [(1, 1), (2, 1), (3, 2)] or got == [(1, 2), (3, 2)]


def test_empty_table(spark):
    assert digest(word_dedup(spark.createDataFrame([], "doc_id long, text string"))).collect() == []
