"""Removal of repeated byte windows against a scan of all windows."""

import hashlib
import random

import numpy as np
import pytest

from roadspark.llm import windows
from roadspark.llm.suffixes import digest, radix_groups, suffix_dedup


def brute(rows, size):
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - size + 1) if d is not None else ():
            w = b[i : i + size]
            first[w] = min(first.get(w, d), d)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for i in range(len(b) - size + 1) if d is not None else ():
            if first[b[i : i + size]] < d:
                gone[i : i + size] = [True] * size
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def case(size):
    draw = random.Random(size)
    text = lambda n: "".join(draw.choice("ab cñ\n") for _ in range(n))
    common = text(3 * size)
    rows = [(i, text(draw.randrange(0, 200)) + (common[draw.randrange(size) :] if i % 3 else "") + text(20)) for i in range(60)]
    rows += [(60 + i, rows[i][1]) for i in range(10)] + [(75, "x" * 5 * size), (76, "y" + "x" * 3 * size), (77, "a")]
    return rows + [(3, rows[3][1]), (4, rows[5][1]), (None, common), (80, None), (81, ""), (82, common * 40), (83, text(size)), (84, common[:size])]


@pytest.mark.parametrize("size,gram,hot,part", [(50, 16, 1 << 15, 1 << 18), (50, 16, 5, 1 << 18), (12, 5, 40, 100), (20, 6, 1 << 15, 64)])
def test_matches_brute_force(spark, monkeypatch, size, gram, hot, part):
    rows = case(size)
    docs = spark.createDataFrame([(a, b, 1, 2) for a, b in rows], "doc_id long, text string, row int, start int").repartition(5)
    if part < windows.PART:  # seen by the functions here; the tasks keep their own
        monkeypatch.setattr(windows, "PART", part)
        at = np.array([0, 30, 30, 500, 520])
        tokens = np.random.default_rng(1).integers(0, 2**63, 520).astype(np.uint64)
        kind = windows.Tokens(size, gram, windows.byte_tokens)
        small = sorted(x for s in windows.stretches(tokens, at, kind) for t, f, n, *_ in zip(*s) for x in [(int(t), int(f) + j) for j in range(n)])
        assert small == [(t, i) for t in range(4) for i in range(at[t], at[t + 1] - size + 1)]
    got = sorted((tuple(r) for r in digest(suffix_dedup(docs, size=size, gram=gram, hot=hot)).collect()), key=repr)
    assert got == brute(rows, size)


def test_radix_passes_end_at_the_depth():
    data = np.frombuffer(b"abcdefghijXabcdefghijYabcdefghZZ", np.uint8)
    starts = np.array([0, 11, 22])
    for depth, equal in ((8, [0, 1, 2]), (10, [0, 1]), (11, [])):
        assert sorted(radix_groups(data, starts, np.zeros(3, int), depth)[0].tolist()) == equal


def test_large_ids_beside_a_missing_one(spark):
    said = "".join(random.Random(2).choice("abcdefgh ") for _ in range(300))
    rows = [(2**53 + 1, said[:200] + "x" * 9), (2**53 + 3, said[50:]), (None, said), (2**53 + 2, said[100:])]
    got = sorted((tuple(r) for r in digest(suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))).collect()), key=repr)
    assert got == brute(rows, 50)


def test_empty_table(spark):
    assert digest(suffix_dedup(spark.createDataFrame([], "doc_id long, text string"))).collect() == []


def test_equal_stretches_of_a_text_are_one_row():
    draw = np.random.default_rng(5)
    rows = draw.integers(0, 3, (3, 400)).astype(np.uint64)
    kept = windows.distinct(rows[0], rows[1], rows[2].astype(np.int64))
    assert len({tuple(rows[:, i]) for i in kept}) == len(kept) == len({tuple(r) for r in rows.T})
