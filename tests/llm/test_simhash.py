"""SimHash groups against all pairs compared one by one."""

import random

import xxhash

from roadspark.llm.hamming import forest, planes, within
from roadspark.llm.simhash import fingerprint, simhash_groups

import numpy as np


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(rows, radius=3):
    fps = [brute_fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    best = {}
    for (d, _), g in zip(rows, group):
        best[g] = min(best.get(g, d), d)
    return sorted((d, f"{f:016x}", best[g]) for (d, _), f, g in zip(rows, fps, group))


def made_rows():
    draw = random.Random(5)
    words = ["Ab", "ça", "ñu", "dd", "e", "F1", "gg h"]
    rows = [(i, " ".join(draw.choice(words) for _ in range(draw.randrange(0, 6)))) for i in range(120)]
    base = [draw.choice(words) + str(draw.randrange(50)) for _ in range(400)]
    for i in range(120, 180):
        copy = list(base)
        copy[draw.randrange(400)] = "x"
        rows.append((i, "\t".join(copy)))
    return [*rows, (180, None), (181, ""), (182, " \n"), (183, "w" * 100_000), (5, rows[5][1])]


def test_groups_match_all_pairs(spark):
    rows = made_rows()
    docs = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], "doc_id long, text string, fp string, rep string")
    for chunk in (4096, 8):  # 8: buckets are dealt out as pairs of chunks
        got = sorted(tuple(r) for r in simhash_groups(docs, chunk=chunk).collect())
        assert got == brute_groups(rows)


def test_rows_without_id_link_others(spark):
    draw = random.Random(17)
    base = [str(draw.randrange(10**6)) for _ in range(60)]
    texts = []
    for _ in range(250):
        own = list(base)
        own[draw.randrange(60)] = str(draw.randrange(10**6))
        texts.append(" ".join(own))
    fps = [brute_fingerprint(t) for t in texts]
    near = lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 3
    x, y, z = next((x, y, z) for y in range(250) for x in range(250) if near(x, y) and x != y for z in range(x) if near(y, z) and z != y and not near(x, z))
    docs = spark.createDataFrame([(10, texts[x]), (None, texts[y]), (4, texts[z]), (None, "far away")], "doc_id long, text string")
    got = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in simhash_groups(docs).collect()}
    assert got == {(10, f"{fps[x]:016x}"): 4, (None, f"{fps[y]:016x}"): 4, (4, f"{fps[z]:016x}"): 4, (None, f"{brute_fingerprint('far away'):016x}"): None}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash_groups(docs).collect() == []


def test_long_text_over_block_border():
    text = " ".join(str(i % 977) for i in range(70_000))
    assert fingerprint(text.encode()) == brute_fingerprint(text)


def test_bit_sliced_distance():
    draw = np.random.default_rng(3)
    fps = np.full(300, 12345, np.uint64) ^ (np.uint64(1) << draw.integers(0, 64, 300).astype(np.uint64)) ^ draw.integers(0, 8, 300).astype(np.uint64)
    for radius in range(6):
        for shift in (1, 7, 64, 299):
            mask = within(planes(fps), shift, (1 << (300 - shift)) - 1, radius)
            want = np.bitwise_count(fps[:-shift] ^ fps[shift:]) <= radius
            assert [bool(mask >> i & 1) for i in range(300 - shift)] == want.tolist()
    assert len(forest(fps[:0], np.empty(0, int), 5, 3)) == 0


def test_pairwise_comparison_finds_the_same():
    from roadspark.llm.hamming import verified_forest

    draw = np.random.default_rng(9)
    fps = np.sort(draw.integers(0, 1 << 6, 60).astype(np.uint64) << np.uint64(40))
    group = np.repeat(np.arange(3), 20)
    plain = forest(fps, group, 60, 3)
    assert verified_forest(fps, np.array([0, 20, 40, 60]), np.zeros(60, int), 3, 4, None).tolist() == plain.tolist()
    asked = []
    verified_forest(fps, np.array([0, 20, 40, 60]), np.zeros(60, int), 3, 4, lambda i, j: asked.append((i, j)) or False)
    want = [(i, j) for i in range(60) for j in range(i + 1, 60) if i // 20 == j // 20 and int(fps[i] ^ fps[j]).bit_count() <= 3]
    assert sorted(asked) == want
