"""Contamination against a scan of every window in every document."""

import hashlib
import random
import re

import pytest

from roadspark.llm.decontaminate import contamination, digest

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    out = []
    for doc_id, text in docs:
        w = words(text)
        hit, found = [False] * len(w), set()
        for item, item_text in items:
            v = words(item_text)
            for i in range(max(1, len(v) - 9) if v else 0):
                win = v[i : i + 10]
                for j in range(len(w) - len(win) + 1):
                    if w[j : j + len(win)] == win:
                        hit[j : j + len(win)] = [True] * len(win)
                        if item is not None:
                            found.add(str(item))
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc_id, len(w), sum(hit), len(found), digest, any(hit)))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def case():
    draw = random.Random(1)
    word = lambda: draw.choice("aa bb cc dd ee ff ñandú Éa 12".split())
    items = [(i, " ".join(word() for _ in range(draw.choice([1, 2, 3, 9, 10, 11, 30])))) for i in range(25)]
    items = [x for x in items if len(x[1].split()) > 2] + [(101, "solo"), (102, "Two words"), (103, None), (104, " -- "), (None, "no item id here"), (105, items[0][1])]
    docs = [(i, " ".join(word() for _ in range(draw.randrange(0, 80)))) for i in range(60)]
    docs += [(100 + i, f"zz, {items[i][1]!s}. Yy; {items[-i][1]}") for i in range(8)]
    docs += [(200, None), (201, ""), (202, "SOLO!"), (203, "two-words no item id here"), (203, "two-words"), (204, "qq " * 50_000 + "solo"), (None, "solo")]
    return docs, items


@pytest.mark.parametrize("block_bytes", [4 << 20, 150])
def test_matches_brute_force(spark, case, block_bytes):
    docs, items = case
    d = spark.createDataFrame([(a, b, 1, 2, 3, 4) for a, b in docs], "doc_id long, text string, item_id int, n_words int, found int, found_0 int")
    b = spark.createDataFrame([(a, b, 3) for a, b in items], "item_id long, text string, doc_id int")
    got = sorted((tuple(r) for r in digest(contamination(d, b, block_bytes=block_bytes)).collect()), key=repr)
    assert got == brute(docs, items)


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert [tuple(r)[:3] for r in digest(contamination(d, b.limit(0))).collect()] == [(1, 2, 0)]
    assert digest(contamination(d.limit(0), b)).collect() == []
