"""Base spans against Python's patterns, and terms on a corpus where one word gives a value away."""

import hashlib
import math
import random
import re
from collections import Counter

import regex
from pyspark.sql import functions as F

from roadspark.llm.privacy import CONTEXT, REMOVE, digest, find_private, sanitised

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def fine(kind, said):
    d = re.sub("[^0-9]", "", said)
    if kind == "ip":
        return all(int(p) <= 255 for p in said.split("."))
    if kind == "card":
        s = sum((x if i % 2 == 0 else x * 2 - 9 * (x > 4)) for i, x in enumerate(map(int, reversed(d))))
        return 12 <= len(d) <= 19 and s % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def brute(text):
    spans = []
    for place, (kind, pattern) in enumerate(PATTERNS.items()):
        spans += [(m.start(), place, m.end(), kind) for m in re.finditer(pattern, text or "") if fine(kind, m[0])]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(spans))


def base_of(spans):
    return ",".join(x for x in spans.split(",") if not x.startswith("term:"))


PIECES = ["a@b.c", "_d@e.f-g", "x.y+z@mail.ex.org", "1.2.3.4", "256.1.1.1", "001.02.3.0255", ".9", "4111 1111 1111 1111", "4111-1111-1111-1112", "0000000000000000", "+1 (212) 555-0199", "+49 30", "+", "@", ".", "-", " ", "12", "ñ", "\U0001f600", "日本", "a", "\n", "%", "1.2.3.4.5.6.7.8.9", "5500005555555559", "000", "(", ")"]


def test_base_spans_match_the_patterns(spark):
    draw = random.Random(6)
    texts = [None, "", "7" * 60_000, "a" * 60_000 + "@", "a@b" + ".c" * 20_000, "+1" + "(" * 50_000, "a@b.co " * 3000]
    texts += ["".join(draw.choice(PIECES) for _ in range(draw.randrange(1, 25))) for _ in range(1500)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)] + [(None, "a@b.c", "x", 1)], "doc_id long, text string, base string, row int").repartition(8)
    rows = digest(find_private(docs)).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        want = brute("a@b.c" if r["doc_id"] is None else texts[r["doc_id"]])
        assert base_of(r["spans"]) == want, texts[r["doc_id"]]
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in PATTERNS] == [want.count(f"{k}:") for k in PATTERNS]


def test_terms_that_disclose(spark):
    common = [(i, f"plain words about nothing much {i} and other plain words") for i in range(300)]
    told = [(1000 + i, f"the gardener Zebulon wrote plain words to z{i % 2}@mail.org about nothing") for i in range(8)]
    docs = spark.createDataFrame(common + told, "doc_id long, text string")
    out = find_private(docs, support=3, share=0.4, bits=3).cache()
    spans = {r["doc_id"]: r["spans"] for r in out.collect()}
    assert all(not spans[i] for i, _ in common)
    for i, text in told:
        said = {text[s["start"] : s["end"]] for s in spans[i] if s["kind"] == "term"}
        assert said == {"gardener", "Zebulon", "wrote"}
    cleaned = docs.join(out, "doc_id").where("doc_id = 1000").select(sanitised(F.col("text"), F.col("spans")).alias("t")).first()["t"]
    assert cleaned == "the [TERM] [TERM] [TERM] plain words to [EMAIL] about nothing"


def test_empty_table(spark):
    assert digest(find_private(spark.createDataFrame([], "doc_id long, text string"))).collect() == []


def test_terms_are_found_wherever_they_stand(spark):
    plain = "plain words about nothing much and other plain words "
    rows = [(i, plain) for i in range(300)]
    rows += [(1000 + i, f"the gardener Zebulon wrote plain words to z{i % 2}@mail.org about nothing {plain * 4}by ZEBULON") for i in range(8)]
    rows += [(2000, "nobody but Zebulon, not Zebulons"), (None, "zebulon"), (2000, "nobody but Zebulon, not Zebulons"), (2001, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = find_private(docs, support=3, share=0.2, bits=3).collect()
    texts = dict(rows)
    assert len(out) == len(rows)
    for r in out:
        text = texts[r["doc_id"]] or ""
        said = [(s["start"], s["end"]) for s in r["spans"] if s["kind"] == "term" and text[s["start"] : s["end"]].lower() == "zebulon"]
        assert said == [m.span() for m in re.finditer(r"\bzebulon\b", text.lower())]
        assert all(a["end"] <= b["start"] for a, b in zip(r["spans"], r["spans"][1:]))


def brute_terms(texts, support, share, bits):
    """{term: act}, by counting over all texts."""
    near, total, words = set(), Counter(), 0
    for row, text in enumerate(texts):
        text = text or ""
        words += len(regex.split(r"\P{L}+", text)) if texts[row] is not None else 0
        found = [(m.start(), m.end(), m[0].lower()) for m in regex.finditer(r"\p{L}{4,}", text)]
        total.update(w for _, _, w in found)
        for x in filter(None, brute(text).split(",")):
            kind, a, b = x.split(":")
            a, b = int(a), int(b)
            for s, e, w in found:
                if (s == 0 or s > a - CONTEXT) and (e == len(text) or e < b + CONTEXT) and (e <= a or s >= b):
                    near.add((row, (kind, text[a:b].lower()), w, s))
    joint = Counter((v, w) for _, v, w, _ in near)
    of_value = Counter()
    for (v, _), n in joint.items():
        of_value[v] += n
    acts = {}
    for (v, w), n in joint.items():
        part = n / total[w]
        if n >= support and part >= share and math.log2(part * words / of_value[v]) >= bits:
            acts[w] = max(acts.get(w, ""), "remove" if part >= REMOVE else "generalise")
    return acts


def test_co_occurrence_against_counts(spark):
    """Words and values at random, letters whose lower case is longer, values on both sides of a word, repeated rows."""
    draw = random.Random(11)
    names = ["İlkay", "Zebulon", "STRAẞE", "gardener", "Wilhelmina", "İİİİbrucken"]
    common = ["plain", "words", "about", "nothing", "of", "İ", "much", "more"]
    texts = [None, "", "İİ met Wilhelmina Zweibrucken near +44 123 456 7890 and left"]
    for _ in range(250):
        said = [draw.choice(common) for _ in range(draw.randrange(5, 60))]
        if draw.random() < 0.4:
            k = draw.randrange(len(names))
            at = draw.randrange(len(said))
            said[at:at] = [f"a{k}@mail.org", names[k], f"A{k}@mail.org"]
        if draw.random() < 0.1:
            said.append(draw.choice(names[:-1]))
        texts.append(draw.choice(["İ", "", " "]) + " ".join(said))
    texts += texts[-30:]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    acts = brute_terms(texts, 3, 0.5, 4)
    assert len(acts) > 3 and set(acts.values()) == {"remove", "generalise"}
    for r in find_private(docs, support=3, share=0.5, bits=4).collect():
        text = texts[r["doc_id"]] or ""
        base = [s for s in r["spans"] if s["kind"] != "term"]
        want = [(m.start(), m.end(), acts[m[0].lower()]) for m in regex.finditer(r"\p{L}{4,}", text) if m[0].lower() in acts]
        want = [w for w in want if not any(b["start"] < w[1] and w[0] < b["end"] for b in base)]
        assert [(s["start"], s["end"], s["said"]) for s in r["spans"] if s["kind"] == "term"] == want
        clean, at = "", 0
        for s in r["spans"]:
            clean += text[at : s["start"]] + ("" if s["said"] == "remove" and s["kind"] == "term" else f"[{s['kind'].upper()}]")
            at = s["end"]
        assert r["clean"] == (clean + text[at:] if r["spans"] else None)
        assert r["as_is"] == hashlib.sha256(text.encode()).hexdigest()
