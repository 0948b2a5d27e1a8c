"""Packing and token counts against the tokenizers library applied to whole texts."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from roadspark.llm import packing
from roadspark.llm.packing import best_fit, pack
from roadspark.llm.token_counts import section_tokens

TEXTS = [None, "", " \n", "one", "It's <|endoftext|> here", "ñandú 日本 " * 30, "a b\n\nc d.\n", "\n\n\n", "x" * 5000, "q r\n" * 900, "é ́e", "one"]


def rows():
    draw = random.Random(2)
    more = [" ".join(draw.choice("the of house árbol 12 !?".split()) for _ in range(draw.randrange(0, 90))) for _ in range(200)]
    return list(enumerate([*TEXTS, *more])) + [(3, "one"), (None, "no id")]


@pytest.mark.parametrize("capacity,fan_in", [(2048, 8), (64, 2)])
def test_pack_round_trip(spark, monkeypatch, capacity, fan_in):
    monkeypatch.setattr(packing, "FAN_IN", fan_in)
    docs = spark.createDataFrame([(a, b, 0, 1) for a, b in rows()], "doc_id long, text string, piece int, bin int").repartition(7)
    got = pack(docs, capacity=capacity).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for doc, text in rows():
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), capacity)):
            own = ids[at : at + capacity]
            want.append((doc, k, at, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)
    places = {}
    for r in got:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(places) <= -(-sum(r["length"] for r in got) // capacity) * 1.05 + 1


def test_best_fit_prefers_the_fullest_bin():
    bin_of, offset = best_fit(np.array([6, 5, 4, 5]), 10)
    assert bin_of.tolist() == [0, 1, 0, 1] and offset.tolist() == [0, 0, 6, 5]


def test_pack_empty(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("rule", ["start", "overlap", "split"])
def test_sections_match_offsets(spark, rule):
    docs = spark.createDataFrame([(a, b, 1) for a, b in rows()], "doc_id long, text string, section int")
    got = sorted((tuple(r) for r in section_tokens(docs, rule=rule).collect()), key=repr)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    want = []
    for doc, text in rows():
        text = text or ""
        lines = text.splitlines(keepends=True) or [""]
        at = np.cumsum([0] + [len(x) for x in lines])
        counts = [0.0] * len(lines)
        # characters here: the borders lie at line feeds, and tokens that cross them hold only ASCII
        for a, b in tokenizer.encode(text, add_special_tokens=False).offsets:
            share = [max(0, min(b, at[k + 1]) - max(a, at[k])) for k in range(len(lines))]
            if rule == "start":
                counts[int(np.searchsorted(at[:-1], a, "right")) - 1] += 1
            elif rule == "overlap":
                counts[int(np.argmax(share))] += 1
            else:
                for k, s in enumerate(share):
                    counts[k] += s / sum(share)
        want += [(doc, k, int(at[k]), int(at[k + 1]), counts[k]) for k in range(len(lines))]
    assert [r[:4] for r in got] == [r[:4] for r in sorted(want, key=repr)]
    assert np.allclose([r[4] for r in got], [r[4] for r in sorted(want, key=repr)])


def test_sections_empty(spark):
    assert section_tokens(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    with pytest.raises(ValueError):
        section_tokens(spark.createDataFrame([], "doc_id long, text string"), rule="other")
