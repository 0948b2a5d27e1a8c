"""Benchmark decontamination: prefix-filtered containment join of item windows with the words of documents."""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import batch, bounded_batches, drop, materialize, texts

#: Most bytes of benchmark text that are broadcast. A word takes two bytes at least, with what parts it from the next,
#: so the numbers of its words fit 21 bits and those of three words a long.
BLOCK_BYTES = 4 << 20
WORD_BITS = 21
#: Bits of each of the two filters by which documents choose what they send to the joins: 16 MB.
FILTER_BITS = 1 << 27
#: Words of a shingle: 3 of them make one long.
SHINGLE = 3
#: A-Z to a-z; all that is not a digit, letter or part of a non-ASCII character to a space.
LOWER = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)


def words(text: bytes) -> list[bytes]:
    return text.translate(LOWER).split()


@dataclass
class Windows:
    """The distinct windows of a block of items, and their shingles."""

    width: int
    number: dict[bytes, int] = field(default_factory=dict)
    items: dict[tuple[int, ...], set[str]] = field(default_factory=lambda: defaultdict(set))

    def add(self, item_id: object, text: bytes) -> None:
        ids = [self.number.setdefault(w, len(self.number) + 1) for w in words(text)]
        for i in range(max(1, len(ids) - self.width + 1) if ids else 0):
            found = self.items[tuple(ids[i : i + self.width])]
            if item_id is not None:
                found.add(str(item_id))

    def codes(self, ids: np.ndarray, size: int) -> np.ndarray:
        """The number of each shingle of ``size`` words; negative where a word is no word of an item."""
        n = len(ids) - size + 1
        if n <= 0:
            return np.empty(0, np.int64)
        out, known = np.zeros(n, np.int64), np.ones(n, bool)
        for k in range(size):
            part = ids[k : k + n]
            out, known = out << WORD_BITS | part, known & (part > 0)
        return np.where(known, out, -1)

    def shingles(self) -> dict[int, np.ndarray]:
        """By size of the shingle, its distinct codes in order; windows of fewer words than a shingle are one."""
        found: dict[int, set[int]] = defaultdict(set)
        for w in self.items:
            size = min(SHINGLE, len(w))
            found[size].update(self.codes(np.array(w, np.int64), size).tolist())
        return {s: np.array(sorted(c), np.int64) for s, c in sorted(found.items())}


def _ids(number: dict[bytes, int], text: bytes) -> np.ndarray:
    get = number.get
    found = words(text)
    return np.fromiter((get(w, 0) for w in found), np.int64, len(found))


def document_frequency(docs: DataFrame, block: Windows, text_col: str) -> dict[int, np.ndarray]:
    """In how many documents each shingle of the block occurs, over all documents; as large as the block."""
    shared = docs.sparkSession.sparkContext.broadcast((block, block.shingles()))
    schema = pa.schema([("size", pa.int32()), ("place", pa.int64()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known = shared.value
        seen = {s: np.zeros(len(c), np.int64) for s, c in known.items()}
        for b in batches:
            for t in texts(b.column(0)):
                ids = _ids(own.number, t)
                for s, codes in known.items():
                    met = np.unique(own.codes(ids, s))
                    at = np.searchsorted(codes, met)
                    at = at[(at < len(codes)) & (codes[np.minimum(at, len(codes) - 1)] == met)]
                    seen[s][at] += 1
        for s, n in seen.items():
            at = np.flatnonzero(n)
            yield batch(schema, (np.full(len(at), s, np.int32), at, n[at]))

    found = (
        docs.select(F.col(text_col).cast("string").alias("text"))
        .mapInArrow(count, "size int, place long, n long")
        .groupBy("size", "place")
        .agg(F.sum("n").alias("n"))
    )
    frequency = {s: np.zeros(len(c), np.int64) for s, c in shared.value[1].items()}
    for row in found.toLocalIterator():
        frequency[row["size"]][row["place"]] = row["n"]
    return frequency


#: For each size of shingle: the prefix shingles in order, and for each the windows to verify (place of the shingle in
#: the window, words of the window, item ids).
Prefixes = dict[int, tuple[np.ndarray, list[list[tuple[int, np.ndarray, tuple[str, ...]]]]]]


def prefixes(block: Windows, frequency: dict[int, np.ndarray]) -> Prefixes:
    """The necessary prefix of each window: containment must be whole, so its rarest shingle alone is necessary."""
    known = block.shingles()
    made: dict[int, dict[int, list]] = defaultdict(lambda: defaultdict(list))
    for w, items in block.items.items():
        ids = np.array(w, np.int64)
        size = min(SHINGLE, len(w))
        codes = block.codes(ids, size)
        rarity = frequency[size][np.searchsorted(known[size], codes)]
        if not rarity.min():
            continue  # a shingle that no document holds: nor does any hold the window
        place = int(np.lexsort((codes, rarity))[0])
        made[size][int(codes[place])].append((place, ids, tuple(sorted(items))))
    return {s: (np.array(sorted(by), np.int64), [by[c] for c in sorted(by)]) for s, by in made.items()}


def find(block: Windows, index: Prefixes, text: bytes) -> tuple[int, list[tuple[int, int]], set[str]]:
    """Words of the text, its maximal hit runs of words (start, end), and the items whose windows occur."""
    ids = _ids(block.number, text)
    n = len(ids)
    spans: set[tuple[int, int]] = set()
    items: set[str] = set()
    for size, (codes, windows) in index.items():
        own = block.codes(ids, size)
        at = np.minimum(np.searchsorted(codes, own), len(codes) - 1)
        for position in np.flatnonzero(codes[at] == own).tolist():
            for place, window, names in windows[at[position]]:
                start = position - place
                if start < 0 or start + len(window) > n:  # positional and length bounds
                    continue
                if np.array_equal(ids[start : start + len(window)], window):
                    spans.add((start, start + len(window)))
                    items.update(names)
    merged: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return n, merged, items


FOUND = "struct<n_words:bigint,spans:array<struct<start:bigint,end:bigint>>,items:array<string>>"


def _finder(spark, block: Windows, index: Prefixes) -> Column:
    shared = spark.sparkContext.broadcast((block, index))
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    kind = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(span)), ("items", pa.list_(pa.string()))])

    def run(col: pa.Array) -> pa.Array:
        own, prefix = shared.value
        rows = []
        for t in texts(col):
            n, spans, items = find(own, prefix, t)
            rows.append({"n_words": n, "spans": [{"start": a, "end": b} for a, b in spans], "items": sorted(items)})
        return pa.array(rows, kind)

    run.__annotations__ = {"col": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, returnType=FOUND)


def block_of(items: DataFrame, width: int) -> Windows:
    """The windows of a benchmark whose size has been checked."""
    block = Windows(width)
    for row in items.toLocalIterator():
        block.add(row["item_id"], row["text"].encode())
    return block


def contamination(
    docs: DataFrame,
    bench: DataFrame,
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    width: int = 10,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``docs`` with a column found: n_words, spans (hit runs of words) and items (ids, sorted) of each row.

    A window is ``width`` consecutive words of an item, or all its words if they are fewer. Shingles of three words
    are ordered by the number of documents that hold them; a window's rarest shingle is its necessary prefix. Only
    where a document holds it, and the window fits there, are the words compared. Null texts have no words; an item
    without an id marks words, but names no item; an empty benchmark hits nothing. Repeated rows stay repeated, and
    the other columns of ``docs`` are carried along, whatever their names; a column found is replaced. Of equally rare
    shingles the least is the prefix. A benchmark
    of up to ``block_bytes`` of text is broadcast; the prefixes of a larger one are a table that documents are joined
    with (:func:`joined`), with the same result.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    items = bench.select(F.col(item_id).cast("string").alias("item_id"), F.col(item_text).cast("string").alias("text")).where("text is not null")
    if (items.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0) > min(block_bytes, BLOCK_BYTES):
        return joined(docs, items, text_col, width)
    block = block_of(items, width)
    index = prefixes(block, document_frequency(docs, block, text_col)) if block.items else {}
    found = _finder(spark, block, index)(F.col(text_col).cast("string"))
    return docs.select(*(c for c in docs.columns if c != "found"), found.alias("found"))


# -- the same join for a benchmark of any size: its prefixes are a table ---------------------------------------------


def hashes(found: list[bytes], size: int) -> np.ndarray:
    """64 bits of each run of ``size`` words."""
    n = len(found) - size + 1
    if n <= 0:
        return np.empty(0, np.int64)
    each = np.fromiter((xxhash.xxh64_intdigest(w) for w in found), np.uint64, len(found))
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out = (out ^ each[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def bits_of(codes: DataFrame) -> np.ndarray:
    """A filter of :data:`FILTER_BITS` bits, two for each code; its size does not depend on the number of codes."""
    low = F.col("code").bitwiseAND(F.lit(FILTER_BITS - 1))
    high = F.shiftrightunsigned("code", 32).bitwiseAND(F.lit(FILTER_BITS - 1))
    each = codes.select(F.explode(F.array(low, high)).alias("p"))
    parts = each.select(F.shiftright("p", 6).alias("i"), F.expr("shiftleft(1L, cast(p & 63 as int))").alias("b")).groupBy("i").agg(F.bit_or("b").alias("b"))
    out, met = np.zeros(FILTER_BITS // 64, np.uint64), parts.toArrow()
    out[met["i"].to_numpy()] = met["b"].to_numpy().view(np.uint64)
    return out


def may_hold(bits: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """False where a code is surely not in the filter."""
    own, mask = codes.view(np.uint64), np.uint64(FILTER_BITS - 1)
    seen = lambda at: bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)
    return (seen(own & mask) & seen(own >> np.uint64(32) & mask)).astype(bool)


def _rows(df: DataFrame, make, schema: str, kinds: pa.Schema) -> DataFrame:
    """What ``make`` yields of each (key, text), as rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made: list[tuple] = []
            for key, text in zip(b.column(0).to_pylist(), texts(b.column(1))):
                for row in make(key, text):
                    made.append(row)
                    if len(made) >= 1 << 14:
                        yield batch(kinds, zip(*made))
                        made = []
            if made:
                yield batch(kinds, zip(*made))

    return df.mapInArrow(run, schema)


def joined(docs: DataFrame, items: DataFrame, text_col: str, width: int) -> DataFrame:
    """:func:`contamination` by shuffled joins. Documents send only the shingles that two filters of fixed size let
    through: first those of the benchmark, to count documents, then those that are prefixes, with the words around
    them, which meet the prefix table by shingle and are compared. Equal texts share their findings."""
    spark = docs.sparkSession
    text_kind = pa.schema([("item_id", pa.string()), ("window", pa.string())])

    def windows_of(item: str | None, text: bytes):
        w = words(text)
        for i in range(max(1, len(w) - width + 1) if w else 0):
            yield item, b" ".join(w[i : i + width]).decode()

    named = materialize(_rows(items, windows_of, "item_id string, window string", text_kind).distinct(), "windows")
    code_kind = pa.schema([("window", pa.string()), ("place", pa.int32()), ("code", pa.int64())])

    def shingles_of(window: str, text: bytes):
        w = text.split()
        for place, code in enumerate(hashes(w, min(SHINGLE, len(w))).tolist()):
            yield window, place, code

    own = named.select("window", F.col("window").alias("text")).distinct()
    shingles = materialize(_rows(own, shingles_of, "window string, place int, code long", code_kind), "shingles")
    size = F.size(F.split("window", " "))
    sizes = sorted(r[0] for r in own.select(F.least(F.lit(SHINGLE), size)).distinct().collect())  # 3 at most
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    bodies = docs.select(F.md5(text).alias("key"), text.alias("text"))

    any_ = spark.sparkContext.broadcast(bits_of(shingles.select("code")))

    def held(_: str, body: bytes):
        w = words(body)
        for s in sizes:
            codes = np.unique(hashes(w, s))
            for c in codes[may_hold(any_.value, codes)].tolist():
                yield (c,)

    counts = _rows(bodies, held, "code long", pa.schema([("code", pa.int64())])).groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    rare = shingles.join(counts, "code", "left").groupBy("window").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "code", "place")).alias("m"))
    table = materialize(rare.where("m.n > 0").select("m.code", "m.place", "window", size.alias("size")), "prefixes")

    chosen = spark.sparkContext.broadcast(bits_of(table.select("code")))
    near_kind = pa.schema([("key", pa.string()), ("position", pa.int64()), ("code", pa.int64()), ("before", pa.int32()), ("around", pa.list_(pa.string()))])

    def near(key: str, body: bytes):
        w = words(body)
        for s in sizes:
            codes = hashes(w, s)
            for at in np.flatnonzero(may_hold(chosen.value, codes)).tolist():
                first = max(0, at - width + 1)
                yield key, at, int(codes[at]), at - first, [x.decode() for x in w[first : at + width]]

    places = _rows(bodies, near, "key string, position long, code long, before int, around array<string>", near_kind).distinct()
    met = places.join(table, "code").where("before >= place").where(F.array_join(F.slice("around", F.col("before") - F.col("place") + 1, F.col("size")), " ") == F.col("window"))
    start = F.col("position") - F.col("place")
    hits = materialize(met.select("key", start.alias("start"), (start + F.col("size")).alias("end"), "window"), "hits")
    spans = hits.groupBy("key").agg(merge_spans(F.array_sort(F.collect_set(F.struct("start", "end")))).alias("spans"))
    ids = hits.select("key", "window").distinct().join(named.where("item_id is not null"), "window").groupBy("key").agg(F.array_sort(F.collect_set("item_id")).alias("ids"))
    k, s, i = (f"{c}_{uuid.uuid4().hex}" for c in ("key", "spans", "ids"))
    found = materialize(spans.join(ids, "key", "left").toDF(k, s, i), "found")
    drop(shingles, table, hits, named)
    one = F.struct(
        n_words()(text).alias("n_words"),
        F.coalesce(s, F.array().cast("array<struct<start:bigint,end:bigint>>")).alias("spans"),
        F.coalesce(i, F.array().cast("array<string>")).alias("items"),
    )
    return docs.withColumn(k, F.md5(text)).join(found, k, "left").select(*(c for c in docs.columns if c != "found"), one.alias("found"))


def n_words():
    """The number of words of each text."""

    def run(col: pa.Array) -> pa.Array:
        return pa.array([len(words(t)) for t in texts(col)], pa.int64())

    run.__annotations__ = {"col": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, returnType="long")


def merge_spans(spans: Column) -> Column:
    """Union of sorted spans as maximal runs."""
    kind = "array<struct<start:bigint,end:bigint>>"

    def put(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        wider = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        return F.when((F.size(done) > 0) & (s["start"] <= F.try_element_at(done, F.lit(-1))["end"]),
                      F.concat(F.slice(done, 1, F.size(done) - 1), F.array(wider))).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(spans, F.array().cast(kind), put)


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from :func:`contamination`."""
    n_hit = F.aggregate("found.spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id",
        F.col("found.n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("found.items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )
