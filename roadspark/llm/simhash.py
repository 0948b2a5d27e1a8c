"""SimHash near-duplicates: fingerprints of word shingles, linked by bit-sliced comparison, grouped by component."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .hamming import CHUNK, hamming_links
from .store import batch, bounded_batches, drop, materialize, texts

BLOCK = 1 << 16


def fingerprint(text: bytes, size: int = 3, seed: int = 42) -> int:
    """SimHash of the shingles of ``size`` lower-cased words; the whole sequence if shorter, 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - size + 1)
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_digest
    for lo in range(0, n, BLOCK):
        part = words[lo : min(n, lo + BLOCK) + size - 1]
        joined = b" ".join(part)
        lengths = np.fromiter(map(len, part), np.int64, len(part))
        ends = np.cumsum(lengths + 1) - 1
        starts = ends - lengths
        m = min(n, lo + BLOCK) - lo
        last = ends[len(part) - m :] if len(words) >= size else ends[-1:]
        raw = b"".join([digest(joined[a:b], seed) for a, b in zip(starts[:m].tolist(), last.tolist())])
        bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1)
        whole = len(bits) // 255 * 255
        counts += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        counts += bits[whole:].sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """(doc_id, fp long, the fingerprint's bits) of each row; a null or empty text has fingerprint 0."""
    bounded_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, size) for t in texts(b.column(1))], np.uint64).view(np.int64)
            yield batch(schema, (b.column(0), fps))

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, fp long")


def simhash_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 3,
    radius: int = 3,
    chunk: int = CHUNK,
) -> DataFrame:
    """(doc_id, fingerprint, component_id) of each row: component_id is the smallest doc_id reachable by links.

    Two rows are linked if their fingerprints differ in at most ``radius`` bits. Equal fingerprints meet in one
    aggregate that combines before its shuffle; only distinct ones are compared. Null and empty texts have fingerprint
    0 and are linked like any other; rows without doc_id link others too, get the component of their fingerprint, and
    null if no row of the component has an id. Repeated rows come back repeated. Ties do not arise, as a component has
    one smallest id. An empty table gives an empty one. Only the two named columns are read.
    """
    rows = materialize(fingerprints(docs, id_col, text_col, size), "fingerprints")
    distinct = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct")
    roots = connected_components(hamming_links(distinct, "fp", "fp", radius, chunk=chunk), "a", "b")
    grouped = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "rep")
    least = grouped.groupBy("root").agg(F.min("rep").alias("component_id"))
    of_fp = materialize(grouped.join(least, "root").select("fp", "component_id"), "components")
    drop(distinct, roots)
    return rows.join(of_fp, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
