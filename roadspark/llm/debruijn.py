"""Repeated word windows as a de Bruijn graph: windows are nodes, one more word is an edge, unbranched paths compact."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .hamming import runs
from .store import batch, drop, materialize, release, texts
from .windows import Copies, Tokens, compare_stretches, covered, gram_hashes, keyed, known, lists_of, span_lists, stretches, word_tokens

#: Different stretches of a minimizer that a task holds at most while it looks whether one is alone.
HELD = 1 << 15


def occurrences(met: DataFrame, kind: Tokens) -> DataFrame:
    """(a, b, doc_id, row, start, after, before) of each window that has to be compared, in the first of equal stretches.

    (a, b) is a 128-bit hash of the window; after and before are hashes of the words beside it, null at the ends of
    its stretch.
    """
    names = ("a", "b", "doc_id", "row", "start", "after", "before")
    schema = pa.schema([(n, pa.int64()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, row, compared = b.column(0).to_numpy(), b.column(1).to_numpy(), list(lists_of(b.column(3)))
            copies = Copies(b.column(4), b.column(5))
            tokens, at = kind.hashed(b.column(2))
            for text, first, n, grams, whole in stretches(tokens, at, kind):
                keep = known(text, grams.view(np.int64), compared) & ~copies.flags(text, whole)
                if not keep.any():
                    continue
                text, first, n = text[keep], first[keep], n[keep]
                lo = int(first[0])
                own = tokens[lo : int(first[-1] + n[-1]) + kind.size - 1]
                ends = np.cumsum(n)
                place = np.repeat(first - ends + n, n) + np.arange(ends[-1])
                x, y = (gram_hashes(own, kind.size, seed)[place - lo].view(np.int64) for seed in (101, 202))
                of = np.repeat(text, n)
                edge = np.zeros((2, len(place)), bool)
                edge[0, ends - 1] = edge[1, ends - n] = True
                after = pa.array(tokens.view(np.int64)[np.minimum(place + kind.size, len(tokens) - 1)], mask=edge[0])
                before = pa.array(tokens.view(np.int64)[place - 1], mask=edge[1])
                yield batch(schema, (x, y, ids[of], row[of], place - at[of], after, before))

    rows = met.where("size(grams) > 0").select("doc_id", "row", "text", "grams", "copies", "again")
    return rows.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def nodes(found: DataFrame) -> DataFrame:
    """Windows that occur more than once: times, first place, and whether one word always follows or precedes.

    The end of a stretch counts as a word of its own, so along an unbranched edge the occurrences of both windows
    correspond one to one, and their first places are neighbours in the same text.
    """
    one = lambda c: (F.count(c) == F.count(F.lit(1))) & (F.min(c) == F.max(c))
    return (
        found.groupBy("a", "b")
        .agg(
            F.count(F.lit(1)).alias("times"),
            F.min(F.struct("doc_id", "start", "row")).alias("first"),
            one("after").alias("one_after"),
            one("before").alias("one_before"),
        )
        .where("times > 1")
        .select("a", "b", "times", F.col("first.doc_id").alias("doc"), F.col("first.start").alias("place"), F.col("first.row").alias("source"), F.coalesce("one_after", F.lit(False)).alias("one_after"), F.coalesce("one_before", F.lit(False)).alias("one_before"))
    )


def compact(graph: DataFrame) -> DataFrame:
    """(a, b, doc, place, source, windows): the first node of each unbranched path and the path's length.

    A node joins the node at the next place of its first text; the edge is unbranched if the one has one successor,
    the other one predecessor, and both occur as often: the source coordinates verify the path. Paths are the runs of
    such edges along the source text, so no round of pointer jumping is needed, and none is longer than its source.
    """
    ahead = graph.select("doc", "source", (F.col("place") + 1).alias("place"), F.col("times").alias("times_before"), "one_after")
    linked = graph.drop("one_after").join(ahead, ["doc", "source", "place"], "left")
    starts = linked.withColumn("new", ~F.coalesce(F.col("one_after") & F.col("one_before") & (F.col("times") == F.col("times_before")), F.lit(False)))
    along = Window.partitionBy("doc", "source").orderBy("place")
    numbered = starts.withColumn("path", F.sum(F.col("new").cast("long")).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("doc", "source", "path").agg(
        F.count(F.lit(1)).alias("windows"), F.min("place").alias("place"), F.min_by("a", "place").alias("a"), F.min_by("b", "place").alias("b")
    ).drop("path")


def repeated_words(met: DataFrame, kind: Tokens) -> DataFrame:
    """(doc_id, row, start, length) in words of the later occurrences of each path, stored."""
    found = materialize(occurrences(met, kind), "windows")
    graph = materialize(nodes(found), "nodes")
    paths = materialize(compact(graph), "paths")
    again = found.select("a", "b", "doc_id", "row", "start").join(paths, ["a", "b"])
    later = again.where((F.col("doc_id") > F.col("doc")) | (F.col("start") > F.col("place")))
    spans = materialize(later.select("doc_id", "row", "start", (F.col("windows") + kind.size - 1).alias("length")), "spans")
    drop(found, graph, paths)
    return spans


def word_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 20, gram: int = 7) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of each row; kept has the remaining words, joined by a space, as bytes.

    Words are what ASCII white space parts, unchanged. A word goes if a window of ``size`` words that covers it also
    starts earlier: in a smaller doc_id, or in the same one at an earlier place; windows are judged on the input. Null
    texts have no words. Equal rows of one doc_id stand at the same places, so none is earlier. Rows without doc_id
    keep all and are nobody's source; an empty table gives an empty one.
    """
    own, kind = keyed(docs, id_col, text_col), Tokens(size, gram, word_tokens)
    lists = compare_stretches(own, kind, True, HELD).select("doc_id", F.concat("grams", "hot_grams").alias("grams"), "copies", "again")
    release(docs.sparkSession)
    met = own.join(lists, "doc_id", "left")
    spans = repeated_words(met, kind)
    release(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.binary())])

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, copies = b.column(1).to_numpy(), Copies(b.column(3), b.column(4))
            where: list[list[np.ndarray]] = [[] for _ in range(b.num_rows)]
            if copies.some:
                tokens, at = kind.hashed(b.column(2))
                for text, first, n, _, whole in stretches(tokens, at, kind):
                    keep = np.flatnonzero(copies.flags(text, whole))
                    bound = runs([text[keep]])
                    for lo, hi in zip(bound[:-1], bound[1:]):
                        i, mine = int(text[keep[lo]]), keep[lo:hi]
                        where[i].append((first[mine] - at[i], n[mine] + size - 1))
            rows = []
            for i, (t, *found) in enumerate(zip(texts(b.column(2)), *(lists_of(b.column(c)) for c in (5, 6, 7)))):
                words, mine = t.split(), found[0] == row[i]
                where[i].append((found[1][mine], found[2][mine]))
                starts, lengths = (np.concatenate(x) for x in zip(*where[i]))
                kept = [words[j] for j in np.flatnonzero(~covered(len(words), starts, lengths)).tolist()] if len(starts) else words
                rows.append((len(words), len(words) - len(kept), b" ".join(kept)))
            if rows:
                yield batch(schema, (b.column(0), *zip(*rows)))

    full = met.select("doc_id", "row", "text", "copies", "again").join(span_lists(spans), "doc_id", "left")
    full = full.select("doc_id", "row", "text", "copies", "again", "rows", "starts", "lengths")
    return full.mapInArrow(remove, "doc_id long, n_words long, n_removed long, kept binary")


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from :func:`word_dedup`."""
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
