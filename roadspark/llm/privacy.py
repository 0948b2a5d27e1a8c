"""Personal data and the terms that reveal it, in DataFrame functions only.

Base spans come from patterns. Corpus co-occurrence then tells how strongly a word discloses a protected value near
which it stands; words beyond the thresholds become spans of their own, to be generalised or removed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import materialize

#: The kinds in the order in which they are listed, and their patterns. Runs are possessive, and a match
#: starts where its run starts or the match before ended, so that long runs take time in proportion to their length;
#: neither changes what is found.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without a match of this has none of the kind; it is quick to look for.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
#: The kind of the method's own spans, listed last.
TERM = "term"
#: Code points on either side of a value in which its terms stand, and the least letters of a term.
CONTEXT, LETTERS = 120, 4
#: A term discloses a value if so many of its occurrences stand near it, if they are this share of all its
#: occurrences in the corpus, and if their pointwise mutual information has this many bits.
SUPPORT, SHARE, BITS = 3, 0.5, 8.0
#: From this share on a term is removed instead of generalised: it hardly occurs elsewhere.
REMOVE = 0.9

WORD = rf"\p{{L}}{{{LETTERS},}}"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda s, x: s + x)


def sums_before(values: Column) -> Column:
    """For each value the sum of those before it; in chunks, so that n values take n to the power 1.5 steps."""

    def of_chunks(chunks: Column) -> Column:
        return let(
            F.transform(chunks, total),
            lambda sums: F.flatten(
                F.transform(
                    chunks,
                    lambda chunk, c: let(total(F.slice(sums, 1, c)), lambda base: F.transform(chunk, lambda _, i: base + total(F.slice(chunk, 1, i)))),
                )
            ),
        )

    def of(v: Column) -> Column:
        step = F.ceil(F.sqrt(F.size(v))).cast("int")
        chunks = let(step, lambda b: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / b).cast("int")), lambda c: F.slice(v, c * b + 1, b)))
        return F.when(F.size(v) > 0, let(chunks, of_chunks)).otherwise(F.array().cast("array<bigint>"))

    return let(values, of)


MATCHES = "array<struct<start:bigint,end:bigint,said:string>>"


def matches(text: Column, pattern: str) -> Column:
    """Leftmost matches that do not overlap, with their places in code points; end exclusive.

    What lies between the matches is what splitting at them leaves, so lengths add up to places.
    """

    def of(said: Column, gaps: Column) -> Column:
        steps = F.zip_with(F.slice(gaps, 1, F.size(said)), said, lambda g, m: (F.length(g) + F.length(m)).cast("long"))
        ends = F.zip_with(sums_before(steps), steps, lambda a, b: a + b)
        return F.zip_with(ends, said, lambda e, m: F.struct((e - F.length(m)).alias("start"), e.alias("end"), m.alias("said")))

    found = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda said: F.when(F.size(said) > 0, let(F.split(text, pattern, -1), lambda gaps: of(said, gaps))))
    return F.coalesce(found, F.array().cast(MATCHES))


def digits(said: Column) -> Column:
    return F.regexp_replace(said, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether the digits pass: every second from the right doubled, 9 taken off beyond 9, the sum divisible by 10."""
    each = F.transform(
        F.sequence(F.lit(1), F.length(number)),
        lambda i: let(F.substr(number, i, F.lit(1)).cast("int"), lambda d: F.when((F.length(number) - i) % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))),
    )
    return F.aggregate(each, F.lit(0), lambda s, d: s + d) % 10 == 0


def valid(kind: str, said: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(said, r"\."), lambda p: F.regexp_replace(p, "^0+", "").rlike("^([0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return let(digits(said), lambda d: F.length(d).between(12, 19) & F.when(F.length(d).between(12, 19), luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(digits(said)).between(9, 15)
    return F.lit(True)


SPANS = "array<struct<start:bigint,place:int,end:bigint,kind:string,said:string>>"


def base_spans(text: Column, kind: str) -> Column:
    place = KINDS.index(kind)
    hit = text.contains("@") if kind == "email" else text.rlike(HINTS[kind])
    kept = F.filter(matches(text, PATTERNS[kind]), lambda m: valid(kind, m["said"]))
    made = F.transform(kept, lambda m: F.struct(m["start"].alias("start"), F.lit(place).alias("place"), m["end"].alias("end"), F.lit(kind).alias("kind"), m["said"].alias("said")))
    return F.when(hit, made).otherwise(F.array().cast(SPANS)).cast(SPANS)


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def with_base(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, row, tag, base, near, text, as_is): the base spans in order, the padded text around each, the text if it
    has some, and a hash of the text. tag tells rows apart once the table is stored."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    own = own.select("doc_id", F.xxhash64("text").alias("row"), "text", F.array_sort(F.concat(*(base_spans(F.col("text"), k) for k in KINDS))).alias("base"))

    def around(s: Column) -> Column:
        first = F.greatest(s["start"] - CONTEXT, F.lit(0))
        said = F.concat(F.when(s["start"] <= CONTEXT, " ").otherwise(""), F.substr("text", (first + 1).cast("int"), (s["end"] - first + CONTEXT).cast("int")))
        said = F.concat(said, F.when(s["end"] + CONTEXT >= F.length("text"), " ").otherwise(""))
        return F.struct((first - F.when(s["start"] <= CONTEXT, 1).otherwise(0)).alias("from"), said.alias("said"))

    found = F.when(F.size("base") > 0, F.col("text")).alias("text")
    return own.select("doc_id", "row", F.monotonically_increasing_id().alias("tag"), "base", F.transform("base", around).alias("near"), found, F.sha2("text", 256).alias("as_is"))


def terms_near(base: DataFrame) -> DataFrame:
    """(tag, value, term, start) for each whole word that stands near a value but not within it; once for each value,
    though several of its occurrences are near."""
    each = base.where("size(base) > 0").select("tag", F.inline(F.arrays_zip("base", "near")))
    each = each.select("tag", F.struct(F.col("base.kind"), F.lower("base.said").alias("said")).alias("value"), F.col("base.start").alias("a"), F.col("base.end").alias("b"), "near")
    words = matches(F.col("near.said"), rf"(?<=\P{{L}}){WORD}(?=\P{{L}})")  # places are those of the text as it stands
    each = each.select("tag", "value", "a", "b", F.col("near.from").alias("from"), F.explode(words).alias("w"))
    each = each.select("tag", "value", "a", "b", F.lower("w.said").alias("term"), (F.col("from") + F.col("w.start")).alias("start"), (F.col("from") + F.col("w.end")).alias("end"))
    return each.where("end <= a or start >= b").select("tag", "value", "term", "start").distinct()


def disclosures(docs: DataFrame, near: DataFrame, text_col: str, support: int, share: float, bits: float) -> DataFrame:
    """(value, term, share, bits) of the terms that disclose a value, from counts over the whole corpus.

    share: of all occurrences of the term, those near the value, the probability of the value given the term. bits:
    the pointwise mutual information of the two, the logarithm of how much likelier the value is near the term.
    """
    joint = near.groupBy("value", "term").agg(F.count(F.lit(1)).alias("n_both"))
    of_value = joint.groupBy("value").agg(F.sum("n_both").alias("n_value"))
    words = docs.select(F.explode(F.transform(F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(WORD), F.lit(0)), F.lower)).alias("term"))
    of_term = words.groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))
    often = joint.where(F.col("n_both") >= support)
    met = often.join(of_term, "term").withColumn("share", F.col("n_both") / F.col("n_term"))
    met = materialize(met.where(F.col("share") >= share).join(of_value, "value"), "disclosures")
    everything = docs.select(F.sum(F.size(F.split(F.col(text_col).cast("string"), r"\P{L}+"))).alias("n_all"))
    met = met.crossJoin(everything)  # one row
    met = met.withColumn("bits", F.log2(F.col("share") * F.col("n_all") / F.col("n_value")))
    return met.where(F.col("bits") >= bits).select("value", "term", "share", "bits")


def occurrences(docs: DataFrame, id_col: str, text_col: str, acts: DataFrame) -> DataFrame:
    """(d, r, terms, said) of each text that holds a term of ``acts`` (term, act): a span for each whole word that is
    one, its said being the act, and the text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).select("doc_id", F.xxhash64("text").alias("row"), "text")
    said = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.lower))
    held = own.select("doc_id", "row", F.explode(said).alias("term")).join(acts, "term")
    held = held.groupBy(F.col("doc_id").alias("d"), F.col("row").alias("r")).agg(F.map_from_entries(F.collect_set(F.struct("term", "act"))).alias("acts"))
    met = own.join(held, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("row") == F.col("r")))
    words = F.filter(matches(F.col("text"), WORD), lambda w: F.map_contains_key("acts", F.lower(w["said"])))
    spans = F.transform(words, lambda w: F.struct(w["start"].alias("start"), F.lit(len(KINDS)).alias("place"), w["end"].alias("end"), F.lit(TERM).alias("kind"), F.col("acts")[F.lower(w["said"])].alias("said")))
    return met.select("d", "r", spans.alias("terms"), F.col("text").alias("said")).dropDuplicates(["d", "r"])  # repeated rows


def find_private(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    support: int = SUPPORT,
    share: float = SHARE,
    bits: float = BITS,
) -> DataFrame:
    """(doc_id, row, base, spans, clean, as_is) of each row: base spans, and all spans with the method's terms, in order.

    A span has start, place (of its kind in the list), end, kind and said, in code points, end exclusive; a term's
    said is what to do with it: generalise or remove. A word that discloses a value near which it stands is a term at
    all its occurrences in all texts, and removed if one of its values asks for that; one that lies in a base span is
    none. Words are found in the text as it stands and lowered one by one, so that places hold where lower case is
    longer; an occurrence near a value counts once, though the value stands on both sides of it. clean is the text
    after the actions, null where nothing changes; as_is a hash of the text. Null texts are empty and have no spans;
    repeated rows have the same spans and count each; rows without doc_id are searched like any other; an empty table
    gives an empty one. Only the two named columns are read, so others may have any name.
    """
    base = materialize(with_base(docs, id_col, text_col), "base")
    found = materialize(disclosures(docs, terms_near(base), text_col, support, share, bits), "terms")
    act = F.when(F.col("share") >= REMOVE, "remove").otherwise("generalise")
    acts = materialize(found.groupBy("term").agg(F.max(act).alias("act")), "acts")
    terms = occurrences(docs, id_col, text_col, acts)
    met = base.drop("tag", "near").join(terms, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("row") == F.col("r")), "left")
    clear = F.filter(F.coalesce("terms", F.array().cast(SPANS)), lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    met = met.select("doc_id", "row", "base", F.array_sort(F.concat("base", clear)).alias("spans"), F.coalesce("text", "said").alias("text"), "as_is")
    clean = F.when(F.size("spans") > 0, sanitised(F.col("text"), F.col("spans")))
    return met.select("doc_id", "row", "base", "spans", clean.alias("clean"), "as_is")


def sanitised(text: Column, spans: Column) -> Column:
    """The text with base spans replaced by their kinds, terms generalised to [TERM] or removed; spans in order."""
    state = "struct<at:bigint,out:array<string>>"
    first = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out")).cast(state)

    def put(done: Column, s: Column) -> Column:
        mark = F.when(s["said"] == "remove", "").otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
        mark = F.when(s["kind"] == TERM, mark).otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
        gap = F.substr(text, (done["at"] + 1).cast("int"), F.greatest(s["start"] - done["at"], F.lit(0)).cast("int"))
        more = F.when(s["start"] >= done["at"], F.concat(gap, mark)).otherwise("")  # what overlaps is gone already
        return F.struct(F.greatest(done["at"], s["end"]).alias("at"), F.array_append(done["out"], more).alias("out"))

    return F.aggregate(spans, first, put, lambda d: F.concat(F.array_join(d["out"], ""), F.substr(text, (d["at"] + 1).cast("int"), F.length(text))))


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from :func:`find_private`, what is done with each term, and a hash of the cleaned text."""

    def of_kind(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [of_kind(k) for k in KINDS]
    acts = F.array_join(F.transform(F.filter("spans", lambda s: s["kind"] == TERM), lambda s: s["said"]), ",")
    clean = F.coalesce(F.sha2("clean", 256), F.col("as_is"))
    return found.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), acts.alias("actions"), clean.alias("clean_sha256"))
