"""The queries that apply each operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .debruijn import digest as word_digest
from .debruijn import word_dedup
from .decontaminate import contamination, digest
from .lines import digest as line_digest
from .lines import line_dedup
from .neighbours import nearest
from .packing import pack
from .privacy import digest as private_digest
from .privacy import find_private
from .simhash import simhash_groups
from .suffixes import digest as suffix_digest
from .suffixes import suffix_dedup
from .token_counts import section_tokens
from .toxicity import toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_digest(suffix_dedup(table(spark, sf_dir, "documents")))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return section_tokens(table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_digest(word_dedup(table(spark, sf_dir, "documents")))


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_digest(line_dedup(table(spark, sf_dir, "documents")))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private_digest(find_private(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_simhash": op2_simhash,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_toxicity": op4_toxicity,
    "op5_packing": op5_packing,
    "op6_token_counts": op6_token_counts,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_nearest": op8_nearest,
    "op9_line_dedup": op9_line_dedup,
    "op10_pii": op10_pii,
}

#: Words of the windows of each document, their first places, and what they cover. A word has no space, so a window's text
#: tells its words.
_WORDS = r"""with t as (select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
 lists as (select doc_id, list_transform(range(0, greatest(0, len(w) - 19)), lambda s: array_to_string(w[s + 1:s + 20], ' ')) as g from t),
 wins as (select doc_id, unnest(g) as g, unnest(range(0, len(g))) as s from lists),
 later as (select doc_id, s from (select doc_id, s, row_number() over (partition by g order by doc_id, s) as n from wins) r where n > 1),
 gone as (select distinct doc_id, s + k as p from later, (select unnest(range(0, 20)) as k) ks),
 each as (select doc_id, unnest(w) as x, unnest(range(0, len(w))) as p from t),
 kept as (select doc_id, string_agg(x, ' ' order by p) as text from each anti join gone using (doc_id, p) group by doc_id)
select t.doc_id, cast(len(w) as bigint) as n_words, coalesce(n, 0) as n_removed, sha256(coalesce(kept.text, '')) as kept_sha256
from t left join kept on t.doc_id = kept.doc_id left join (select doc_id, count(*) as n from gone group by doc_id) g on t.doc_id = g.doc_id"""

#: Windows of 50 bytes, put together from runs of 2, 4, 8, 16 and 32.
_BYTES = """with t as (select doc_id, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') as b from documents),
 each as (select doc_id, unnest(b) as x, unnest(range(0, len(b))) as p from t),
 two as (select *, x || lead(x, 1) over o as x2 from each window o as (partition by doc_id order by p)),
 four as (select *, x2 || lead(x2, 2) over o as x4 from two window o as (partition by doc_id order by p)),
 eight as (select *, x4 || lead(x4, 4) over o as x8 from four window o as (partition by doc_id order by p)),
 more as (select doc_id, p, x2, x8 || lead(x8, 8) over o as x16 from eight window o as (partition by doc_id order by p)),
 wins as (select doc_id, p as s, x16 || lead(x16, 16) over o || lead(x16, 32) over o || lead(x2, 48) over o as g from more window o as (partition by doc_id order by p)),
 later as (select doc_id, s from (select doc_id, s, min(doc_id) over (partition by g) as least from wins where g is not null) r where least < doc_id),
 gone as (select distinct doc_id, s + k as p from later, (select unnest(range(0, 50)) as k) ks),
 spans as (select doc_id, count(*) as n, count(*) filter (where before is null or before < p - 1) as runs from (select doc_id, p, lag(p) over (partition by doc_id order by p) as before from gone) r group by doc_id),
 kept as (select doc_id, string_agg(x, '' order by p) as bytes from each anti join gone using (doc_id, p) group by doc_id)
select t.doc_id, cast(len(b) as bigint) as n_bytes, coalesce(n, 0) as n_removed, coalesce(runs, 0) as n_spans, sha256(unhex(coalesce(kept.bytes, ''))) as kept_sha256
from t left join kept on t.doc_id = kept.doc_id left join spans on t.doc_id = spans.doc_id"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_LEAKS = rf"""with docs as (select doc_id, list_filter(string_split_regex({_LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from documents),
 items as (select item_id, list_filter(string_split_regex({_LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from benchmark),
 asked as (select distinct item_id, n, unnest(list_transform(range(0, len(w) - n + 1), lambda s: array_to_string(w[s + 1:s + n], ' '))) as g from (select *, least(len(w), 10) as n from items where len(w) > 0) i),
 lists as (select doc_id, n, list_transform(range(0, greatest(0, len(w) - n + 1)), lambda s: array_to_string(w[s + 1:s + n], ' ')) as g from docs, (select distinct n from asked) ns),
 wins as (select doc_id, n, unnest(g) as g, unnest(range(0, len(g))) as s from lists),
 hits as (select doc_id, s, wins.n, item_id from wins join asked on wins.n = asked.n and wins.g = asked.g),
 words as (select doc_id, count(distinct p) as n from (select doc_id, unnest(range(s, s + n)) as p from hits) h group by doc_id),
 named as (select doc_id, count(*) as n, string_agg(i, ',' order by i) as ids from (select distinct doc_id, cast(item_id as varchar) as i from hits where item_id is not null) h group by doc_id)
select docs.doc_id, cast(len(w) as bigint) as n_words, coalesce(words.n, 0) as n_hit, coalesce(named.n, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(words.n, 0) > 0 as contaminated
from docs left join words on docs.doc_id = words.doc_id left join named on docs.doc_id = named.doc_id"""

#: DuckDB SQL for the queries that SQL can express; the others are held against brute force in tests/llm.
ORACLE_SQL: dict[str, str] = {"op1_decontaminate": _LEAKS, "op3_suffix_dedup": _BYTES, "op7_substring_dedup": _WORDS}
