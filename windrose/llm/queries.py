"""The registered queries of this subpackage: each applies its operator to whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import automaton_dedup, bpe, conversation_trie, decontamination, importance, jaccard_join, language_codes, lexical_search, line_dedup, pii, quality_outliers, suffix_dedup, token_counts


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.suffix_dedup(documents(spark, sf_dir))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op4_automaton_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = automaton_dedup.automaton_dedup(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    out = bpe.round_trip(documents(spark, sf_dir).select("doc_id", "text"), path, public_tokenizers.PATTERN)
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(documents(spark, sf_dir), n=3, percent=90)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold a test item, with the items they hold."""
    found = decontamination.decontamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.groupBy("doc_id").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.min("distance").alias("distance"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", F.col("n_lines_removed").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op5_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.surrogates(documents(spark, sf_dir).select("doc_id", "text"), key="example key")


def op6_quality_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_outliers.quality_outliers(documents(spark, sf_dir).select("doc_id", "text", "lang", "source"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1 and toxic = 0")
    return importance.importance(documents(spark, sf_dir), good)


def op9_language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    out = language_codes.predict(docs, language_codes.fit(docs.where(~held)))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score", "ambiguous")


def regrown(turns: DataFrame) -> DataFrame:
    """Every conversation c begins with the first h turns of conversation c - c % 5 in place of its own; h is crc32(c) % 9."""
    ids = turns.groupBy("conv_id").agg(F.max("at").alias("n"))
    heads = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9
    given = ids.select(F.col("conv_id").alias("donor"), "n")
    plan = ids.select("conv_id", (F.col("conv_id") - F.col("conv_id") % 5).alias("donor"), heads.alias("h")).join(given, "donor", "left")
    plan = plan.select("conv_id", "donor", "h", F.least("h", F.coalesce("n", F.lit(0))).alias("got"))
    own = turns.join(plan, "conv_id").where("at > h").select("conv_id", (F.col("at") - F.col("h") + F.col("got")).alias("at"), "a", "b", "bytes")
    lent = turns.where("at < 9").withColumnRenamed("conv_id", "donor").join(plan, "donor").where("at <= h")
    return own.unionByName(lent.select("conv_id", "at", "a", "b", "bytes"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = conversation_trie.keyed(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return conversation_trie.trie(regrown(turns), turns.select("conv_id"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = token_counts.prefix_counts(docs, public_tokenizers.path("word_bpe_49k.json"))
    n = token_counts.total().cast("long")
    return out.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), n.alias("n_tokens"), (n > 2048).alias("over_limit"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = lexical_search.build(documents(spark, sf_dir))
    return lexical_search.search(index, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op3_line_dedup": LINES_SQL, "op11_prefix_trie": TRIE_SQL, "op13_lexical_search": SEARCH_SQL}


LINES_SQL = r"""
with line as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as x, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as i from documents),
three as (select doc_id, i, x, lead(x) over w as y, lead(x, 2) over w as z from line window w as (partition by doc_id order by i)),
ranked as (select doc_id, i, row_number() over (partition by x, y, z order by doc_id, i) as n from three where z is not null and regexp_matches(x || y || z, '[^\x20\x09-\x0D]')),
gone as (select distinct doc_id, i + k as i from ranked, (select unnest([0, 1, 2]) as k) where n > 1)
select line.doc_id, count(gone.i) as n_removed, sha256(coalesce(string_agg(line.x, chr(10) order by line.i) filter (where gone.i is null), '')) as kept_sha256
from line left join gone on line.doc_id = gone.doc_id and line.i = gone.i group by line.doc_id
"""

#: A node is the list of its first turns; crc32 goes bit by bit over the digits of the id.
TRIE_SQL = """
with recursive ranked as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as place
  from conversations where conv_id is not null),
own as (select conv_id, list({'role': role, 'text': text} order by place) as turns from ranked group by conv_id),
headed as (select conv_id, turns, (4294967295 - list_reduce(
  flatten(list_transform(range(1, length(cast(conv_id as varchar)) + 1), lambda i: [cast(ascii(substr(cast(conv_id as varchar), i, 1)) as bigint), 0, 0, 0, 0, 0, 0, 0])),
  lambda s, x: (xor(s, x) >> 1) * (1 - (xor(s, x) & 1)) + xor(xor(s, x) >> 1, 3988292384) * (xor(s, x) & 1), cast(4294967295 as bigint))) % 9 as h from own),
built as (select c.conv_id, list_concat(coalesce(list_slice(d.turns, 1, c.h), []), list_slice(c.turns, c.h + 1, length(c.turns))) as turns
  from headed c left join headed d on d.conv_id = c.conv_id - c.conv_id % 5),
member as (select conv_id, list_slice(turns, 1, depth) as node, depth, length(turns) = depth as ends from (select conv_id, turns, unnest(range(0, length(turns) + 1)) as depth from built)),
node as (select node, depth, min(conv_id) as conv_id, count(*) as n_convs, sha256(coalesce(string_agg(conv_id, ',' order by conv_id) filter (where ends), '')) as ends_sha256 from member group by node, depth),
kids as (select list_slice(node, 1, depth - 1) as node, depth - 1 as depth, count(*) as n_children from node where depth > 0 group by 1, 2),
known as (select n.*, coalesce(k.n_children, 0) as n_children, case when n.depth = 0 then 0 else (n.n_convs - 1) * strlen(n.node[n.depth].text) end as saved from node n left join kids k on n.node = k.node and n.depth = k.depth),
below as (select list_slice(node, 1, up) as node, up as depth, count(*) filter (where n_children = 0) as n_leaves, sum(saved) as saved_tokens from (select *, unnest(range(0, depth + 1)) as up from known) group by 1, 2)
select n.conv_id, n.depth, p.conv_id as parent_conv_id, n.n_convs, n.n_children, b.n_leaves, cast(b.saved_tokens as bigint) as saved_tokens, n.ends_sha256
from known n join below b on n.node = b.node and n.depth = b.depth left join known p on p.depth = n.depth - 1 and p.node = list_slice(n.node, 1, n.depth - 1)
"""

SEARCH_SQL = r"""
with word as (select *, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from (select true as doc, doc_id as id, text from documents union all select false, item_id, text from benchmark)),
tf as (select id, term, count(*) as tf from word where doc group by all),
size as (select id, sum(tf) as n from tf group by id),
corpus as (select count(*) as n_docs, cast(sum(n) as bigint) as n_terms from size),
weight as (select term, cast(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) as bigint) as w from tf, corpus group by term),
part as (select id, term, (1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * cast(n as bigint) * n_docs) // n_terms)) as s from tf join size using (id), corpus),
score as (select q.id as item_id, p.id as doc_id, cast(sum(w * s) as bigint) as score from word q join weight using (term) join part p using (term) where not q.doc group by all having sum(w * s) > 0)
select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as int) as rank, doc_id, score from score
qualify row_number() over (partition by item_id order by score desc, doc_id) <= 20
"""


QUERIES = (
    op1_decontamination, op2_suffix_dedup, op3_line_dedup, op4_automaton_dedup, op5_surrogates,
    op6_quality_outliers, op7_bpe, op8_importance, op9_language_codes, op10_jaccard_join,
    op11_prefix_trie, op12_token_counts, op13_lexical_search,
)
