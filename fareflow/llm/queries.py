"""Queries of the operators of this subpackage, one thin query per operator
(and one more that shows operator 3 on web pages)."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_codec, conversation_trie, hnsw, html_extract, jaccard_join, language_id, packing, pii, spotsigs, tier_packing, token_counts, toxicity, word_runs
from .common import scratch_table, table


def vocabulary(name: str) -> str:
    """Place of a public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs every document into sequences of at most 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document under the 32k piece model."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return pii.find(table(spark, sf_dir, "documents"))


def op8_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes and decodes every document with the 49k word-end vocabulary."""
    return bpe_codec.encode_digest(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op9_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document, its edited text and its neighbour."""
    return spotsigs.fingerprints(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, learned from the labels that are not held out."""
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, from its text, its declared language and its source (as host)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return language_id.identify(docs).drop("text")


def language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of the main text of every page, from its text, markup, address and host."""
    pages = language_id.page_evidence(table(spark, sf_dir, "pages"))
    marks = pages.select("page_id", "markup_lang", "suffix_lang", "host", "domain", "url", "html")
    texts = html_extract.extract(marks, keep=("markup_lang", "suffix_lang", "host", "domain"))
    found = language_id.identify(texts, declared_col="markup_lang", host_col="host", parent_col="domain", suffix_col="suffix_lang")
    return found.drop("text", "n_chars")


def op4_hnsw_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest neighbours of every hundredth vector."""
    return hnsw.nearest(table(spark, sf_dir, "embeddings"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document (five-word shingles, Jaccard 0.8 or more)."""
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents")).drop("is_first")


def repeat_words(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of a document as ``op11`` takes them: those of a tenth of
    all documents become periodic from some word on.  A null id counts as the
    empty string."""
    h, n = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words of every document."""
    found = word_runs.detect(table(spark, sf_dir, "documents"), prepare=repeat_words)
    longest = F.expr("array_max(transform(runs, r -> struct(r.length AS length, -r.start AS start, -r.period AS period)))")
    listed = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    best = found.select("*", longest.alias("best"), listed.alias("listed"))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"), F.expr("best.length * 1000 div -best.period").alias("exponent_milli"),
        F.sha2("listed", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefix trie of all conversations, each rebuilt on the first turns of the first of its hundred."""
    own = scratch_table(conversation_trie.sequences(table(spark, sf_dir, "conversations")))
    heads = own.where("conv_id % 100 = 0").select(F.col("conv_id").alias("base"), F.slice("codes", 1, 5).alias("head"))
    given = own.select("*", F.expr("conv_id - conv_id % 100").alias("base"), F.expr("int(crc32(string(conv_id)) % 6)").alias("h"))
    rebuilt = given.join(heads, "base", "left").select(
        "conv_id", F.expr("concat(slice(coalesce(head, array()), 1, h), slice(codes, h + 1, size(codes)))").alias("codes"))
    return conversation_trie.trie(rebuilt)


def op13_tier_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs every document into sequences of up to 1024 tokens, all full up to a power of two."""
    return tier_packing.pack_tiers(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_html_extraction": op2_html_extraction,
    "op3_language_id": op3_language_id,
    "language_id_pages": language_id_pages,
    "op4_hnsw_search": op4_hnsw_search,
    "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
    "op6_token_counts": op6_token_counts,
    "op7_personal_data": op7_personal_data,
    "op8_bpe_codec": op8_bpe_codec,
    "op9_spotsigs": op9_spotsigs,
    "op10_toxicity": op10_toxicity,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_tier_packing": op13_tier_packing,
}

#: DuckDB SQL of the queries that SQL can express on whole tables.
ORACLES: dict[str, str] = {
    "op5_ngram_jaccard_join": r"""
with recursive t as (select doc_id, md5(coalesce(text, '')) as text_md5, coalesce(text, '') as text from documents),
w as (select distinct text_md5, regexp_extract_all(lower(text), '[0-9a-z\x{80}-\x{10FFFF}]+') as w from t),
s as (select distinct text_md5, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                            when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as g from w),
n as (select text_md5, count(*) as size from s group by text_md5),
both_ as (select a.text_md5 as x, b.text_md5 as y, count(*) as k from s a join s b on a.g = b.g and a.text_md5 <> b.text_md5 group by a.text_md5, b.text_md5),
near as (select x, y from both_ join n a on a.text_md5 = x join n b on b.text_md5 = y where 10 * k >= 8 * (a.size + b.size - k)),
reach(x, y) as (select distinct text_md5, text_md5 from t union select r.x, l.y from reach r join near l on l.x = r.y),
named as (select r.x, min(t.doc_id) as class_id from reach r join t on t.text_md5 = r.y group by r.x),
copies as (select text_md5, count(*) as c from t group by text_md5),
linked as (select x, sum(c) as c from near join copies on text_md5 = y group by x)
select t.doc_id, named.class_id, cast(copies.c - 1 + coalesce(linked.c, 0) as bigint) as n_links, t.text_md5
from t join named on named.x = t.text_md5 join copies using (text_md5) left join linked on linked.x = t.text_md5
""",
}
