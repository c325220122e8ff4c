"""The registered queries of this package: thin digests of the operators' results."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annoweave.llm import (alignment, counts, encode, extract, fingerprints, language, lines, mixing, negatives,
                           pii, search, similar, urls)
from annoweave.llm.common import table
from annoweave.llm.pieces import Model, read_model

#: The vocabulary file of op1 and op4, read on the driver and broadcast.
MODEL_PATH = os.environ.get("PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
#: The byte-level vocabulary of op13, next to the one above.
BYTE_LEVEL_PATH = os.environ.get("BYTE_LEVEL_MODEL", "/opt/tokenizers/byte_bpe_50k.json")


def model() -> Model:
    return read_model(MODEL_PATH)


def coded(docs: DataFrame) -> DataFrame:
    """doc_id, ids, n_tokens, and whether decoding the ids gives back the text."""
    ids = encode.encode(docs, model(), check=True)
    return ids.select("doc_id", "ids", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"),
                      "round_trip")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coded(table(spark, sf_dir, "documents"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar.join_similar(table(spark, sf_dir, "documents"), width=4, percent=85)


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_next(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.count_tokens(table(spark, sf_dir, "documents"), model())


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = lines.without_repeats(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_deleted", F.length("text").cast("long").alias("n_chars_kept"),
                       F.sha2("text", 256).alias("text_sha256"))


def op7_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = search.integer_vectors(table(spark, sf_dir, "embeddings"))
    return search.top_k(vectors.where("vec_id % 20 = 0"), vectors)


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    own = F.col("sources")[0]
    return mixed.select("doc_id", "size", own["size"].cast("long").alias("source_size"),
                        own["target"].alias("target"), (F.col("size") * F.col("copies")).alias("taken"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents")))


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat_ws(" ", "blocks")
    return extract.extract(table(spark, sf_dir, "pages")).select(
        "page_id", "url", text.alias("text"), F.length(text).cast("long").alias("n_chars"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = negatives.with_moved_labels(negatives.labelled_vectors(table(spark, sf_dir, "embeddings")))
    return negatives.mine(rows.where("vec_id % 50 = 0"), rows)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), alignment.read_encoders(BYTE_LEVEL_PATH, MODEL_PATH))


QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_fingerprints": op3_fingerprints,
    "op4_token_counts": op4_token_counts,
    "op5_language_id": op5_language_id,
    "op6_line_dedup": op6_line_dedup,
    "op7_top_k_search": op7_top_k_search,
    "op8_mix_sources": op8_mix_sources,
    "op9_url_filter": op9_url_filter,
    "op10_pii": op10_pii,
    "op11_html_extraction": op11_html_extraction,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_token_alignment": op13_token_alignment,
}

SQL: dict[str, str] = {
    "op6_line_dedup": r"""
        with l as (
            select doc_id, unnest(string_split(text, chr(10))) line,
                   generate_subscripts(string_split(text, chr(10)), 1) pos
            from documents where text is not null),
        n as (
            select *, lead(line, 1) over w l1, lead(line, 2) over w l2,
                   len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) >= 3 long_line
            from l window w as (partition by doc_id order by pos)),
        r as (
            select *, row_number() over (partition by line order by doc_id, pos) > 1 later,
                   l2 is not null and row_number() over (partition by line, l1, l2
                                                         order by doc_id, pos) > 1 run
            from n),
        d as (
            select *, later and long_line or run or coalesce(lag(run, 1) over w, false)
                   or coalesce(lag(run, 2) over w, false) gone
            from r window w as (partition by doc_id order by pos)),
        t as (
            select doc_id, count(*) n_lines, count(*) filter (gone) n_deleted,
                   coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '') kept
            from d group by doc_id)
        select doc_id, coalesce(n_lines, 0) n_lines, coalesce(n_deleted, 0) n_deleted,
               length(kept) n_chars_kept, sha256(kept) text_sha256
        from documents left join t using (doc_id)""",
    "op7_top_k_search": """
        with v as (
            select vec_id, list_transform(embedding, lambda x: floor(64 * cast(x as double))) v
            from embeddings
            where embedding is not null and len(list_filter(embedding,
                  lambda x: x is null or not isfinite(x))) = 0),
        scored as (
            select q.vec_id query_id, c.vec_id vec_id,
                   cast(list_inner_product(q.v, c.v) as bigint) score
            from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0),
        ranked as (
            select *, cast(row_number() over (partition by query_id order by score desc, vec_id)
                           as integer) rank from scored)
        select query_id, rank, vec_id, score from ranked where rank <= 20""",
    "op12_hard_negatives": """
        with v as (
            select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end l,
                   list_transform(embedding, lambda x: floor(256 * cast(x as double))) v
            from embeddings
            where label is not null and embedding is not null and len(list_filter(embedding,
                  lambda x: x is null or not isfinite(x))) = 0),
        scored as (
            select a.vec_id anchor_id, c.vec_id vec_id, a.l = c.l same,
                   cast(list_inner_product(a.v, c.v) as bigint) score
            from v a join v c on a.vec_id <> c.vec_id where a.vec_id % 50 = 0),
        p as (
            select anchor_id, vec_id positive_id, score positive_score from scored where same
            qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5),
        n as (
            select anchor_id, positive_id, vec_id negative_id, positive_score, score negative_score,
                   cast(row_number() over (partition by anchor_id, positive_id
                                           order by score desc, vec_id) as integer) rank
            from p join scored using (anchor_id)
            where not same and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score)
        select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from n where rank <= 3""",
}
