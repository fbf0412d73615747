"""The registered queries of the training-data operators and, where SQL can express them, their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import new_path, table
from .chat import format_chats
from .embedding_dedup import near_vectors
from .exact_dedup import exact_groups
from .language import identify
from .mixing import mixture
from .ngram_join import similarity_join
from .packing import pack_documents
from .pii import KINDS, find_personal_data
from .toxicity import score_toxicity
from .warc import checked_records, write_warc


def tokenizer() -> str:
    """The vocabulary file that packing uses; another one can be named to the operators themselves."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(table(spark, sf_dir, "documents"))
    spell = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    counts = [F.size(F.filter("base", _is_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    added = (F.size("spans") - F.size("base")).cast("long").alias("n_added")
    return found.select("doc_id", *counts, F.sha2(spell(F.col("base")).cast("binary"), 256).alias("base_sha256"), spell(F.col("spans")).alias("spans"), added)


def _is_kind(kind: str):
    return lambda s: s.kind == kind


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))
    found = identify(docs, ~held_out & F.col("doc_id").isNotNull())
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    number = lambda c: F.nullif(F.substring_index(c, ":", -1), F.lit("null")).cast("long")
    return checked_records(spark, path).select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer())


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_join(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_chat_format": op1_chat_format,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_pii": op3_pii,
    "op4_language_id": op4_language_id,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_toxicity": op6_toxicity,
    "op7_warc": op7_warc,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
    "op9_mixing": op9_mixing,
}

ORACLE = {
    "op2_exact_dedup": """
        select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size,
               doc_id is not distinct from max(doc_id) over same as kept, sha256(coalesce(text, '')) as text_sha256
        from documents window same as (partition by coalesce(text, ''))""",
    "op5_embedding_dedup": """
        with recursive v as (select vec_id, label, embedding::double[] as e from embeddings where label is not null),
        l as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id
              where list_cosine_similarity(a.e, b.e) >= 0.98),
        r(n, c) as (select vec_id, vec_id from embeddings union select l.b, r.c from r join l on l.a = r.n),
        g as (select n, min(c) as c from r group by n), k as (select a, count(*) as links from l group by a)
        select vec_id, coalesce(links, 0)::bigint as n_links, c as component_id, vec_id = c as kept
        from embeddings join g on n = vec_id left join k on a = vec_id""",
    "op7_warc": """
        with p as (select page_id, coalesce(html, '') as body from pages),
        f as (select page_id, body, sha1(body) || '0' as h, min(page_id) over (partition by body) as first from p)
        select page_id, strlen(body)::bigint as payload_bytes,
               array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   (((('0x' || substr(h, (5 * i // 4 + 1)::bigint, 2))::bigint >> (3 - 5 * i % 4)) & 31) + 1)::bigint, 1)), '') as payload_digest,
               case when page_id = first then 'response' else 'revisit' end as record_type,
               case when page_id <> first then first end as refers_to
        from f""",
    "op10_ngram_jaccard_join": r"""
        with recursive w as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '') as t from documents),
        s as (select doc_id, list_distinct(list_transform(range(1, greatest(len(t) - 4, 1)::bigint + 1),
                  lambda i: array_to_string(t[i : i + 4], ' '))) as g from w where len(t) > 0),
        u as (select doc_id, len(g) as n, unnest(g) as x from s),
        c as (select a.doc_id as a, b.doc_id as b, count(*) as k, any_value(a.n) as m, any_value(b.n) as n
              from u a join u b on a.x = b.x and a.doc_id <> b.doc_id group by 1, 2),
        l as (select a, b, k = m and k = n as same from c where k >= 0.8 * (m + n - k)),
        d as (select doc_id, coalesce(min(b) filter (same), doc_id) as other, count(b) as links, count(b) filter (same) as copies
              from documents left join l on a = doc_id group by doc_id),
        r(n, c) as (select doc_id, doc_id from documents union select l.b, r.c from r join l on l.a = r.n),
        h as (select n, min(c) as c from r group by n)
        select doc_id, least(doc_id, other) as class_id, (copies + 1)::bigint as class_size, links::bigint as n_links,
               c as group_id, doc_id = c as kept
        from d join h on n = doc_id""",
}
