"""The registered queries of the training-data operators: thin digests of each operator's rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import collocations, decontaminate, filter_audit, jaccard_join, language_id, nearest, pii, quality, sentencepiece, suffix_dedup, token_store, toxicity, url_filter
from weftgraph.llm._tables import shared_dir, stored

#: Vocabulary files of the public tokenizers.
PIECES, WORD_BPE = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")


def text_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of so many rows at most in this session: 10,000 whole texts, with their ids or sets, fill a worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(id_col: str, modulus: int) -> Column:
    return F.crc32(F.col(id_col).cast("string")) % modulus


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text as piece ids, and whether they decode to it."""
    pieces = sentencepiece.load_pieces(PIECES)
    out = sentencepiece.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), pieces, decode_to="decoded")
    same = F.coalesce("decoded", F.lit("")) == F.coalesce("text", F.lit(""))
    return out.select("doc_id", F.size("ids").cast("bigint").alias("n_pieces"), same.alias("round_trip"), "ids")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = remainder("doc_id", 4) == 2
    model = stored(language_id.profiles(docs.where(~held)), "profiles")
    out = language_id.identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    token_store.write_tokens(table(spark, sf_dir, "documents"), path, WORD_BPE, end_id=2)
    return token_store.read_tokens(spark, path, with_ids=False)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), length=100).drop("kept")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"), words=4, percent=85)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents"))
    base = F.expr("filter(spans, s -> s.kind in ('email', 'ip', 'card', 'phone'))")
    out = found.select("doc_id", "spans", base.alias("base"))
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in ("email", "ip", "card", "phone")]
    private = F.expr("cast(size(filter(spans, s -> s.kind in ('email', 'ip', 'card', 'phone', 'secret'))) as bigint)")
    return out.select("doc_id", *counts, F.sha2(F.expr(pii.listed("base")), 256).alias("base_sha256"), F.expr(pii.listed("spans")).alias("spans"), private.alias("n_private"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest.nearest(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.train(docs, labels.where(remainder("doc_id", 5) != 0))
    out = quality.score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.where(remainder("doc_id", 3) != 1))
    out = toxicity.score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "nearest")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_sentencepiece, op2_language_id, op3_token_store, op4_suffix_dedup, op5_jaccard_join, op6_pii, op7_decontaminate, op8_nearest, op9_url_filter, op10_quality, op11_collocations, op12_toxicity, op13_filter_audit)
}

ORACLES: dict[str, str] = {
    "op8_nearest": """
        with v as (select vec_id, cast(embedding as double[]) as e from embeddings
                   where vec_id is not null and len(embedding) > 0
                     and len([x for x in embedding if x is null or not isfinite(x)]) = 0
                     and len([x for x in embedding if x <> 0]) > 0),
        s as (select q.vec_id as query_id, c.vec_id as vec_id, list_inner_product(q.e, c.e) as score
              from v q join v c on q.vec_id <> c.vec_id and len(q.e) = len(c.e) where q.vec_id % 20 = 0),
        r as (select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from s)
        select query_id, rank, vec_id, score from r where rank <= 20""",
    "op11_collocations": r"""
        with d as (select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
        p as (select lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) as piece from d),
        w as (select lang, [x for x in string_split_regex(piece, '[\x20\x09]+') if x <> ''] as ws from p),
        n as (select lang, sum(len(ws)) as n from w group by 1),
        s as (select lang, ws, unnest(range(1, 5)) as m from w),
        g as (select lang, m, ws, unnest(range(1, len(ws) - m + 2)) as i from s),
        f as (select lang, array_to_string(ws[i:i + m - 1], ' ') as phrase, any_value(ws[i:i + m - 1]) as words, any_value(m) as m, count(*) as f from g group by 1, 2 having count(*) >= 30),
        c as (select *, unnest(range(1, m)) as k from f where m > 1),
        x as (select c.lang, c.phrase, c.words, c.f as a, k, l.f as l, r.f as r, cast(c.f as hugeint) * 2000000 // (cast(l.f as hugeint) + r.f) as score
              from c join f l on l.lang = c.lang and l.phrase = array_to_string(c.words[1:k], ' ') join f r on r.lang = c.lang and r.phrase = array_to_string(c.words[k + 1:], ' ')),
        b as (select *, row_number() over (partition by lang, phrase order by score, k) as place from x),
        i as (select lang, m, words, f, unnest(range(2, m)) as size from f where m > 2),
        j as (select lang, words, f, size, unnest(range(1, m - size + 2)) as b from i),
        h as (select lang, array_to_string(words[b:b + size - 1], ' ') as phrase, max(f) as longer from j group by 1, 2),
        k as (select b.*, row_number() over (partition by b.lang order by score desc, a desc, b.phrase) as rank from b left join h on h.lang = b.lang and h.phrase = b.phrase
              where place = 1 and (longer is null or cast(longer as hugeint) * 100 < cast(a as hugeint) * 80))
        select k.lang, rank, k.phrase, a, l, r, cast(n.n as bigint) as n, cast(score as bigint) as score from k join n on n.lang = k.lang where rank <= 2000""",
    "op13_filter_audit": r"""
        with d as (select coalesce(source, '') as part, doc_id, coalesce(text, '') as t from documents),
        w as (select *, [x for x in string_split_regex(t, '[\x20\x09-\x0D]+') if x <> ''] as ws from d),
        m as (select part, doc_id, cast(len(ws) < 200 as int) + 2 * cast(100 * len(list_distinct(ws)) < 50 * len(ws) as int)
                + 4 * cast(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) as int) + 8 * cast(regexp_matches(t, '[#$%&*|]') as int)
                + 16 * cast(doc_id > min(doc_id) over (partition by t) as int) as mask from w),
        c as (select part, mask, count(*) as n, count(*) filter (l.quality = 1) as good, count(*) filter (l.toxic = 1) as toxic
              from m left join labels l using (doc_id) group by 1, 2),
        f as (select * from (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) f(x, bit)),
        o as (select a.x || b.x || c.x || d.x || e.x as filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] as bits
              from f a, f b, f c, f d, f e where a.bit + b.bit + c.bit + d.bit + e.bit = 31 and len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
        s as (select filter_order, step, bits[step] as bit, cast(coalesce(list_sum(bits[1:step - 1]), 0) as int) as before from o, (select unnest(range(1, 6)) as step)),
        r as (select part, filter_order, step, bit, coalesce(sum(n) filter (mask & (before | bit) = 0), 0) as kept, coalesce(sum(n) filter (mask & before = 0 and mask & bit > 0), 0) as removed,
                coalesce(sum(n) filter (mask & before > 0 and mask & bit > 0), 0) as redundant, coalesce(sum(n) filter (mask = bit), 0) as unique_fails,
                coalesce(sum(good) filter (mask & before = 0 and mask & bit > 0), 0) as good_lost, coalesce(sum(toxic) filter (mask & before = 0 and mask & bit > 0), 0) as toxic_lost
              from c, s group by 1, 2, 3, 4)
        select part, filter_order, cast(step as int) as step, cast(kept as bigint) as kept, cast(removed as bigint) as removed, cast(redundant as bigint) as redundant,
          cast(unique_fails as bigint) as unique_fails, cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost,
          cast(sum(removed) over (partition by part, bit) as bigint) as shapley from r""",
}
