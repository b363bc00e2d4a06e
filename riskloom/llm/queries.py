"""The registered queries of this folder and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from riskloom.llm import (
    embedding_dedup, hard_negatives, html_extract, license_scan, packing, pu_classifier, quality_rules, secrets,
    sentencepiece_scan, simhash, spelling_variants, topk, warc,
)
from riskloom.llm.frames import table


def op1_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.find_licenses(table(spark, folder, "documents"))


def op2_html_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_extract.extract(table(spark, folder, "pages"))


def op3_mixture_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), with_ids=False)


def op4_warc_derivatives(spark: SparkSession, folder: str) -> DataFrame:
    return warc.derivatives(warc.responses(table(spark, folder, "pages")), ("page_id",))


def op5_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(table(spark, folder, "embeddings"))


def op6_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.quality(table(spark, folder, "documents")).select(
        "doc_id",
        *[f"quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        "quality.base_failed", "quality.kept", "quality.p_good",
    )


def op7_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.scan(table(spark, folder, "documents"))


def op8_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


def op9_pu_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return pu_classifier.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op10_sentencepiece_scan(spark: SparkSession, folder: str) -> DataFrame:
    return sentencepiece_scan.digests(table(spark, folder, "documents"))


def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    return hard_negatives.mine(table(spark, folder, "embeddings"))


def op12_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, folder, "embeddings"))


def op13_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling_variants.variants(table(spark, folder, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ours = (
        op1_license_scan, op2_html_main_text, op3_mixture_packing, op4_warc_derivatives, op5_exact_top_k,
        op6_quality_rules, op7_secret_scan, op8_simhash_near_dedup, op9_pu_quality_classifier,
        op10_sentencepiece_scan, op11_hard_negatives, op12_embedding_near_dedup, op13_spelling_variants,
    )
    return {f.__name__: f for f in ours}


TOP_K_SQL = """
with v as (
  select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor(1024 * cast(x as double))) as e
  from embeddings where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0)
select query_id, cast(place as int) as rank, vec_id, cast(s as bigint) as score from (
  select *, row_number() over (partition by r order by s desc, vec_id) as place from (
    select q.r, q.vec_id as query_id, c.vec_id, list_inner_product(q.e, c.e) as s
    from v q join v c on q.r <> c.r and len(q.e) = len(c.e) where q.vec_id % 100 = 0))
where place <= 10
"""


HARD_NEGATIVES_SQL = """
with v as (
  select row_number() over () as r, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as lab,
    list_transform(embedding, lambda x: floor(256 * cast(x as double))) as e
  from embeddings where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
scored as (
  select a.r, a.vec_id as anchor_id, c.vec_id, a.lab = c.lab as same,
    cast(list_inner_product(a.e, c.e) as bigint) as score
  from v a join v c on a.r <> c.r and len(a.e) = len(c.e) where a.vec_id % 100 = 0),
positives as (
  select *, row_number() over (partition by r order by score desc, vec_id) as place from scored where same
  qualify place <= 5),
ranked as (
  select p.anchor_id, p.vec_id as positive_id, p.score as positive_score, n.vec_id as negative_id,
    n.score as negative_score,
    row_number() over (partition by p.r, p.place order by n.score desc, n.vec_id) as place
  from positives p join scored n on p.r = n.r and not n.same
    and 80 * p.score <= 100 * n.score and n.score <= p.score)
select anchor_id, positive_id, cast(place as int) as rank, negative_id, positive_score, negative_score
from ranked where place <= 5
"""

EMBEDDING_DEDUP_SQL = """
with recursive rows as (select row_number() over () as r, * from embeddings),
v as (
  select r, vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as e
  from rows where label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (
  select a.r, b.r as other from v a join v b on a.label = b.label and len(a.e) = len(b.e) and a.r <> b.r
  where list_cosine_similarity(a.e, b.e) >= 0.98),
reached as (select r, r as other from rows union select w.r, l.other from reached w join links l on w.other = l.r),
firsts as (
  select w.r, min(o.vec_id) as component_id from reached w join rows o on w.other = o.r group by w.r)
select d.vec_id, coalesce(n.n, 0) as n_links, f.component_id, d.vec_id is not distinct from f.component_id as kept
from rows d join firsts f on d.r = f.r left join (select r, count(*) as n from links group by r) n on d.r = n.r
"""

SPELLING_SQL = """
with recursive letters as (
  select coalesce(cast(doc_id as varchar), '') as id,
    translate(unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]{5,}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz') as run
  from documents where text is not null),
pairs as (select id, run, count(*) as n from letters group by id, run),
summed as (
  select run, n, xor(4294967295, list_reduce(
    list_prepend(4294967295, flatten(list_transform(string_split(id || ':' || run, ''), lambda x:
      case when unicode(x) < 128 then [cast(unicode(x) as bigint)]
        else [cast(192 + unicode(x) // 64 as bigint), cast(128 + unicode(x) % 64 as bigint)] end))),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k:
      case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end))) as h
  from pairs),
damaged as (
  select case when h % 97 = 0 then left(run, h % len(run)) || substr(run, h % len(run) + 2) else run end as word, n
  from summed),
words as (
  select word, cast(sum(n) as bigint) as n from damaged where len(word) >= 5 group by word having sum(n) >= 3),
dropped as (
  select distinct word, n, k, left(word, k - 1) || substr(word, k + 1) as rest
  from (select word, n, unnest(range(1, len(word) + 1)) as k from words)),
near as (
  select a.word, b.word as other, b.n from dropped a join dropped b on a.rest = b.rest and a.k = b.k and a.word <> b.word
  union select a.word, b.word, b.n from dropped a join words b on a.rest = b.word
  union select b.word, a.word, a.n from dropped a join words b on a.rest = b.word),
best as (
  select word, count(*) as n_near, max(n) as most, min(other) filter (n = top) as other
  from (select *, max(n) over (partition by word) as top from near) group by word),
known as (
  select w.word, w.n, coalesce(b.n_near, 0) as n_near, case when b.most >= 2 * w.n then b.other end as form,
    case when b.most >= 2 * w.n then b.most end as form_n
  from words w left join best b on w.word = b.word),
chain as (
  select word, form as root, 1 as step from known where form is not null
  union all select c.word, k.form, c.step + 1 from chain c join known k on c.root = k.word where k.form is not null)
select k.word, k.form, coalesce(r.root, k.word) as root, k.n, k.n_near, k.form_n
from known k left join (select word, arg_max(root, step) as root from chain group by word) r on k.word = r.word
"""


def oracle_sql() -> dict[str, str]:
    """SQL of what SQL can express; tests hold the other queries against brute force."""
    return {
        "op5_exact_top_k": TOP_K_SQL, "op11_hard_negatives": HARD_NEGATIVES_SQL,
        "op12_embedding_near_dedup": EMBEDDING_DEDUP_SQL,
        "op13_spelling_variants": SPELLING_SQL,
    }
