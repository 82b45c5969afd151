"""The operators of this package over the given tables, with SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.llm.byte_bpe import byte_bpe
from siltworks.llm.common import held_out
from siltworks.llm.embedding_dedup import near_duplicate_vectors
from siltworks.llm.hard_negatives import hard_negatives
from siltworks.llm.html_extraction import extract_pages
from siltworks.llm.language_id import fit_language_model, language_id
from siltworks.llm.license_scan import license_scan
from siltworks.llm.license_texts import LICENSE_TEXTS
from siltworks.llm.line_dedup import dedup_lines
from siltworks.llm.lm_scoring import score_texts
from siltworks.llm.ngram_join import ngram_components
from siltworks.llm.packing import pack_documents
from siltworks.llm.quality_rules import quality_rules
from siltworks.llm.token_alignment import align_tokenizers
from siltworks.llm.token_counts import token_counts
from siltworks.registry.base import Query, table

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return register


# Smallest node reachable over links(a, b), which hold each pair once.
COMPONENTS = """
both_ways as (select a, b from links union all select b, a from links),
reach(node, low) as (
  select a, least(a, min(b)) from both_ways group by a
  union
  select e.a, min(r.low) from both_ways e join reach r on r.node = e.b group by e.a, r.low
),
components as (select node, min(low) as component from reach group by node)
"""


@query()
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"), LICENSE_TEXTS)


@query()
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query()
def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


@query(rf"""
with recursive docs as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x20\x09-\x0D]+'), lambda x: x <> '') as words
  from documents
),
runs as (
  select doc_id, case when len(words) = 0 then [] when len(words) < 5 then [array_to_string(words, ' ')]
         else list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) end as shingles
  from docs
),
sets as (select doc_id, len(shingles) as n, case when len(shingles) > 0 then md5(array_to_string(list_sort(shingles), chr(10))) end as k from runs),
classes as (select k, min(doc_id) as class_id, any_value(n) as n from sets where k is not null group by k),
entries as (select c.class_id, c.n, unnest(r.shingles) as s from classes c join runs r on r.doc_id = c.class_id),
shared as (
  select x.class_id as a, y.class_id as b, count(*) as o, any_value(x.n) as n, any_value(y.n) as m
  from entries x join entries y on x.s = y.s and x.class_id < y.class_id group by all
),
links as (select a, b from shared where 100 * o >= 80 * (n + m - o)),
{COMPONENTS}
select s.doc_id, s.n as n_shingles, coalesce(p.component, c.class_id, s.doc_id) as component_id, coalesce(c.class_id, s.doc_id) as class_id
from sets s left join classes c on s.k = c.k left join components p on p.node = c.class_id
""")
def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents"))


@query()
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query()
def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    )


@query()
def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_texts(docs, held_out(F.col("doc_id"), 7, 2))


@query()
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    is_held_out = held_out(F.col("doc_id"), 3, 1)
    return language_id(docs, fit_language_model(docs, ~is_held_out), is_held_out)


@query()
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(
        table(spark, sf_dir, "documents"),
        public_tokenizers.path("piece_bpe_32k.model"),
        public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
        public_tokenizers.PATTERN,
    )


@query(f"""
with recursive valid as (
  select vec_id, cast(embedding as double[]) as v from embeddings
  where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and list_sum(list_transform(embedding, lambda x: cast(x as double) * x)) > 0
),
pairs as (
  select x.vec_id as a, y.vec_id as b from valid x join valid y on x.vec_id < y.vec_id and len(x.v) = len(y.v)
  where list_cosine_similarity(x.v, y.v) >= 0.95
),
links as (select a, b from pairs),
{COMPONENTS},
counts as (select a, count(*) as n from both_ways group by a)
select e.vec_id, coalesce(c.n, 0) as n_links, coalesce(p.component, e.vec_id) as component_id, e.vec_id = coalesce(p.component, e.vec_id) as kept
from embeddings e left join counts c on c.a = e.vec_id left join components p on p.node = e.vec_id
""")
def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


@query(r"""
with rows as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
  from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
),
pairs as (
  select a.vec_id as anchor_id, r.vec_id, r.label = a.label as same,
         cast(list_sum(list_transform(list_zip(a.v, r.v), lambda z: z[1] * z[2])) as bigint) as score
  from rows a join rows r on a.vec_id <> r.vec_id and len(a.v) = len(r.v) where a.vec_id % 100 = 0
),
positives as (select * from pairs where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5),
ranked as (
  select p.anchor_id, p.vec_id as positive_id, n.vec_id as negative_id, p.score as positive_score, n.score as negative_score,
         row_number() over (partition by p.anchor_id, p.vec_id order by n.score desc, n.vec_id) as rank
  from positives p join pairs n on p.anchor_id = n.anchor_id and not n.same
  where 80 * p.score <= 100 * n.score and 100 * n.score <= 100 * p.score
)
select anchor_id, positive_id, cast(rank as int) as rank, negative_id, positive_score, negative_score from ranked where rank <= 5
""")
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(table(spark, sf_dir, "embeddings"), relabel_every=7)


@query(r"""
with lines as (
  select doc_id, i, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from (
    select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as i
    from documents
  )
),
firsts as (select key, min(doc_id) as first from lines where length(key) >= 10 group by key having count(distinct doc_id) >= 2),
judged as (select l.doc_id, l.i, l.line, coalesce(f.first < l.doc_id, false) as dropped from lines l left join firsts f on f.key = l.key)
select doc_id, count(*) as n_lines, count(*) filter (where dropped) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not dropped), '')) as kept_sha256
from judged group by doc_id
""")
def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query()
def op13_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokenizers(
        table(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.path("piece_bpe_32k.model"),
    )


@query()
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
