"""Registered queries of the corpus operators, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from sitewise.llm import decontaminate, exact, lines, mixing, near, negatives, pages, periods, private, quality, repeats, simhash, toxicity
from sitewise.sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Shares of tokens that the corpus is to have per language.
MIX = {"de": 0.2, "en": 0.4, "es": 0.2, "fr": 0.2}


def query(name: str, sql: str | None = None):
    def register(job: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = job
        if sql is not None:
            ORACLES[name] = sql
        return job

    return register


def labelled_domains(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The labelled rows of a corpus with their language as domain."""
    return docs.join(labels.select("doc_id").distinct(), "doc_id", "left_semi").selectExpr("doc_id", "lang as domain")


@query("op1_quality_network")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@query("op2_mix_to_targets")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    mixed = mixing.mix(docs, labelled_domains(docs, read_table(spark, sf_dir, "labels")), MIX)
    return mixed.select("doc_id", "n_tokens", *[mixed.p[i].alias(f"p_{d}") for i, d in enumerate(sorted(MIX))], "rate", "copies")


@query(
    "op5_exact_dedup",
    r"""
    with body as (
      select doc_id, length(coalesce(text, '')) as points,
        sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as text_sha256
      from documents
    ), placed as (
      select *, count(*) over (partition by text_sha256) as group_size,
        first_value(doc_id) over (partition by text_sha256 order by points desc, doc_id) as keep_id
      from body
    )
    select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from placed
    """,
)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(read_table(spark, sf_dir, "documents"), digests=True)


@query("op8_toxicity_network")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@query(
    "op10_benchmark_leaks",
    r"""
    with texts as (
      select 'd' as kind, doc_id as id, text from documents union all select 'i', item_id, text from benchmark
    ), words as (
      select kind, id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '(?:[0-9a-z]|[^\x00-\x7F])+') as w
      from texts
    ), shingles as (
      select distinct kind, id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) as s from words
    ), sizes as (
      select id, count(*) as n from shingles where kind = 'i' group by id
    )
    select d.id as doc_id, i.id as item_id, count(*) / any_value(z.n) as containment
    from shingles d join shingles i on d.s = i.s and d.kind = 'd' and i.kind = 'i' join sizes z on z.id = i.id
    group by d.id, i.id having count(*) / any_value(z.n) >= 0.8
    """,
)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


@query(
    "op6_line_dedup",
    r"""
    with split as (
      select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
        generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as place
      from documents
    ), keyed as (
      select *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from split
    ), shared as (
      select key from keyed where length(key) >= 1 group by key having count(distinct doc_id) >= 10
    ), marked as (
      select *, key in (select key from shared) as gone from keyed
    )
    select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
      sha256(coalesce(string_agg(line, chr(10) order by place) filter (not gone), '')) as kept_sha256
    from marked group by doc_id
    """,
)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    stripped = lines.drop_shared_lines(read_table(spark, sf_dir, "documents"))
    return stripped.select("row.doc_id", "n_lines", "n_dropped", F.sha2("row.text", 256).alias("kept_sha256"))


@query("op7_near_classes")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_classes(read_table(spark, sf_dir, "documents"), wordless=True).drop("k1", "k2")


@query("op3_suffix_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = repeats.remove_repeats(read_table(spark, sf_dir, "documents"))
    return removed.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op4_private_spans")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = private.find_private(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "n_added", F.sha2("base", 256).alias("base_sha256"), "spans")


@query("op9_page_text")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(read_table(spark, sf_dir, "pages"))


def embedding_negatives(embeddings: DataFrame) -> DataFrame:
    """Hard negatives of a table (vec_id, embedding, label): components by 256ths, every seventh id with the next label, every fiftieth an anchor."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = embeddings.filter(negatives.usable("embedding")).select(
        "vec_id", label.alias("label"), negatives.quantised("embedding").alias("vec"), (F.col("vec_id") % 50 == 0).alias("anchor")
    )
    return negatives.hard_negatives(rows)


@query(
    "op12_hard_negatives",
    """
    with usable as (
      select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
        list_transform(embedding, lambda x: floor(256 * x::double)) as vec, row_number() over () as place
      from embeddings
      where vec_id is not null and label is not null and embedding is not null
        and coalesce(list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false))), true)
    ), scored as (
      select a.place, a.vec_id as anchor_id, b.vec_id, a.label = b.label as alike, cast(list_inner_product(a.vec, b.vec) as bigint) as score
      from usable a join usable b on a.vec_id % 50 = 0 and a.place <> b.place
    ), positives as (
      select place, vec_id as positive_id, score as positive_score,
        row_number() over (partition by place order by score desc, vec_id) as turn
      from scored where alike qualify turn <= 5
    )
    select s.anchor_id, p.positive_id, s.vec_id as negative_id, p.positive_score, s.score as negative_score,
      cast(row_number() over (partition by s.place, p.turn order by s.score desc, s.vec_id) as int) as rank
    from scored s join positives p on s.place = p.place
    where not s.alike and 50 * p.positive_score <= 100 * s.score and 100 * s.score <= 95 * p.positive_score
    qualify rank <= 3
    """,
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_negatives(read_table(spark, sf_dir, "embeddings"))


@query("op11_simhash_components")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(read_table(spark, sf_dir, "documents"))


@query("op13_periodic_runs")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.periodic_runs(read_table(spark, sf_dir, "documents"))
