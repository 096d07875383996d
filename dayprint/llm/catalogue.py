"""One query for each operator, with production parameters over whole tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def vocabulary() -> str:
    """The vocabulary file; DAYPRINT_VOCABULARY names another place."""
    import public_tokenizers

    return os.environ.get("DAYPRINT_VOCABULARY") or public_tokenizers.path("word_bpe_49k.json")


def op1_token_files(spark: SparkSession, folder: str) -> DataFrame:
    from dayprint.llm.rans_files import token_files

    ids = token_files(table(spark, folder, "documents"), vocabulary(), end_id=2)
    return ids.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2_packing(spark: SparkSession, folder: str) -> DataFrame:
    from dayprint.llm.best_fit import pack

    packed = pack(table(spark, folder, "documents"), vocabulary(), end_id=0, capacity=2048)
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op3_secrets(spark: SparkSession, folder: str) -> DataFrame:
    from dayprint.llm.secret_scan import listed, scanned

    found = scanned(table(spark, folder, "documents"), keep=["doc_id"])

    def n(kind: int):
        return F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
        F.sha2(listed(F.col("base_spans")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
    )


def op4_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    from dayprint.llm.minhash_join import similar

    return similar(table(spark, folder, "documents"), threshold=0.8, width=5)


def op5_quality(spark: SparkSession, folder: str) -> DataFrame:
    from dayprint.llm.quality_cascade import estimates, measured, ordered, rejected_by, rules

    docs = table(spark, folder, "documents").select("doc_id", "text")
    # The order is learnt over the texts; the counts that the result needs are made once and used by the rules.
    order = [r.name for r in ordered(estimates(docs, rules(), sample_rows=2000))]
    cascade = sorted(rules(from_text=False), key=lambda r: order.index(r.name))
    judged = measured(docs).withColumn("rejected_by", rejected_by(cascade))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & F.col("rejected_by").isNull()).alias("kept"),
    )


def op6_class_model(spark: SparkSession, folder: str) -> DataFrame:
    from dayprint.llm.class_ngrams import scored

    return scored(table(spark, folder, "documents"), folds=7, fold=2)


def op7_mixture(spark: SparkSession, folder: str) -> DataFrame:
    from dayprint.llm.fair_mix import NO_SOURCE, schedule

    turns = schedule(table(spark, folder, "documents"))
    source = F.when(F.col("lane") != NO_SOURCE, F.col("lane")).alias("source")
    return turns.select("doc_id", source, "block", "slot", "release", "deadline", "place")


def op8_repeated_spans(spark: SparkSession, folder: str) -> DataFrame:
    from dayprint.llm.debruijn_dedup import without_repeats

    docs = table(spark, folder, "documents").select("doc_id", "text")
    return without_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_near_vectors(spark: SparkSession, folder: str) -> DataFrame:
    from dayprint.llm.multi_index import near_vectors

    found = near_vectors(table(spark, folder, "embeddings"), threshold=0.95)
    return found.select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))


def op10_quality_votes(spark: SparkSession, folder: str) -> DataFrame:
    from dayprint.llm.latent_votes import scored

    found = scored(table(spark, folder, "documents"), table(spark, folder, "labels"), "quality")
    return found.withColumn("predicted", F.when(F.col("score") >= 0.3, 1).otherwise(0))


def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    from dayprint.llm.hyperplane_tree import hard_negatives

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, folder, "embeddings").select("vec_id", "embedding", label.alias("label"))
    return hard_negatives(rows, F.col("vec_id") % 100 == 0, scale=256, positives=5, negatives=5, low=80, high=100)


def op12_order_minhash(spark: SparkSession, folder: str) -> DataFrame:
    from dayprint.llm.order_minhash import edits

    found = edits(table(spark, folder, "documents"))
    return found.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next",
    )


def op13_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    from dayprint.llm.block_max import ranked

    return ranked(table(spark, folder, "documents"), table(spark, folder, "benchmark"), k=50)


QUERIES = {
    "op1_token_files": op1_token_files,
    "op2_packing": op2_packing,
    "op3_secrets": op3_secrets,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_quality": op5_quality,
    "op6_class_model": op6_class_model,
    "op7_mixture": op7_mixture,
    "op8_repeated_spans": op8_repeated_spans,
    "op9_near_vectors": op9_near_vectors,
    "op10_quality_votes": op10_quality_votes,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_order_minhash": op12_order_minhash,
    "op13_ranked_search": op13_ranked_search,
}


#: The words of each document in order.
WORDS_SQL = r"""w as (select doc_id, [x for x in regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') if x <> ''] as ws from documents)"""

NEAR_DUPLICATES_SQL = (
    "with recursive "
    + WORDS_SQL
    + """,
  g as (select distinct doc_id, md5(array_to_string(list_slice(ws, i, i + 4), ' ')) as h from w, unnest(range(1, greatest(len(ws) - 3, least(len(ws), 1) + 1))) as r(i)),
  n as (select doc_id, count(*) as c from g group by doc_id),
  p as (select a.doc_id as x, b.doc_id as y, count(*) as k from g a join g b on a.h = b.h and a.doc_id <> b.doc_id group by a.doc_id, b.doc_id),
  l as (select x, y from p join n nx on x = nx.doc_id join n ny on y = ny.doc_id where 10 * k >= 8 * (nx.c + ny.c - k)),
  reach as (select x, y from l union select reach.x, l.y from reach join l on reach.y = l.x)
  select d.doc_id, least(d.doc_id, coalesce((select min(y) from reach where x = d.doc_id), d.doc_id)) as class_id,
    (select count(*) from l where x = d.doc_id) as n_links from documents d"""
)

REPEATED_SPANS_SQL = (
    "with "
    + WORDS_SQL
    + """,
  win as (select doc_id, i, md5(array_to_string(list_slice(ws, i, i + 49), ' ')) as h from w, unnest(range(1, len(ws) - 48)) as r(i)),
  again as (select doc_id, i from (select doc_id, i, min(doc_id) over (partition by h) as m from win) where m < doc_id),
  cover as (select doc_id, list(distinct i + k) as gone from again, range(0, 50) as r(k) group by doc_id)
  select doc_id, cast(len(ws) as bigint) as n_words, cast(coalesce(len(gone), 0) as bigint) as n_removed,
    sha256(array_to_string([ws[j] for j in range(1, len(ws) + 1) if not coalesce(list_contains(gone, j), false)], ' ')) as kept_sha256
  from w left join cover using (doc_id)"""
)

NEAR_VECTORS_SQL = """with recursive
  v as (select vec_id, cast(embedding as double[]) as e from embeddings),
  l as (select a.vec_id as x, b.vec_id as y from v a join v b on a.vec_id <> b.vec_id where list_cosine_similarity(a.e, b.e) >= 0.95),
  reach as (select x, y from l union select reach.x, l.y from reach join l on reach.y = l.x),
  c as (select vec_id, least(vec_id, coalesce((select min(y) from reach where x = vec_id), vec_id)) as component_id from v)
  select vec_id, (select count(*) from l where x = vec_id) as n_links, component_id, vec_id = component_id as kept from c"""


HARD_NEGATIVES_SQL = """with
  v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
          list_transform(embedding, lambda x: floor(256 * cast(x as double))) as e from embeddings
        where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
  s as (select a.vec_id as anchor_id, b.vec_id as id, a.label = b.label as same, cast(list_dot_product(a.e, b.e) as bigint) as score
        from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0),
  p as (select anchor_id, id as positive_id, score as positive_score from s where same
        qualify row_number() over (partition by anchor_id order by score desc, id) <= 5)
  select anchor_id, positive_id, cast(row_number() over (partition by anchor_id, positive_id order by score desc, id) as integer) as rank,
    id as negative_id, positive_score, score as negative_score
  from p join s using (anchor_id) where not same and 80 * positive_score <= 100 * score and 100 * score <= 100 * positive_score
  qualify rank <= 5"""

RANKED_SQL = r"""with
  t as (select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
          '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from documents),
  i as (select distinct item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
          '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
  g as (select count(distinct doc_id) as nd, count(*) as nt from t),
  f as (select doc_id, term, count(*) as tf from t group by all),
  m as (select doc_id, 50 + (50 * count(*) * nd) // nt as m from t, g group by doc_id, nd, nt),
  w as (select term, cast(floor(1000 * ln((2 * nd + 2) / (2 * count(*) + 1))) as bigint) as w from f, g group by term, nd),
  s as (select item_id, doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) as bigint) as score
        from i join f using (term) join w using (term) join m using (doc_id) group by item_id, doc_id)
  select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as integer) as rank, doc_id, score
  from s where score > 0 qualify rank <= 50"""


def _oracles() -> dict[str, str]:
    from dayprint.llm.quality_cascade import VERDICTS_SQL

    return {
        "op4_near_duplicates": NEAR_DUPLICATES_SQL,
        "op8_repeated_spans": REPEATED_SPANS_SQL,
        "op9_near_vectors": NEAR_VECTORS_SQL,
        "op11_hard_negatives": HARD_NEGATIVES_SQL,
        "op13_ranked_search": RANKED_SQL,
        "op5_quality": VERDICTS_SQL
        + """select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
             not base_failed and not method_failed as kept from v""",
    }


ORACLES = _oracles()
