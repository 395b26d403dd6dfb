"""Queries of retrieval as a whole, over records and questions made from vectors by expressions that both sides read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import lexicon
from docloom.operators import search
from docloom.plans.catalog import query, quoted
from docloom.sources.tables import read_table

RECORD = {
    "dates": "CASE label WHEN 0 THEN '2020-01-10' WHEN 1 THEN CASE vec_id % 2 WHEN 0 THEN '2020-02-11' ELSE '2020-02-11; 2021-05-12' END WHEN 2 THEN concat('2020-03-1', vec_id % 3) END",
    "keywords": "CASE label WHEN 3 THEN 'delay, Price' WHEN 4 THEN 'term' END",
    "content": "concat('text ', vec_id % 5)",
    "is_summary": "vec_id % 7 = 0",
    "original_content": "CASE vec_id % 7 WHEN 0 THEN concat('text ', vec_id % 5) END",
    "tenant": "'all'",
}
#: Questions without dates, about dates, with a date, with both, and with a month; some of a tenant without records.
ASKED = {
    "query_text": "CASE vec_id % 100 WHEN 0 THEN 'what is the price' WHEN 20 THEN 'which date and price' WHEN 40 THEN 'signed on 2020-01-10' WHEN 60 THEN 'the date 2020-02-11' ELSE 'the date of March 2020' END",
    "tenant": "CASE vec_id % 140 WHEN 20 THEN 'nobody' ELSE 'all' END",
}
DATES_ASKED = "CASE vec_id % 100 WHEN 40 THEN ['2020-01-10'] WHEN 60 THEN ['2020-02-11'] WHEN 80 THEN ['March 2020'] ELSE []::VARCHAR[] END"
LISTED = "string_split(coalesce({}, ''), '; ')"

SQL = f"""WITH r AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, {', '.join(f'{e} AS {c}' for c, e in RECORD.items())} FROM embeddings),
q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS w, {', '.join(f'{e} AS {c}' for c, e in ASKED.items())}, {DATES_ASKED} AS ad FROM embeddings WHERE vec_id % 20 = 0),
qa AS (SELECT *, {' OR '.join(f'contains(query_text, {quoted(w)})' for w in lexicon.DATE_WORDS)} AS asks FROM q),
p AS MATERIALIZED (SELECT query_id, ad, id, round(1 - round(list_cosine_similarity(v, w), 6), 6) + 0.0 AS distance, dates, list_has_any({LISTED.format('dates')}, ad) AS hit FROM qa JOIN r USING (tenant)),
b0 AS (SELECT query_id, id, distance, 0 AS branch, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS k FROM p WHERE hit),
b1 AS (SELECT query_id, id, distance, 1 AS branch, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS k, ad FROM p),
u AS (SELECT query_id, id, distance, branch, k FROM b0 WHERE k <= 10 UNION ALL SELECT query_id, id, distance, branch, k FROM b1 WHERE k <= CASE WHEN len(ad) > 0 THEN 5 ELSE 10 END),
once AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY query_id, id ORDER BY branch) = 1),
o AS (SELECT once.query_id, id, distance, row_number() OVER (PARTITION BY once.query_id ORDER BY branch, k) AS ord, r.* EXCLUDE (id, v, tenant), list_has_any({LISTED.format('dates')}, ad) AS has_date FROM once JOIN r USING (id) JOIN q USING (query_id)),
s AS (SELECT * FROM o WHERE is_summary OR NOT EXISTS (SELECT 1 FROM o m WHERE m.query_id = o.query_id AND m.is_summary AND m.original_content = o.content AND m.ord < o.ord)),
f AS MATERIALIZED (SELECT * REPLACE (row_number() OVER (PARTITION BY query_id ORDER BY has_date DESC, distance, ord) AS ord) FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY has_date DESC, distance, ord) <= 5),
near AS (SELECT query_id, id, distance, ord, false AS from_dates FROM f WHERE distance <= 0.63),
few AS (SELECT * FROM (SELECT * FROM r ORDER BY id LIMIT 100) WHERE dates IS NOT NULL),
tiered AS (SELECT f.query_id, id, distance, ord, 'search' AS source, CASE WHEN dates IS NOT NULL AND CASE WHEN len(ad) = 0 THEN asks ELSE has_date OR len(list_filter({LISTED.format('dates')}, lambda d: d[1:7] = CASE ad[1] WHEN 'March 2020' THEN '2020-03' ELSE ad[1][1:7] END)) > 0 END THEN 1
  WHEN len(list_filter(string_split(coalesce(keywords, ''), ', '), lambda w: w != '' AND contains(lower(query_text), lower(w)))) > 0 THEN 2 ELSE 3 END AS tier FROM f JOIN qa USING (query_id)),
lost AS (SELECT query_id, ad, asks FROM qa WHERE query_id NOT IN (SELECT query_id FROM f)),
added AS (SELECT query_id, id, 1.0 AS distance, 'exact' AS source FROM lost JOIN r ON list_contains(ad, dates) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY id) <= 20
  UNION ALL SELECT query_id, id, 1.0, 'first' FROM lost, few WHERE asks AND len(ad) = 0
  UNION ALL SELECT query_id, id, 1.0, 'wider' FROM (SELECT query_id FROM tiered GROUP BY query_id HAVING min(tier) > 1) JOIN qa USING (query_id), few WHERE (asks OR len(ad) > 0) AND NOT EXISTS (SELECT 1 FROM f WHERE f.query_id = qa.query_id AND f.id = few.id)),
c AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY tier, distance, source != 'search', ord) AS place FROM (SELECT query_id, id, distance, source, tier, ord FROM tiered UNION ALL SELECT query_id, id, distance, source, 1, id FROM added)),
context AS MATERIALIZED (SELECT * FROM c WHERE place <= 20 OR source = 'first'),
merged AS (SELECT * FROM near UNION ALL SELECT query_id, id, distance, place, true FROM context JOIN qa USING (query_id) WHERE asks AND NOT EXISTS (SELECT 1 FROM near WHERE near.query_id = context.query_id AND near.id = context.id)),
every AS (SELECT * FROM merged UNION ALL SELECT query_id, id, distance, ord, false FROM f WHERE query_id NOT IN (SELECT query_id FROM merged)),
answer AS (SELECT query_id, id, distance, row_number() OVER (PARTITION BY query_id ORDER BY from_dates, distance, ord) AS rank, from_dates, asks FROM every JOIN qa USING (query_id))
"""


def made(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = read_table(spark, sf_dir, "embeddings")
    records = rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), *(F.expr(e).alias(c) for c, e in RECORD.items()))
    asked = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"), *(F.expr(e).alias(c) for c, e in ASKED.items()))
    return asked, records


@query(f"{SQL} SELECT query_id, id, distance, rank, from_dates FROM answer WHERE rank <= CASE WHEN asks THEN 10 ELSE 5 END")
def retrieval_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At 0.37, for these vectors lie further apart than the default of 0.6."""
    return search.retrieve(*made(spark, sf_dir), 5, 0.37, "tenant").select("query_id", "id", "distance", "rank", "from_dates")


@query(f"{SQL} SELECT query_id, id, tier, source, place FROM context")
def retrieval_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, records = made(spark, sf_dir)
    q = search.asked(asked, "tenant")
    found = search.fetched(q, records, 5, "tenant")
    return search.context_of(found, q, records).select("query_id", "id", "tier", "source", "place")


@query(f"{SQL} SELECT query_id, id, distance, ord AS rank, has_date FROM f")
def retrieval_fetched(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, records = made(spark, sf_dir)
    return search.fetched(search.asked(asked, "tenant"), records, 5, "tenant").select("query_id", "id", "distance", F.col("ord").alias("rank"), "has_date")
