"""Topic labels over whole ``documents`` texts and over titles derived from ``orders``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oddslake.operators import discover
from oddslake.operators.topics import classify, select_topics, topic_sector_pairs
from oddslake.plans.registry import Query, join_text, table
from oddslake.sources.taxonomy import Taxonomy

TAXONOMY = Taxonomy(
    {
        "us_context_terms": ["the", "to"],
        "us_state_terms": ["on of"],
        "foreign_context_terms": ["der", "que"],
        "sports_terms": ["license"],
        "topics": {
            "midterms_2026": {"terms": ["and", "of"], "requires_election_cycle": True, "sectors": ["bonds", "autos"], "queries": ["who wins", "control of"]},
            "grain": {"terms": ["of the"], "patterns": {"near": r"\bin\b.{0,20}\bof\b"}, "sectors": ["autos"], "queries": ["harvest", "who wins"]},
            "rates": {"terms": ["is", "tion", "tion is"], "sectors": ["banks"]},
        },
    }
)
HEADLINES = ["The 2026 Senate election", "The 2024 Senate election", "Who wins the midterms", "", "Years 2026 and 2024"]


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents below a headline chosen by ``doc_id % 5``."""
    headline = F.element_at(F.array(*[F.lit(h) for h in HEADLINES]), (F.col("doc_id") % 5 + 1).cast("int"))
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "lang", F.concat_ws("\n", headline, "text").alias("text"))


def _re(*terms: str) -> str:
    body = "|".join("[\\s_-]+".join(t.split()) for t in terms)
    return f"regexp_matches(t, '(^|[^\\p{{L}}\\p{{N}}_])({body})($|[^\\p{{L}}\\p{{N}}_])', 'i')"


# Only the headline holds a year, and only headlines 0, 1 and 4 do; the text of 2 says midterms.
LABELS = f"""
WITH d AS (SELECT doc_id, lang, (doc_id % 5) AS h, nfc_normalize(['The 2026 Senate election','The 2024 Senate election','Who wins the midterms','','Years 2026 and 2024'][doc_id % 5 + 1] || chr(10) || text) AS t FROM documents),
g AS (SELECT *, {_re("the", "to")} AS us, {_re("on of")} AS state, {_re("der", "que")} AS foreign_, {_re("license")} AS sports, h IN (0, 1, 2) AS chamber,
  {_re("and")} AS e_and, {_re("of")} AS e_of, {_re("of the")} AS e_of_the, regexp_matches(t, '\\bin\\b[^\\n]{{0,20}}\\bof\\b', 'i') AS e_near,
  {_re("is")} AS e_is, {_re("tion")} AS e_tion, {_re("tion is")} AS e_tion_is, h IN (0, 2, 4) AS cycle FROM d),
r AS (SELECT *, CASE WHEN sports THEN 'sports_context' WHEN us THEN NULL WHEN foreign_ THEN 'foreign_context_without_explicit_us_link'
  WHEN NOT (state OR chamber) THEN 'missing_us_context' END AS reason FROM g),
labels AS (SELECT *, reason IS NULL AND cycle AND (e_and OR e_of) AS mid, reason IS NULL AND (e_of_the OR e_near) AS grain,
  reason IS NULL AND (e_is OR e_tion OR e_tion_is) AS rates FROM r)"""
LABEL_SELECT = """ SELECT doc_id, concat_ws(',', CASE WHEN grain THEN 'grain' END, CASE WHEN mid THEN 'midterms_2026' END, CASE WHEN rates THEN 'rates' END) AS topics,
 concat_ws(',', CASE WHEN grain OR mid THEN 'autos' END, CASE WHEN rates THEN 'banks' END, CASE WHEN mid THEN 'bonds' END) AS sectors,
 CAST(grain AS INT) + CAST(mid AS INT) * 6 + CAST(rates AS INT) AS relevance_score,
 coalesce(reason, CASE WHEN NOT (grain OR mid OR rates) THEN 'no_target_topic' END) AS exclude_reason FROM labels"""


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = classify(texts(spark, sf_dir), "text", TAXONOMY)
    return rows.select("doc_id", join_text("topics").alias("topics"), join_text("sectors").alias("sectors"), "relevance_score", "exclude_reason")


def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = classify(texts(spark, sf_dir), "text", TAXONOMY)
    return rows.groupBy("lang", join_text("topics").alias("topics"), F.coalesce("exclude_reason", F.lit("")).alias("exclude_reason")).agg(F.count(F.lit(1)).alias("documents"))


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = classify(texts(spark, sf_dir), "text", TAXONOMY)
    return rows.select("doc_id", F.explode("matched_terms").alias("topic", "terms")).select("doc_id", "topic", F.explode("terms").alias("term"))


def selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = select_topics(classify(texts(spark, sf_dir), "text", TAXONOMY), ["grain", "rates"])
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("documents"), F.sum("relevance_score").alias("relevance"))


def sector_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = topic_sector_pairs(classify(texts(spark, sf_dir), "text", TAXONOMY), TAXONOMY, ["doc_id"])
    return pairs.groupBy("topic", "sector").agg(F.count(F.lit(1)).alias("documents"))


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents behind each search seed of their topics, and the seed's place among all seeds."""
    labelled = classify(texts(spark, sf_dir), "text", TAXONOMY).select("doc_id", F.explode("topics").alias("topic"))
    # The seeds are a fixed configuration of a few hundred rows.
    by_seed = labelled.join(F.broadcast(TAXONOMY.dimensions(spark)["topic_queries"].select("topic", "query")), "topic")
    place = F.array_position(F.array(*[F.lit(q) for q in TAXONOMY.queries()]), F.col("query"))
    return by_seed.groupBy("query", place.alias("place")).agg(F.countDistinct("doc_id").alias("documents"))


QUERY_WORDS = ["Who and the united ion", "thand is it"]


def query_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    matched = discover.query_match(F.col("text"), QUERY_WORDS)
    return docs.groupBy("lang").agg(F.count_if(matched).alias("matches"), F.count(F.lit(1)).alias("documents"))


# Titles with the labels the default taxonomy gives them, worked out by hand.
TITLES = [
    ("2026 US House control: Will Democrats win the House?", "midterms_2026,us_politics", ""),
    ("Who wins the 2026 North Carolina Senate election?", "midterms_2026,us_politics", ""),
    ("Who wins the Georgia gubernatorial election in 2026?", "midterms_2026,us_politics", ""),
    ("Which party wins the midterms?", "midterms_2026,us_politics", ""),
    ("Who will win NC-01 in 2026?", "midterms_2026", ""),
    ("who will win nc-01 in 2026?", "", "missing_us_context"),
    ("Who wins the 2024 Senate election?", "us_politics", ""),
    ("Who wins the 2028 US presidential election?", "us_politics", ""),
    ("Who will win Canada's 2026 election?", "", "foreign_context_without_explicit_us_link"),
    ("Who wins the 2026 Australian Senate election?", "", "foreign_context_without_explicit_us_link"),
    ("Will Roger Federer win the US tennis tournament?", "", "sports_context"),
    ("Will the Fed cut rates in September?", "fed_monetary_policy", ""),
    ("US CPI inflation above 3%?", "us_macro", ""),
    ("Will the ECB cut interest rates?", "", "foreign_context_without_explicit_us_link"),
    ("Will GDP increase?", "", "missing_us_context"),
    ("Will Virginia ban new data centres before 2027 over electricity bills?", "data_centers_ai_power", ""),
    ("Will Trump raise tariffs on China?", "trade_tariffs", ""),
    ("Will Medicaid funding be cut?", "healthcare_drug_pricing", ""),
    ("US government shutdown over the debt-ceiling?", "fiscal_taxes_debt,us_politics", ""),
    ("American weather", "", "no_target_topic"),
]


def default_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default taxonomy over one title per order, with the customer name below it."""
    title = F.element_at(F.array(*[F.lit(t) for t, _, _ in TITLES]), (F.col("o_orderkey") % len(TITLES) + 1).cast("int"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.concat_ws("\n", title, F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"))).alias("text"))
    rows = classify(orders, "text")
    return rows.select("o_orderkey", join_text("topics").alias("topics"), F.coalesce("exclude_reason", F.lit("")).alias("exclude_reason"))


_TITLE_ROWS = ", ".join(f"({i}, '{topics}', '{reason}')" for i, (_, topics, reason) in enumerate(TITLES))

QUERIES = [
    Query("topic_labels", labels, LABELS + LABEL_SELECT),
    Query(
        "topic_label_counts",
        label_counts,
        LABELS + f", x AS ({LABEL_SELECT}) SELECT lang, topics, coalesce(exclude_reason, '') AS exclude_reason, count(*) AS documents FROM x JOIN documents USING (doc_id) GROUP BY ALL",
    ),
    Query(
        "topic_evidence_terms",
        evidence,
        LABELS + """ SELECT doc_id, 'midterms_2026' AS topic, 'and' AS term FROM labels WHERE mid AND e_and UNION ALL SELECT doc_id, 'midterms_2026', 'of' FROM labels WHERE mid AND e_of
        UNION ALL SELECT doc_id, 'grain', 'of the' FROM labels WHERE grain AND e_of_the UNION ALL SELECT doc_id, 'grain', 'near' FROM labels WHERE grain AND e_near
        UNION ALL SELECT doc_id, 'rates', 'is' FROM labels WHERE rates AND e_is UNION ALL SELECT doc_id, 'rates', 'tion' FROM labels WHERE rates AND e_tion
        UNION ALL SELECT doc_id, 'rates', 'tion is' FROM labels WHERE rates AND e_tion_is""",
    ),
    Query(
        "topic_selection",
        selected,
        LABELS + " SELECT lang, count(*) AS documents, CAST(sum(CAST(grain AS INT) + CAST(mid AS INT) * 6 + CAST(rates AS INT)) AS BIGINT) AS relevance FROM labels WHERE grain OR rates GROUP BY 1",
    ),
    Query(
        "topic_sector_pairs",
        sector_pairs,
        LABELS + """ SELECT topic, sector, count(*) AS documents FROM (
          SELECT 'midterms_2026' AS topic, unnest(['bonds', 'autos']) AS sector FROM labels WHERE mid UNION ALL SELECT 'grain', 'autos' FROM labels WHERE grain
          UNION ALL SELECT 'rates', 'banks' FROM labels WHERE rates) GROUP BY ALL""",
    ),
    Query(
        "topic_seed_documents",
        seeds,
        LABELS + """ SELECT query, CAST(place AS BIGINT) AS place, count(DISTINCT doc_id) AS documents FROM (
          SELECT doc_id, mid, grain FROM labels) JOIN (VALUES ('who wins', 1, true, true), ('control of', 2, true, false), ('harvest', 3, false, true)) v(query, place, m, g) ON (mid AND m) OR (grain AND g) GROUP BY ALL""",
    ),
    Query(
        "query_word_matches",
        query_matches,
        "SELECT lang, count(*) FILTER (regexp_matches(nfc_normalize(text), '(^|[^\\p{L}\\p{N}_])(ion|thand)($|[^\\p{L}\\p{N}_])', 'i')) AS matches, count(*) AS documents FROM documents GROUP BY 1",
    ),
    Query(
        "default_topic_labels",
        default_labels,
        f"SELECT o_orderkey, topics, exclude_reason FROM orders JOIN (VALUES {_TITLE_ROWS}) v(i, topics, exclude_reason) ON o_orderkey % {len(TITLES)} = i",
    ),
]
