import json

import pytest
from pyspark.sql import functions as F

from oddslake.functions import term_pattern
from oddslake.operators.topics import TermIndex, Text, classify, exclusion_reason
from oddslake.sources.taxonomy import Taxonomy


@pytest.fixture(scope="module")
def label(spark):
    def run(texts, taxonomy=None):
        df = spark.createDataFrame([(t,) for t in texts], "text STRING")
        return {r["text"]: r.asDict() for r in classify(df, "text", taxonomy).collect()}

    return run


# Titles made up for the rule that each stands for.
CYCLE = {
    "Ohio governor race, November 2026": True,  # a year in the headline
    "Senate majority after the midterms": True,  # no year, but the word
    "Ballot watch\nThe 2026 Senate election in Texas": True,  # a dated election line
    "AZ-06 in 2026": True,  # a district code
    "Texas Senate runoff of 2032": False,  # another year in the headline
    "Senate seats in 2030\nSet by the midterms of 2026": False,  # the headline's year decides
    "Republicans to hold the Senate": False,  # no year and no such word
    "White House press briefing in 2026": False,  # a year, but no election
}
REASONS = {
    "Spain picks a prime minister in 2026": "foreign_context_without_explicit_us_link",
    "Bank of England rate decision": "foreign_context_without_explicit_us_link",
    "American golf and tennis champions": "sports_context",
    "Unemployment to rise": "missing_us_context",
    "az-06 in 2026": "missing_us_context",  # district codes are upper case
    "American sunshine": "no_target_topic",
    "naïveFed decision": "missing_us_context",  # no word border before the term
    "": "missing_us_context",
}


def test_election_cycle(label):
    got = label(list(CYCLE))
    assert {t: "midterms_2026" in got[t]["topics"] for t in CYCLE} == CYCLE


def test_reasons(label):
    got = label(list(REASONS))
    assert {t: got[t]["exclude_reason"] for t in REASONS} == REASONS
    assert all(got[t]["topics"] == [] and got[t]["matched_terms"] == {} and got[t]["sectors"] == [] for t in REASONS)


def test_default_taxonomy_gives_evidence_and_sectors(label):
    got = label(["American ＣＰＩ print", "Washington state Senate election 2026", "US tariffs_on steel", "US debt-ceiling vote", "US debt\t \n_ceiling vote"])
    assert got["American ＣＰＩ print"]["matched_terms"]["us_macro"] == ["CPI"]
    assert got["US tariffs_on steel"]["matched_terms"].get("trade_tariffs") != ["tariffs"]  # an underscore is part of a word
    assert got["US debt-ceiling vote"]["topics"] == got["US debt\t \n_ceiling vote"]["topics"] != []
    race = got["Washington state Senate election 2026"]
    assert race["exclude_reason"] is None and race["relevance_score"] == len(race["topics"]) + 5
    assert race["sectors"] == sorted({s for t in race["topics"] for s in Taxonomy.default().sectors(t)})


def test_custom_taxonomy_from_file(label, tmp_path):
    config = {
        "us_context_terms": ["harbour", "&&"],
        "topics": {
            "ships": {"terms": ["cargo", "cargo ship", "ship-yard", "R&D", "++"], "queries": ["harbour cargo", "dry dock"], "sectors": ["freight"]},
            "tides": {"terms": ["ebb"], "patterns": {"spring": r"\bspring\b.{0,5}\btide\b"}, "queries": ["dry dock"]},
        },
    }
    path = tmp_path / "rules.json"
    path.write_text("﻿" + json.dumps(config), encoding="utf-8")
    taxonomy = Taxonomy.load(path)
    assert taxonomy.queries() == ["harbour cargo", "dry dock"] and taxonomy.queries(["tides"]) == ["dry dock"]
    with pytest.raises(ValueError, match="Unknown topics: docks"):
        taxonomy.check_topics(["ships", "docks"])
    texts = ["harbour CARGO ship", "harbour cargo, ship", "harbour ship_yard", "harbour r&d", "harbour r & d", "&& ++", "harbour Spring of tide", "cargo", "harbour"]
    got = {t: r["matched_terms"] for t, r in label(texts, taxonomy).items()}
    assert got == {
        "harbour CARGO ship": {"ships": ["cargo", "cargo ship"]}, "harbour cargo, ship": {"ships": ["cargo"]}, "harbour ship_yard": {"ships": ["ship-yard"]},
        "harbour r&d": {"ships": ["R&D"]}, "harbour r & d": {}, "&& ++": {"ships": ["++"]}, "harbour Spring of tide": {"tides": ["spring"]}, "cargo": {}, "harbour": {},
    }


def test_the_index_finds_what_the_patterns_find(spark):
    """Brute force: every term's pattern on every text."""
    taxonomy = Taxonomy.default()
    terms = [(f"topic {t}", w) for t in taxonomy.topics for w in taxonomy.terms(t)] + [(f"group {g}", w) for g in ("us_context_terms", "us_state_terms", "foreign_context_terms", "sports_terms") for w in taxonomy.group(g)]
    words = sorted({w for _, w in terms})
    texts = [f"{a.upper()}{gap}{b.lower()}" for k, gap in enumerate([" ", "-", "_", ", ", "", "\n", "'s "]) for a, b in zip(words[k::5], words[k + 3 :: 5], strict=False)]
    df = spark.createDataFrame([(t,) for t in texts], "text STRING")
    index = TermIndex.of(taxonomy)
    from oddslake.functions import computed, tokens

    runs = computed(df.withColumn("tokens", tokens(F.col("text"))), runs=index.runs(F.col("tokens")))
    got = {r["text"]: {(f["slot"], f["label"]) for f in r["found"] if f["slot"] != "token"} for r in computed(runs, found=index.found(F.col("text"), F.col("runs"))).collect()}
    tests = F.array_compact(F.array(*[F.when(F.col("text").rlike(term_pattern(w)), F.lit(w)) for w in words]))
    want = {r["text"]: set(r["w"]) for r in df.select("text", tests.alias("w")).collect()}
    assert {t: {w for _, w in f} for t, f in got.items()} == want
    assert all({s for s, w in f if w == x} == {s for s, w in terms if w == x} for f in got.values() for x in {w for _, w in f})


def test_a_taxonomy_without_terms(label):
    got = label(["anything", "2026"], Taxonomy({"topics": {"empty": {}}}))
    assert {r["exclude_reason"] for r in got.values()} == {"missing_us_context"}
    assert exclusion_reason(Text(F.lit("x"), F.array(F.lit("x")), F.array().cast("array<struct<slot:string,label:string>>")), Taxonomy({"topics": {}})) is not None


def test_queries_keep_first_seen_order():
    queries = Taxonomy.default().queries()
    assert queries[0] == "2026 midterms" and len(queries) == len(set(queries))
