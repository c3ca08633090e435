"""Topic labels as native expressions.

All terms of a taxonomy form one index by their tokens. One pass over a text's tokens looks at the places
where the first token of some term stands and at the runs of tokens that begin there; what is in the
index are the hits. A hit of a single word needs no further test, any other runs its own pattern, once.
Evidence, context and labels are then read from the few hits of a text.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddslake.functions import computed, nfkc, python_lines, term_pattern, term_tokens, tokens
from oddslake.sources.taxonomy import Taxonomy

# Extra United States context, the election words and the year shape.
GEORGIA_OFFICE = (
    r"\bGeorgia\b.{0,35}\b(?:senate|governor|gubernatorial|district)\b"
    r"|\b(?:senate|governor|gubernatorial)\b.{0,35}\bGeorgia\b"
)
FED_RATE = r"\bFed\b.{0,55}\b(?:rate|cut|hike|hold|chair|interest|meeting|independence)\b"
CHAMBER_SHORTHAND = (
    r"\b(?:midterms?|congressional|senate|congress)\b"
    r"|\b(?:house majority|house control|control the house|control of the house|house election)\b"
)
ELECTION_WORDS = (
    r"\b(?:midterms?|congressional|senate|house|governor|gubernatorial|election|generic ballot|redistricting)\b"
)
MIDTERM_WORD = r"\bmidterms?\b"
YEAR = r"\b(20\d{2})\b"
ELECTION_TOPIC, CYCLE_YEAR, DISTRICT_RULE = "midterms_2026", "2026", "district code"

LABEL_COLUMNS = ["topics", "matched_terms", "sectors", "relevance_score", "exclude_reason"]


#: Slots of the context groups in the index; topics have their names as slots.
CONTEXT_GROUPS = ["us_context_terms", "us_state_terms", "foreign_context_terms", "sports_terms"]
#: Tokens one of which stands in every text that matches a fixed pattern.
PATTERN_TOKENS = {
    GEORGIA_OFFICE: ["georgia"],
    FED_RATE: ["fed"],
    CHAMBER_SHORTHAND: ["midterm", "midterms", "congressional", "senate", "congress", "house", "control"],
    MIDTERM_WORD: ["midterm", "midterms"],
}
_FOUND = "array<struct<slot:string,label:string,topic:string>>"


@dataclass(frozen=True)
class TermIndex:
    """Terms by their tokens: for each run of tokens the rules that a text with that run may meet."""

    rules: dict[str, list[dict]] = field(default_factory=lambda: defaultdict(list))
    #: Terms without a letter or digit, which no token announces.
    loose: list[tuple[str, str]] = field(default_factory=list)

    @classmethod
    def of(cls, taxonomy: Taxonomy) -> TermIndex:
        index = cls()
        for group in CONTEXT_GROUPS:
            for term in taxonomy.group(group):
                index.add(f"group {group}", term)
        for topic in taxonomy.topics:
            for term in taxonomy.terms(topic):
                index.add(f"topic {topic}", term)
        for token in sorted({t for group in PATTERN_TOKENS.values() for t in group}):
            index.add("token", token)
        return index

    def add(self, slot: str, term: str) -> None:
        words = term_tokens(term)
        if not words:
            self.loose.append((slot, term))
            return
        # One run of letters and digits and nothing else: a token equal to it is the term, unless an
        # underscore stands beside it.
        plain = [term.casefold().replace("ς", "σ")] == words
        rule = {"slot": slot, "label": term, "topic": _topic(slot), "pattern": term_pattern(term), "plain": plain}
        self.rules[" ".join(words)].append(rule)

    def runs(self, words: Column) -> Column:
        """The runs of tokens of a text that are in the index, each once."""
        keys = sorted(self.rules)
        if not keys:
            return F.array().cast("array<string>")
        longest = max(k.count(" ") for k in keys) + 1
        firsts = sorted({k.split(" ")[0] for k in keys})
        several = sorted({k.split(" ")[0] for k in keys if " " in k})
        run = lambda i, n: F.array_join(F.slice(words, i + 1, n), " ")
        begin = lambda w, i: F.when(w.isin(several), F.array(w, *[run(i, n) for n in range(2, longest + 1)]))
        none = F.array().cast("array<string>")
        begun = F.flatten(F.transform(words, lambda w, i: begin(w, i).when(w.isin(firsts), F.array(w)).otherwise(none)))
        return F.array_distinct(F.filter(begun, lambda r: r.isin(keys)))

    def found(self, text: Column, runs: Column) -> Column:
        """Slot, label and topic of the terms the text holds, given its ``runs``."""
        rules = F.from_json(F.lit(json.dumps(self.rules)), "map<string,array<struct<slot:string,label:string,topic:string,pattern:string,plain:boolean>>>")
        bare = ~text.contains("_")
        met = lambda rule: (rule["plain"] & bare) | F.rlike(text, rule["pattern"])
        out = F.transform(F.flatten(F.transform(runs, lambda r: F.filter(F.element_at(rules, r), met))), lambda r: F.struct(r["slot"], r["label"], r["topic"]))
        if self.loose:
            tests = [F.when(text.rlike(term_pattern(term)), _hit(slot, term)) for slot, term in self.loose]
            out = F.concat(out, F.array_compact(F.array(*tests)))
        return out.cast(_FOUND)


def _topic(slot: str) -> str | None:
    return slot.removeprefix("topic ") if slot.startswith("topic ") else None


def _hit(slot: str, label: str) -> Column:
    return F.struct(F.lit(slot).alias("slot"), F.lit(label).alias("label"), F.lit(_topic(slot)).cast("string").alias("topic"))


@dataclass(frozen=True)
class Text:
    """A text column with the runs of its tokens that are in the index, and the slots of the terms found."""

    text: Column
    runs: Column
    slots: Column

    def has_group(self, group: str) -> Column:
        return F.array_contains(self.slots, f"group {group}")

    def matches(self, pattern: str) -> Column:
        """Case-insensitive search for one of the fixed patterns."""
        announced = F.arrays_overlap(self.runs, F.array(*[F.lit(t) for t in PATTERN_TOKENS[pattern]]))
        return announced & self.text.rlike("(?iuUd)" + pattern)

    def matches_case(self, pattern: str) -> Column:
        return self.text.rlike("(?Ud)" + pattern)


def explicit_cycle(t: Text) -> Column:
    """True when the headline, or else the first dated election line, names the cycle year.

    "midterms" anywhere also counts, provided neither line carries a year.
    """
    none = F.array().cast("array<string>")
    years_of = lambda line: F.coalesce(F.regexp_extract_all(line, F.lit(YEAR), 1), none)
    lines = F.filter(python_lines(t.text), lambda line: line.rlike(r"(?U)[^\s\x1c-\x1f]"))
    dated = F.filter(lines, lambda line: line.rlike(YEAR) & line.rlike("(?iuUd)" + ELECTION_WORDS))
    headline, election = years_of(F.get(lines, 0)), years_of(F.get(dated, 0))
    years = F.when(F.size(headline) > 0, headline).otherwise(election)
    undated = (F.size(years) == 0) & t.matches(MIDTERM_WORD)
    return F.array_contains(years, CYCLE_YEAR) | undated


def exclusion_reason(t: Text, taxonomy: Taxonomy) -> Column:
    """Why a text is out of scope, or null; sports first, then foreign, then no US link."""
    us, state, foreign, sports = (t.has_group(g) for g in CONTEXT_GROUPS)
    district_rule = taxonomy.topics.get(ELECTION_TOPIC, {}).get("patterns", {}).get(DISTRICT_RULE)
    district = t.matches_case(district_rule) if district_rule else F.lit(False)
    return (
        F.when(sports, F.lit("sports_context"))
        .when(us | t.matches(FED_RATE), F.lit(None).cast("string"))
        .when(foreign, F.lit("foreign_context_without_explicit_us_link"))
        .when(~(state | t.matches(GEORGIA_OFFICE) | t.matches(CHAMBER_SHORTHAND) | district), F.lit("missing_us_context"))
    )


def pattern_evidence(text: Column, taxonomy: Taxonomy) -> Column:
    """Slot, label and topic of the taxonomy's own patterns that a text matches, ignoring case."""
    tests = [
        F.when(text.rlike("(?iuUd)" + pattern), _hit(f"topic {topic}", label))
        for topic in taxonomy.topics
        for label, pattern in taxonomy.patterns(topic).items()
    ]
    return F.array_compact(F.array(*tests)).cast(_FOUND) if tests else F.array().cast(_FOUND)


def classify(df: DataFrame, text_col: str, taxonomy: Taxonomy | None = None) -> DataFrame:
    """Add topics, matched_terms, sectors, relevance_score and exclude_reason to each row."""
    taxonomy = taxonomy or Taxonomy.default()
    index = TermIndex.of(taxonomy)
    text = Text(F.col("__text"), F.col("__runs"), F.col("__found.slot"))
    # Plain projections up to the labels: a generator copies the whole row, and the one at the end keeps filters on
    # any label above all of them. Spark merges projections only where a column is read once, so no column may be
    # read just inside a lambda, where it would be made again for each element.
    composed = df.withColumn("__text", nfkc(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    announced = composed.withColumn("__tokens", tokens(text.text)).withColumn("__runs", index.runs(F.col("__tokens"))).drop("__tokens")
    met = announced.withColumn("__found", index.found(text.text, text.runs))
    reasoned = met.withColumn("__why", exclusion_reason(text, taxonomy))
    terms = F.concat(F.filter("__found", lambda f: f["topic"].isNotNull()), pattern_evidence(text.text, taxonomy))
    evidence = reasoned.withColumn("__evidence", F.when(F.col("__why").isNull(), terms).otherwise(F.array().cast(_FOUND)))
    dated = [t for t in sorted(taxonomy.topics) if taxonomy.topics[t].get("requires_election_cycle")]
    kept = F.col("__evidence")
    if dated:
        # The election cycle is only looked for where a topic depends on it.
        asks = F.arrays_overlap("__evidence.topic", F.array(*[F.lit(t) for t in dated]))
        evidence = evidence.withColumn("__cycle", F.when(asks, explicit_cycle(text)))
        kept = F.when(F.col("__cycle"), kept).otherwise(F.filter(kept, lambda f: ~f["topic"].isin(dated)))
    chosen = evidence.withColumn("__chosen", kept)
    names = F.sort_array(F.array_distinct("__chosen.topic"))
    labelled = computed(chosen, __topics=names, __kept=F.col("__chosen"), __reason=F.col("__why"))
    topics = F.col("__topics")
    terms_of = lambda n: F.transform(F.filter("__kept", lambda f: f["topic"] == n), lambda f: f["label"])
    sectors = F.from_json(F.lit(json.dumps({t: taxonomy.sectors(t) for t in taxonomy.topics})), "map<string,array<string>>")
    return labelled.select(
        *df.columns,
        topics.alias("topics"),
        F.map_from_arrays(topics, F.transform(topics, lambda n: F.sort_array(F.array_distinct(terms_of(n))))).alias("matched_terms"),
        F.sort_array(F.array_distinct(F.flatten(F.transform(topics, lambda n: F.element_at(sectors, n))))).alias("sectors"),
        (F.size(topics) + F.when(F.array_contains(topics, ELECTION_TOPIC), 5).otherwise(0)).alias("relevance_score"),
        F.coalesce(F.col("__reason"), F.when(F.size(topics) == 0, F.lit("no_target_topic"))).alias("exclude_reason"),
    )


def select_topics(df: DataFrame, topics: Sequence[str] | None = None) -> DataFrame:
    """Keep labelled rows; with ``topics``, only those sharing at least one."""
    labelled = df.filter(F.size("topics") > 0)
    if not topics:
        return labelled
    return labelled.filter(F.arrays_overlap("topics", F.array(*[F.lit(t) for t in topics])))


def topic_sector_pairs(df: DataFrame, taxonomy: Taxonomy, keys: Sequence[str]) -> DataFrame:
    """Label rows joined to their sectors: one row per (keys, topic, sector)."""
    sectors = taxonomy.dimensions(df.sparkSession)["topic_sectors"].select("topic", "sector")
    exploded = df.select(*keys, F.explode("topics").alias("topic"))
    # The sector dimension is a fixed configuration of well under a thousand rows.
    return exploded.join(F.broadcast(sectors), "topic")
