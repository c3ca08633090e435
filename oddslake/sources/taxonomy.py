"""The topic taxonomy: small driver-side configuration that becomes literal expressions.

The default lists below are fixed values: labels are only comparable when the words, the
named patterns and the sector and query seeds are the same. A JSON file of the same shape
replaces them (``Taxonomy.load``).
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

GROUPS = ("us_context_terms", "us_state_terms", "foreign_context_terms", "sports_terms")

# Words that place a text in the United States.
US_CONTEXT_TERMS = [
    "United States", "U.S.", "US", "American", "White House", "Federal Reserve", "FOMC",
    "federal funds", "Fed funds", "Fed rate", "Fed interest", "Fed decision", "Fed cut",
    "Fed hike", "Fed chair", "Powell", "Trump", "Biden", "Harris", "Vance", "Democrats",
    "Republicans", "Democratic Party", "Republican Party", "GOP", "House of Representatives",
    "nonfarm payrolls", "PCE", "BLS", "BEA", "USMCA", "Medicare", "Medicaid",
    "Affordable Care Act", "Obamacare", "EPA", "CFPB", "US Treasury", "U.S. Treasury",
    "SALT deduction", "GENIUS Act", "CLARITY Act", "Section 230",
]
# State names; "Georgia" is left to a pattern because it is also a country.
US_STATE_TERMS = [
    "Alabama", "Alaska", "Arizona", "Arkansas", "California", "Colorado", "Connecticut",
    "Delaware", "Florida", "Hawaii", "Idaho", "Illinois", "Indiana", "Iowa", "Kansas",
    "Kentucky", "Louisiana", "Maine", "Maryland", "Massachusetts", "Michigan", "Minnesota",
    "Mississippi", "Missouri", "Montana", "Nebraska", "Nevada", "New Hampshire", "New Jersey",
    "New Mexico", "New York", "North Carolina", "North Dakota", "Ohio", "Oklahoma", "Oregon",
    "Pennsylvania", "Rhode Island", "South Carolina", "South Dakota", "Tennessee", "Texas",
    "Utah", "Vermont", "Virginia", "Washington state", "West Virginia", "Wisconsin", "Wyoming",
]
# Words that place a text outside the United States.
FOREIGN_CONTEXT_TERMS = [
    "United Kingdom", "British", "UK", "Britain", "Canada", "Canadian", "Mexico", "Mexican",
    "Brazil", "Brazilian", "France", "French", "Germany", "German", "India", "Indian", "Japan",
    "Japanese", "China", "Chinese", "Australia", "Australian", "New Zealand", "Taiwan",
    "Taiwanese", "South Korea", "Korean", "Israel", "Israeli", "Turkey", "Turkish", "Argentina",
    "Argentine", "Netherlands", "Dutch", "Romania", "Romanian", "Poland", "Polish",
    "Philippines", "Philippine", "South Africa", "South African", "European Central Bank",
    "ECB", "Bank of England", "Bank of Japan", "Reserve Bank", "prime minister", "parliament",
]
# Sports vocabulary.
SPORTS_TERMS = [
    "NFL", "NBA", "NHL", "MLB", "NCAA", "Super Bowl", "World Series", "Stanley Cup",
    "World Cup", "Premier League", "Champions League", "touchdown", "home runs", "tennis",
    "Roger Federer", "Federer", "cricket", "basketball", "football", "baseball", "soccer",
]

# The named patterns of the election and central-bank topics.
CONGRESSIONAL_RACE = (
    r"\b(?:senate|house|congressional)\b.{0,65}\b(?:win|winner|seat|election|race|majority|control)\b"
    r"|\b(?:win|winner|control)\b.{0,65}\b(?:senate|house|congress)\b"
)
DISTRICT_CODE = (
    r"\b(?:AL|AK|AZ|AR|CA|CO|CT|DE|FL|GA|HI|ID|IL|IN|IA|KS|KY|LA|ME|MD|MA|MI|MN|MS|MO|MT|NE|NV|NH|NJ"
    r"|NM|NY|NC|ND|OH|OK|OR|PA|RI|SC|SD|TN|TX|UT|VT|VA|WA|WV|WI|WY)-\d{1,2}\b"
)
FED_POLICY = r"\bfed\b.{0,55}\b(?:cut|hike|raise|lower|hold|interest|rate|chair|meeting|independence)\b"

# The twelve topics, each with its terms, sector hypotheses and search seeds.
MIDTERMS_2026 = {
    "label": "2026 US midterms and congressional control",
    "terms": [
        "midterm", "midterms", "congressional control", "control the House",
        "control of the House", "control the Senate", "control of the Senate", "House majority",
        "Senate majority", "Senate election", "Senate race", "House election", "House race",
        "congressional election", "congressional district", "governor", "gubernatorial",
        "redistricting", "generic ballot",
    ],
    "patterns": {"congressional race": CONGRESSIONAL_RACE, "district code": DISTRICT_CODE},
    "requires_election_cycle": True,
    "sectors": ["broad_equities", "policy_sensitive_sectors"],
    "queries": [
        "2026 midterms", "2026 House control", "2026 Senate control", "2026 Senate election",
        "2026 congressional district", "2026 governor", "2026 redistricting", "generic ballot",
    ],
}
FED_MONETARY_POLICY = {
    "label": "Federal Reserve policy and rate decisions",
    "terms": [
        "Federal Reserve", "FOMC", "federal funds", "Fed funds", "Fed rate", "Fed interest",
        "Fed decision", "Fed cut", "Fed hike", "Fed chair", "Powell", "quantitative tightening",
        "quantitative easing", "balance sheet runoff",
    ],
    "patterns": {"Fed policy": FED_POLICY},
    "sectors": ["banks", "real_estate", "duration_sensitive_equities", "utilities"],
    "queries": ["Fed interest rates", "FOMC", "Federal Reserve", "Fed chair", "quantitative tightening"],
}
US_MACRO = {
    "label": "US inflation, growth, labor and activity",
    "terms": [
        "inflation", "CPI", "PCE", "GDP", "gross domestic product", "recession", "unemployment",
        "nonfarm payrolls", "payroll", "jobless claims", "retail sales", "consumer confidence",
        "ISM", "housing starts", "mortgage rates", "personal consumption expenditures",
        "consumer price index", "producer price index", "PPI", "jobs report",
    ],
    "sectors": ["broad_equities", "consumer_discretionary", "banks", "homebuilders"],
    "queries": [
        "US inflation", "CPI", "PCE", "US GDP", "US recession", "unemployment",
        "nonfarm payrolls", "US retail sales", "ISM",
    ],
}
US_POLITICS = {
    "label": "US governance, elections and legislative change",
    "terms": [
        "president", "presidential", "election", "midterm", "midterms", "Congress", "Senate",
        "House of Representatives", "White House", "executive order", "impeach", "impeachment",
        "government shutdown", "confirmation", "Supreme Court", "redistricting", "governor",
        "gubernatorial", "Democrats", "Republicans", "GOP", "generic ballot", "veto",
        "filibuster",
    ],
    "sectors": ["policy_sensitive_sectors"],
    "queries": [
        "US politics", "Congress", "government shutdown", "executive order", "Supreme Court",
        "2026 election",
    ],
}
DATA_CENTERS_AI_POWER = {
    "label": "Data center siting, AI infrastructure and electricity affordability",
    "terms": [
        "data center", "data centers", "data centre", "data centres", "datacenter",
        "datacenters", "AI infrastructure", "artificial intelligence", "electricity prices",
        "electricity bills", "power prices", "power bills", "electric grid", "power grid",
        "grid interconnection", "transmission permitting", "hyperscaler", "water use",
        "utility rates",
    ],
    "sectors": [
        "data_center_reits", "semiconductors", "hyperscalers", "utilities",
        "electrical_equipment", "natural_gas",
    ],
    "queries": [
        "data center ban", "data center moratorium", "data centre", "AI regulation",
        "electricity prices", "power grid", "transmission permitting",
    ],
}
ENERGY_CLIMATE = {
    "label": "Energy production, climate policy and permitting",
    "terms": [
        "climate policy", "climate change", "carbon tax", "carbon emissions", "clean energy",
        "renewable energy", "solar subsidies", "wind power", "offshore wind", "nuclear power",
        "LNG export", "LNG exports", "fracking", "oil drilling", "pipeline",
        "energy permitting", "EPA", "EV mandate", "electric vehicle", "Inflation Reduction Act",
    ],
    "sectors": ["oil_gas", "renewables", "utilities", "autos", "industrials"],
    "queries": [
        "US energy policy", "LNG export", "US permitting", "EPA", "offshore wind",
        "Inflation Reduction Act", "EV mandate",
    ],
}
TRADE_TARIFFS = {
    "label": "Trade restrictions, tariffs and export controls",
    "terms": [
        "tariff", "tariffs", "trade war", "trade deal", "export controls", "export ban",
        "USMCA", "import tax", "import duties", "semiconductor export", "reciprocal tariffs",
    ],
    "sectors": ["retail", "autos", "semiconductors", "industrials", "agriculture"],
    "queries": ["US tariffs", "Trump tariff", "US China trade", "export controls", "USMCA"],
}
IMMIGRATION_LABOR = {
    "label": "Immigration, labor supply and wage regulation",
    "terms": [
        "immigration", "deportation", "deportations", "border security", "H-1B", "work visa",
        "work visas", "minimum wage", "labor union", "labour union", "collective bargaining",
        "migrant workers",
    ],
    "sectors": ["agriculture", "construction", "hospitality", "technology_services", "staffing"],
    "queries": ["US immigration", "deportations", "H-1B", "US minimum wage", "border security"],
}
FISCAL_TAXES_DEBT = {
    "label": "Tax, spending, debt ceiling and fiscal policy",
    "terms": [
        "corporate tax", "corporate taxes", "capital gains tax", "tax cut", "tax cuts",
        "tax hike", "tax hikes", "debt ceiling", "federal deficit", "budget deficit",
        "federal spending", "government shutdown", "reconciliation bill", "Treasury default",
        "debt limit", "fiscal stimulus", "SALT deduction",
    ],
    "sectors": ["broad_equities", "defense", "government_contractors", "municipal_finance", "banks"],
    "queries": [
        "US corporate tax", "tax cuts", "debt ceiling", "government shutdown", "federal budget",
        "reconciliation bill",
    ],
}
HEALTHCARE_DRUG_PRICING = {
    "label": "Healthcare coverage and drug price policy",
    "terms": [
        "Medicare", "Medicaid", "Affordable Care Act", "Obamacare", "drug pricing",
        "drug prices", "drug price", "pharmaceutical tariffs", "health insurance",
        "ACA subsidies", "PBM", "pharmacy benefit", "most favored nation drug",
    ],
    "sectors": ["pharmaceuticals", "managed_care", "hospitals", "pharmacy_benefit_managers"],
    "queries": ["Medicare", "Medicaid", "ACA subsidies", "drug prices", "PBM regulation"],
}
FINANCIAL_REGULATION = {
    "label": "Bank, crypto and financial regulation",
    "terms": [
        "bank regulation", "bank capital", "Basel III", "Dodd Frank", "Dodd-Frank", "CFPB",
        "SEC regulation", "stablecoin bill", "stablecoin regulation", "crypto regulation",
        "crypto bill", "digital asset legislation", "credit card cap", "credit card interest",
        "GENIUS Act", "CLARITY Act",
    ],
    "sectors": ["banks", "consumer_finance", "exchanges", "crypto_infrastructure", "payments"],
    "queries": [
        "US bank regulation", "CFPB", "stablecoin bill", "crypto regulation",
        "credit card interest cap", "CLARITY Act",
    ],
}
ANTITRUST_TECH = {
    "label": "Antitrust, platform and technology regulation",
    "terms": [
        "antitrust", "FTC", "DOJ lawsuit", "Google breakup", "Google break up", "monopoly",
        "app store regulation", "TikTok ban", "social media regulation", "AI regulation",
        "AI safety", "Section 230",
    ],
    "sectors": ["internet_platforms", "software", "advertising", "media"],
    "queries": ["US antitrust", "FTC", "Google breakup", "TikTok ban", "AI regulation", "Section 230"],
}
TOPICS = {
    "midterms_2026": MIDTERMS_2026,
    "fed_monetary_policy": FED_MONETARY_POLICY,
    "us_macro": US_MACRO,
    "us_politics": US_POLITICS,
    "data_centers_ai_power": DATA_CENTERS_AI_POWER,
    "energy_climate": ENERGY_CLIMATE,
    "trade_tariffs": TRADE_TARIFFS,
    "immigration_labor": IMMIGRATION_LABOR,
    "fiscal_taxes_debt": FISCAL_TAXES_DEBT,
    "healthcare_drug_pricing": HEALTHCARE_DRUG_PRICING,
    "financial_regulation": FINANCIAL_REGULATION,
    "antitrust_tech": ANTITRUST_TECH,
}


@dataclass(frozen=True)
class Taxonomy:
    """Context word groups plus topic rules. Missing groups and rule parts are empty."""

    config: dict

    @classmethod
    def default(cls) -> Taxonomy:
        lists = (US_CONTEXT_TERMS, US_STATE_TERMS, FOREIGN_CONTEXT_TERMS, SPORTS_TERMS)
        return cls({**dict(zip(GROUPS, lists)), "topics": TOPICS})

    @classmethod
    def load(cls, path: str | Path) -> Taxonomy:
        """Read a JSON configuration file; a byte-order mark is tolerated."""
        return cls(json.loads(Path(path).read_text(encoding="utf-8-sig")))

    @property
    def topics(self) -> dict[str, dict]:
        return self.config["topics"]

    def group(self, name: str) -> list[str]:
        return self.config.get(name, [])

    def terms(self, topic: str) -> list[str]:
        return self.topics[topic].get("terms", [])

    def patterns(self, topic: str) -> dict[str, str]:
        return self.topics[topic].get("patterns", {})

    def sectors(self, topic: str) -> list[str]:
        return self.topics[topic].get("sectors", [])

    def queries(self, topics: Iterable[str] | None = None) -> list[str]:
        """Search seeds of the chosen topics, each once, in first-seen order."""
        chosen = self.topics if topics is None else topics
        return list(dict.fromkeys(q for t in chosen for q in self.topics[t].get("queries", [])))

    def check_topics(self, topics: Iterable[str] | None) -> None:
        unknown = sorted(set(topics or []) - set(self.topics))
        if unknown:
            raise ValueError("Unknown topics: " + ", ".join(unknown))

    def dimensions(self, spark: SparkSession) -> dict[str, DataFrame]:
        """The configuration as three tables: topic terms, sectors and queries."""

        def table(kind: str, column: str) -> DataFrame:
            rows = [(t, i, v) for t, rule in self.topics.items() for i, v in enumerate(rule.get(kind, []))]
            return spark.createDataFrame(rows, f"topic STRING, pos INT, {column} STRING")

        return {
            "topic_terms": table("terms", "term"),
            "topic_sectors": table("sectors", "sector"),
            "topic_queries": table("queries", "query"),
        }
