"""Secrets by pattern, and by a battery of randomness tests, in DataFrame expressions only.

Three patterns give the base spans. The battery adds spans: every long run of token characters gets
an encoding (hexadecimal, base 32, base 36 or base 64) and, under the hypothesis that its symbols
are drawn uniformly and independently, three tests: chi-squared on the counts of the alphabet, runs
above and below the alphabet's middle, and serial correlation at lag one. Their p-values are combined
by Fisher's method. In each band of lengths the Benjamini-Hochberg procedure decides which runs are
not random, so that of the runs set aside at most a stated share is random; the others are reported.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from oddslake.functions.computed import computed
from oddslake.llm.common import whole_text
from oddslake.session import stored

# The base patterns. The lengths of hex and access keys are part of the pattern, which
# changes nothing, for what starts inside a shorter run is shorter still.
ASSIGN = r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")

#: A run that may be an encoded secret, and the least symbols of it.
RUN = r"[A-Za-z0-9+/_-]{20,}"
#: Parts of a run that has separators of both base 64 alphabets, which no encoding holds together.
PARTS = (r"[A-Za-z0-9+/]{20,}", r"[A-Za-z0-9_-]{20,}")
#: Share of random runs among those set aside; upper ends of the length bands; steps per decade of p.
FALSE_SHARE, BANDS, STEPS = 0.05, (32, 48, 80), 100
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Encodings, in the order in which they are tried: pattern, then alphabet.
ENCODINGS = (
    (r"^[0-9a-f]+$", _DIGITS + "abcdef"),
    (r"^[0-9A-F]+$", _DIGITS + "ABCDEF"),
    (r"^[A-Z2-7]+$", _UPPER + "234567"),
    (r"^[a-z0-9]+$", _DIGITS + _LOWER),
    (r"^[A-Za-z0-9+/]+$", _UPPER + _LOWER + _DIGITS + "+/"),
    (r"^[A-Za-z0-9_-]+$", _UPPER + _LOWER + _DIGITS + "-_"),
)


def located(text: Column, pattern: str, kind: int, group: int = 0, least: int = 0) -> Column:
    """Matches as an array of (start, rank, end, value), positions in code points.

    The pieces between the matches and the matches themselves add up to the text, so their lengths
    give the positions. ``value`` is the group; matches with a shorter one than ``least`` go last.
    """
    lit = F.lit(pattern)
    found = F.regexp_extract_all(text, lit, F.lit(0))
    values = found if group == 0 else F.regexp_extract_all(text, lit, F.lit(group))
    both = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("hit"), values.alias("value"))
    none = F.array().cast("array<struct<start:int,rank:int,end:int,value:string>>")
    placed = F.aggregate(
        both,
        F.struct(F.lit(0).alias("at"), none.alias("out")),
        lambda a, x: F.struct(
            (a["at"] + F.length(x["gap"]) + F.coalesce(F.length(x["hit"]), F.lit(0))).alias("at"),
            F.when(x["hit"].isNull(), a["out"]).otherwise(
                F.array_append(
                    a["out"],
                    F.struct(
                        (a["at"] + F.length(x["gap"])).alias("start"), F.lit(kind).alias("rank"),
                        (a["at"] + F.length(x["gap"]) + F.length(x["hit"])).alias("end"), x["value"].alias("value"),
                    ),
                )
            ).alias("out"),
        ),
        lambda a: a["out"],
    )
    return F.when(F.size(found) == 0, none).otherwise(F.filter(placed, lambda x: F.length(x["value"]) >= least))


def split_run(run: Column) -> Column:
    """The run as (start, rank, end, value) if one alphabet may hold it, else its parts in either alphabet."""
    both = run["value"].rlike("[+/]") & run["value"].rlike("[_-]")
    moved = lambda x: F.struct((run["start"] + x["start"]).alias("start"), x["rank"].alias("rank"), (run["start"] + x["end"]).alias("end"), x["value"].alias("value"))
    parts = F.array_distinct(F.concat(*[located(run["value"], p, 3) for p in PARTS]))
    return F.when(both, F.transform(parts, moved)).otherwise(F.array(run))


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row, without its text: row, doc_id, base spans by kind, and the runs to be tested."""
    rows = computed(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("raw")), text=whole_text("raw"))
    text = F.col("text")
    lettered = lambda x: x["value"].rlike("[A-Za-z]")
    bare = lambda a: F.transform(a, lambda x: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end")))
    return rows.select(
        F.monotonically_increasing_id().alias("row"), "doc_id",
        bare(located(text, ASSIGN, 0, 1, 6)).alias("assign"), bare(located(text, ACCESS, 1)).alias("access"), bare(located(text, HEX, 2)).alias("hex"),
        F.filter(F.flatten(F.transform(located(text, RUN, 3), split_run)), lettered).alias("runs"),
    )


def upper_tail(z: Column) -> Column:
    """Probability that a standard normal exceeds z, by a rational approximation of the error function."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    half = poly * F.exp(-x * x) / 2
    return F.when(z >= 0, half).otherwise(1 - half)


def battery(runs: DataFrame, value: str = "value") -> DataFrame:
    """Add ``symbols``, their number, and ``p``, the combined p-value; rows without encoding go."""
    alphabet = F.coalesce(*[F.when(F.col(value).rlike(p), F.lit(a)) for p, a in ENCODINGS])
    runs = computed(runs, alphabet=alphabet).where(F.col("alphabet").isNotNull())
    runs = computed(runs, ix=F.transform(F.split(value, ""), lambda c: F.call_function("instr", F.col("alphabet"), c) - 1), k=F.length("alphabet"))
    n = F.size("ix")
    squares = F.aggregate(F.sequence(F.lit(0), F.col("k") - 1), F.lit(0).cast("bigint"), lambda a, c: a + F.pow(F.size(F.filter("ix", lambda x: x == c)), F.lit(2)).cast("bigint"))
    changes = F.aggregate(F.sequence(F.lit(1), n - 1), F.lit(0), lambda a, i: a + ((2 * F.get("ix", i) >= F.col("k")) != (2 * F.get("ix", i - 1) >= F.col("k"))).cast("int"))
    middle = (F.col("k") - 1) / 2
    lagged = F.aggregate(F.sequence(F.lit(1), n - 1), F.lit(0.0), lambda a, i: a + (F.get("ix", i) - middle) * (F.get("ix", i - 1) - middle))
    runs = computed(runs, symbols=n, squares=squares, changes=changes, lagged=lagged)
    n, df = F.col("symbols"), F.col("k") - 1
    chi2 = F.col("k") * F.col("squares") / n - n
    z_chi = (F.pow(chi2 / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
    z_runs = (F.col("changes") - (n - 1) / 2) / (F.sqrt(n - 1) / 2)
    z_lag = F.col("lagged") / (F.sqrt(n - 1) * (F.col("k") * F.col("k") - 1) / 12)
    log_p = lambda p: F.log(F.greatest(F.least(p, F.lit(1.0)), F.lit(1e-30)))
    runs = computed(runs, half=-(log_p(upper_tail(z_chi)) + log_p(2 * upper_tail(F.abs(z_runs))) + log_p(2 * upper_tail(F.abs(z_lag)))))
    half = F.col("half")
    p = F.exp(-half) * (1 + half + half * half / 2)  # chi-squared of 2 * half with six degrees of freedom
    return runs.withColumn("p", p).drop("alphabet", "ix", "k", "squares", "changes", "lagged", "half")


def not_random(tested: DataFrame, share: float = FALSE_SHARE) -> dict[int, int]:
    """Per length band the least step of -log10 p from which a run counts as not random.

    The procedure runs on counts by step, a bounded table, and not on the sorted runs.
    """
    counts = tested.groupBy("band", "step").agg(F.count(F.lit(1)).alias("n"))
    down = W.partitionBy("band").orderBy(F.desc("step")).rowsBetween(W.unboundedPreceding, W.currentRow)
    total = F.sum("n").over(W.partitionBy("band"))
    passed = counts.select("band", "step", F.sum("n").over(down).alias("upto"), total.alias("total"))
    passed = passed.where(F.pow(F.lit(10.0), -F.col("step") / STEPS) <= share * F.col("upto") / F.col("total"))
    return {r["band"]: r["least"] for r in passed.groupBy("band").agg(F.min("step").alias("least")).collect()}


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All spans of every row: doc_id, assign, access, hex, random, each an array of (start, rank, end).

    Positions count code points, ends are exclusive. A random run that meets a base span is not
    reported again; parts of one run in different alphabets may overlap. Null text counts as empty and has no spans; repeated rows each get theirs; an
    empty table gives no rows; other columns are not read. Runs jobs: one narrow row a document is
    stored, and the counts behind the thresholds.
    """
    rows = stored(scanned(docs, id_col, text_col))
    runs = rows.select("row", F.explode("runs").alias("run"), F.concat("assign", "access", "hex").alias("base")).select("row", "run.*", "base")
    meets = F.exists("base", lambda x: (x["start"] < F.col("end")) & (F.col("start") < x["end"]))
    band = sum(((F.col("symbols") >= b).cast("int") for b in BANDS), F.lit(0))
    step = F.least(F.floor(-F.log10(F.greatest("p", F.lit(1e-12))) * STEPS), F.lit(12 * STEPS)).cast("int")
    tested = stored(battery(runs.where(~meets).drop("base")).withColumns({"band": band, "step": step}).drop("value"))
    bounds = not_random(tested)
    bound = sum((F.when(F.col("band") == b, F.lit(s)).otherwise(F.lit(0)) for b, s in bounds.items()), F.lit(0))
    bound = F.when(F.col("band").isin(list(bounds)), bound).otherwise(F.lit(12 * STEPS + 1)) if bounds else F.lit(12 * STEPS + 1)
    random = tested.where(F.col("step") < bound).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "rank", "end"))).alias("random"))
    none = F.array().cast("array<struct<start:int,rank:int,end:int>>")
    return rows.join(random, "row", "left").select("doc_id", "assign", "access", "hex", F.coalesce("random", none).alias("random"))


def spans_text(spans: Column) -> Column:
    """kind:start:end of each span, by start, then kind, joined by commas."""
    kind = lambda x: F.element_at(F.array(*[F.lit(k) for k in KINDS]), x["rank"] + 1)
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", kind(x), x["start"].cast("string"), x["end"].cast("string"))), ",")
