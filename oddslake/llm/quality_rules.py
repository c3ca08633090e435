"""Quality rules and robust multivariate outliers, in DataFrame expressions only.

Text statistics become a transformed vector. Per language and source, per language, and over all, a
minimum-covariance-determinant estimate gives centre and scatter: from two deterministic starts
concentration steps take the three quarters of the rows that are nearest to the current centre, the
start with the smaller determinant wins, and a reweighting step follows. The moments of a group are
blended with those of its language, and those with the moments over all, by number of rows, so small
groups lean on what is known of larger ones and no number of rows switches anything. A document is
rejected when its Mahalanobis distance under the blend is beyond a bound that is read off the group's
own distances: clean text has longer tails than a normal law, and the bulk of the distances tells how much.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from oddslake.functions.computed import computed
from oddslake.llm.common import BLANKS, whole_text, words
from oddslake.session import stored

SYMBOLS = "#*$%&|<>"
#: Transformed statistics and the least scatter assumed of each: a statistic that is the same in
#: nearly all documents would otherwise make the scatter singular. No more than that: a floor bounds
#: how far away a statistic can put a document, and each must be able to pass the bound alone.
SCALE_FLOORS = {"x_length": 0.1, "x_word": 0.02, "x_symbol": 0.02, "x_line": 0.05, "x_repeat": 0.05, "x_upper": 0.02}
NAMES = list(SCALE_FLOORS)
#: Share of rows that a concentration step keeps, steps, and the tail probability beyond which a
#: document is rejected.
KEPT_SHARE, STEPS, TAIL = 0.75, 4, 1e-3
#: Rows that the coarser estimate counts for when it is blended with a finer one, and the deviations
#: assumed about the centre over all, which count as many rows: they decide where a table has next to none.
PRIOR_ROWS = 200
PRIOR_SCALES = {"x_length": 1.0, "x_word": 0.25, "x_symbol": 0.2, "x_line": 0.25, "x_repeat": 0.25, "x_upper": 0.2}
#: Quantiles of the distances that a bound is extrapolated from: as many far rows as the estimates bear may be beyond.
BULK = (0.5, KEPT_SHARE)


def chi2_below(x: float, df: int) -> float:
    """Chi-squared distribution function for an even number of degrees of freedom."""
    half, term, total = x / 2, 1.0, 0.0
    for i in range(df // 2):
        term = term * half / i if i else 1.0
        total += term
    return 1 - math.exp(-half) * total


def chi2_quantile(p: float, df: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_below(mid, df) < p else (low, mid)
    return high


def text_statistics(df: DataFrame, text: Column) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words and n_upper.

    A word is in a repeated window when one of the three-word windows over it occurs at least twice
    in the text. Windows are compared by a 64-bit hash within one text. Texts without a repeated
    window, most, are told by a set; in the others equal windows are found as neighbours in order.
    """
    without = lambda chars: F.length("__text") - F.length(F.translate("__text", chars, ""))
    df = computed(df, __text=text)
    df = computed(df, __words=words(F.col("__text")), __lines=F.filter(F.split("__text", "\n", -1), lambda x: F.length(F.btrim(x, F.lit(BLANKS))) > 0))
    n = F.size("__words")
    hashes = F.transform("__words", lambda x, i: F.xxhash64(x, F.get("__words", i + 1), F.get("__words", i + 2)))
    df = computed(df, __windows=F.slice(hashes, F.lit(1), F.greatest(n - 2, F.lit(0))))
    placed = F.array_sort(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = computed(df, __placed=F.when(F.size(F.array_distinct("__windows")) < F.size("__windows"), placed))
    near = lambda i: F.get("__placed", i)["h"]
    repeated = F.filter("__placed", lambda x, i: (x["h"] == near(i - 1)) | (x["h"] == near(i + 1)))
    starts = F.sort_array(F.transform(repeated, lambda x: x["i"]))
    covered = F.aggregate(
        starts,
        F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
        lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last")),
        lambda a: a["n"],
    )
    long = lambda c, name: c.cast("bigint").alias(name)
    return df.select(
        *[c for c in df.columns if c not in ("__text", "__words", "__lines", "__windows", "__placed")],
        long(n, "n_words"),
        long(F.length(F.translate("__text", BLANKS, "")), "word_chars"),
        long(without(SYMBOLS), "n_symbols"),
        long(F.size("__lines"), "n_lines"),
        long(F.size("__lines") - F.size(F.array_distinct("__lines")), "n_dup_lines"),
        long(F.coalesce(covered, F.lit(0)), "n_repeat_words"),
        long(without(string.ascii_uppercase), "n_upper"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def vector() -> list[Column]:
    """The transformed statistics, in the order of ``NAMES``."""
    words_, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return [
        F.log1p("n_words").alias("x_length"),
        F.log(chars / words_).alias("x_word"),
        F.sqrt(F.col("n_symbols") / chars).alias("x_symbol"),
        F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))).alias("x_line"),
        F.sqrt(F.col("n_repeat_words") / words_).alias("x_repeat"),
        F.sqrt(F.col("n_upper") / chars).alias("x_upper"),
    ]


def _name(column: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit("null"))


#: Key of the estimates of all languages or all sources; names of either start with "=".
ALL = "*"
_KEYS = ["lang_key", "source_key", "start"]
_PAIRS = [(i, j) for i in range(len(NAMES)) for j in range(i + 1)]


def _moments(rows: DataFrame, factor: float) -> DataFrame:
    """Number ``n_rows``, centre ``m_i`` and scatter ``c_i_j`` by key.

    The scatter is scaled by ``factor`` and the floors are added to its diagonal.
    """
    x = [F.col(n) for n in NAMES]
    sums = rows.groupBy(*_KEYS).agg(
        F.count(F.lit(1)).alias("n_rows"), *[F.sum(c).alias(f"s_{i}") for i, c in enumerate(x)], *[F.sum(x[i] * x[j]).alias(f"s_{i}_{j}") for i, j in _PAIRS]
    )
    mean = lambda name: F.col(name) / F.col("n_rows")
    sums = sums.select(*_KEYS, "n_rows", *[mean(f"s_{i}").alias(f"m_{i}") for i in range(len(x))], *[mean(f"s_{i}_{j}").alias(f"s_{i}_{j}") for i, j in _PAIRS])
    spread = lambda i, j: F.col(f"s_{i}_{j}") - F.col(f"m_{i}") * F.col(f"m_{j}")
    floors = [f * f for f in SCALE_FLOORS.values()]
    return sums.select(*_KEYS, "n_rows", *[f"m_{i}" for i in range(len(x))], *[(spread(i, j) * factor + (floors[i] if i == j else 0.0)).alias(f"c_{i}_{j}") for i, j in _PAIRS])


def _factored(moments: DataFrame) -> DataFrame:
    """The lower Cholesky factor ``l_i_j`` of the scatter in its place, and ``log_det``."""
    p = len(NAMES)
    for j in range(p):  # one column of the factor at a time
        done = lambda i: sum((F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}") for k in range(j)), F.lit(0.0))  # noqa: E731, B023
        moments = moments.withColumn(f"l_{j}_{j}", F.sqrt(F.col(f"c_{j}_{j}") - done(j)))
        if j + 1 < p:
            moments = moments.withColumns({f"l_{i}_{j}": (F.col(f"c_{i}_{j}") - done(i)) / F.col(f"l_{j}_{j}") for i in range(j + 1, p)})
    log_det = sum((F.log(f"l_{i}_{i}") for i in range(p)), F.lit(0.0))
    return moments.withColumn("log_det", log_det).drop(*[f"c_{i}_{j}" for i, j in _PAIRS])


def _distances(rows: DataFrame, estimates: DataFrame, on: list[str], *also: str) -> DataFrame:
    """Add ``d2``, the squared Mahalanobis distance, null where there is no estimate, and columns of it."""
    keep = [*rows.columns, *also]
    rows = rows.join(estimates, on, "left")
    for i, n in enumerate(NAMES):
        rest = F.col(n) - F.col(f"m_{i}") - sum((F.col(f"l_{i}_{j}") * F.col(f"y_{j}") for j in range(i)), F.lit(0.0))
        rows = rows.withColumn(f"y_{i}", rest / F.col(f"l_{i}_{i}"))
    return rows.select(*keep, sum((F.col(f"y_{i}") * F.col(f"y_{i}") for i in range(len(NAMES))), F.lit(0.0)).alias("d2"))


def _nearest(rows: DataFrame, share: float) -> DataFrame:
    """The share of the rows of each key with the smallest ``d2``, ties of a rounded value included.

    The bound is read off a histogram of the distance's logarithm, in steps of a thousandth.
    """
    rows = rows.withColumn("bin", F.round(F.log1p("d2") * 1000).cast("int"))
    upto = W.partitionBy(*_KEYS).orderBy("bin").rowsBetween(W.unboundedPreceding, W.currentRow)
    bins = rows.groupBy(*_KEYS, "bin").agg(F.count(F.lit(1)).alias("n"))
    bins = bins.withColumn("upto", F.sum("n").over(upto)).withColumn("total", F.sum("n").over(W.partitionBy(*_KEYS)))
    bound = bins.where(F.col("upto") >= share * F.col("total")).groupBy(*_KEYS).agg(F.min("bin").alias("bound"))
    return rows.join(stored(bound), _KEYS).where(F.col("bin") <= F.col("bound")).drop("bin", "bound")


def _medians(rows: DataFrame, values: list[Column], out: str) -> DataFrame:
    """Median of each value by key, to a thousandth, as the array ``out``."""
    long = rows.select(*_KEYS, F.posexplode(F.array(*[F.round(v * 1000).cast("bigint") for v in values])).alias("i", "bin"))
    by = [*_KEYS, "i"]
    upto = W.partitionBy(*by).orderBy("bin").rowsBetween(W.unboundedPreceding, W.currentRow)
    bins = long.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"))
    bins = bins.withColumn("upto", F.sum("n").over(upto)).withColumn("total", F.sum("n").over(W.partitionBy(*by)))
    middle = bins.where(2 * F.col("upto") >= F.col("total")).groupBy(*by).agg((F.min("bin") / 1000).alias("v"))
    return middle.groupBy(*_KEYS).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias(out))


def _levels(rows: DataFrame, *values: str) -> DataFrame:
    """Each row three times: in its group, in its language, and in all."""
    keys = [(F.col("lang_key"), F.col("source_key")), (F.col("lang_key"), F.lit(ALL)), (F.lit(ALL), F.lit(ALL))]
    return rows.select(F.inline(F.array(*[F.struct(a.alias("lang_key"), b.alias("source_key")) for a, b in keys])), *values)


def robust_estimates(vectors: DataFrame) -> DataFrame:
    """Moments from rows of (lang_key, source_key, x_…): one per group, language, and over all.

    Every step is an aggregate with map-side combining, so a group with a large share of the rows is
    not gathered.
    """
    p = len(NAMES)
    rows = _levels(vectors, *NAMES)
    single = rows.withColumn("start", F.lit(0))
    centre = stored(_medians(single, [F.col(n) for n in NAMES], "centre"))
    away = [F.abs(F.col(n) - F.col("centre")[i]) for i, n in enumerate(NAMES)]
    spread = stored(_medians(single.join(centre, _KEYS), away, "spread").join(centre, _KEYS).drop("start"))
    scaled = [F.pow((F.col(n) - F.col("centre")[i]) / F.greatest(1.4826 * F.col("spread")[i], F.lit(SCALE_FLOORS[n])), 2) for i, n in enumerate(NAMES)]
    first = rows.join(spread, ["lang_key", "source_key"]).select(
        "lang_key", "source_key", *NAMES, F.posexplode(F.array(sum(scaled, F.lit(0.0)), F.greatest(*scaled))).alias("start", "d2")
    )
    consistency = KEPT_SHARE / chi2_below(chi2_quantile(KEPT_SHARE, p), p + 2)
    estimates = stored(_factored(_moments(_nearest(first, 0.5), consistency)))
    both = rows.withColumn("start", F.explode(F.array(F.lit(0), F.lit(1))))
    for _ in range(STEPS):
        estimates = stored(_factored(_moments(_nearest(_distances(both, estimates, _KEYS), KEPT_SHARE), consistency)))
    best = estimates.groupBy("lang_key", "source_key").agg(F.min(F.struct("log_det", "start")).alias("b")).select("lang_key", "source_key", F.col("b.start").alias("start"))
    estimates = estimates.join(best, _KEYS)
    cut = chi2_quantile(0.975, p)
    near = _distances(rows.join(best, ["lang_key", "source_key"]), estimates, _KEYS).where(F.col("d2") <= cut)
    return stored(_moments(near, 0.975 / chi2_below(cut, p + 2)).drop("start"))


def _chain(table: DataFrame, groups: DataFrame, values: list[str]) -> tuple[DataFrame, dict | None]:
    """Beside each of ``groups`` the structs ``own`` and ``language`` of ``values``; and those over all."""
    over_all = table.where((F.col("lang_key") == ALL) & (F.col("source_key") == ALL)).select(*values).first()  # one row
    own = table.where((F.col("lang_key") != ALL) & (F.col("source_key") != ALL)).select("lang_key", "source_key", F.struct(*values).alias("own"))
    language = table.where((F.col("lang_key") != ALL) & (F.col("source_key") == ALL)).select("lang_key", F.struct(*values).alias("language"))
    found = groups.join(own, ["lang_key", "source_key"], "left").join(language, "lang_key", "left")
    return found, over_all.asDict() if over_all else None


def _weight(level: str) -> Column:
    n = F.coalesce(F.col(level)["n_rows"].cast("double"), F.lit(0.0))
    return n / (n + PRIOR_ROWS)


def _blend(fine: dict[str, Column], weight: Column, coarse: dict[str, Column]) -> dict[str, Column]:
    """Weighted centre and scatter; ``fine`` may be null where its weight is nothing.

    The distance between the centres does not widen the scatter: a few rows that are all far away
    would otherwise excuse each other.
    """
    return {v: F.coalesce(weight * fine[v], F.lit(0.0)) + (1 - weight) * c for v, c in coarse.items()}


def blended(groups: DataFrame, moments: DataFrame) -> DataFrame:
    """Centre and factor for each (lang_key, source_key) of ``groups``, a row a group; stored.

    The own moments count for the rows they come from, the language's for ``PRIOR_ROWS``, and so on up
    to the assumed deviations about the centre over all. Null where the table has no row to learn from.
    """
    values = ["n_rows", *[f"m_{i}" for i in range(len(NAMES))], *[f"c_{i}_{j}" for i, j in _PAIRS]]
    found, over_all = _chain(moments, groups.select("lang_key", "source_key").distinct(), values)
    number = lambda v: F.lit(v).cast("double")
    top, scales = over_all or dict.fromkeys(values), list(PRIOR_SCALES.values())
    found = found.withColumn("all", F.struct(*[number(top[v]).alias(v) for v in values]))
    assumed = {f"m_{i}": number(top[f"m_{i}"]) for i in range(len(NAMES))} | {f"c_{i}_{j}": number(scales[i] ** 2 if i == j else 0.0) for i, j in _PAIRS}
    coarse = assumed
    for level in ("all", "language", "own"):
        fine = {v: F.col(level)[v] for v in values}
        coarse = _blend(fine, _weight(level), coarse)
    found = stored(found.select("lang_key", "source_key", *[c.alias(v) for v, c in coarse.items()]))
    return stored(_factored(found).drop("log_det"))


def distance_bounds(vectors: DataFrame, estimates: DataFrame) -> DataFrame:
    """Squared distance beyond which a row of each (lang_key, source_key) is rejected: ``bound``.

    Two quantiles of the bulk of the distances, on a logarithmic scale against those of the chi-squared
    law, give a straight line; the bound is where it meets the wanted tail, and never below the
    chi-squared quantile itself. The line of a group is blended like its moments.
    """
    p, tail = len(NAMES), chi2_quantile(1 - TAIL, len(NAMES))
    rows = _levels(_distances(vectors, estimates, ["lang_key", "source_key"]), "d2")
    by, levels = ["lang_key", "source_key"], [f"q_{k}" for k in range(len(BULK))]
    bins = rows.groupBy(*by, F.round(F.log(F.greatest("d2", F.lit(1e-6))) * 100).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    upto = W.partitionBy(*by).orderBy("bin").rowsBetween(W.unboundedPreceding, W.currentRow)
    bins = bins.withColumn("upto", F.sum("n").over(upto)).withColumn("n_rows", F.sum("n").over(W.partitionBy(*by)))
    read = [(F.min(F.when(F.col("upto") >= share * F.col("n_rows"), F.col("bin"))) / 100).alias(q) for q, share in zip(levels, BULK, strict=True)]
    table = stored(bins.groupBy(*by).agg(F.max("n_rows").alias("n_rows"), *read))
    found, over_all = _chain(table, estimates.select(*by), ["n_rows", *levels])
    law = [math.log(chi2_quantile(share, p)) for share in BULK]
    found = found.withColumn("all", F.struct(*[F.lit(over_all[v] if over_all else None).cast("double").alias(v) for v in ["n_rows", *levels]]))
    for k, q in enumerate(levels):
        line = F.lit(law[k])
        for level in ("all", "language", "own"):
            line = F.coalesce(_weight(level) * F.col(level)[q], F.lit(0.0)) + (1 - _weight(level)) * line
        found = found.withColumn(q, line)
    slope = (F.col(levels[1]) - F.col(levels[0])) / (law[1] - law[0])
    return found.select(*by, F.greatest(F.lit(tail), F.exp(F.col(levels[1]) + slope * (math.log(tail) - law[1]))).alias("bound"))


def limits(groups: DataFrame, vectors: DataFrame) -> DataFrame:
    """Blended estimates of all ``groups`` with their bounds, from the rows to learn from; stored."""
    estimates = blended(groups, robust_estimates(vectors))
    return stored(estimates.join(distance_bounds(vectors, estimates), ["lang_key", "source_key"]))


def passing(stats: DataFrame) -> DataFrame:
    """The vectors of the rows to learn from: those that pass the base rules."""
    return stats.where(~base_failed()).select("lang_key", "source_key", *vector())


def judged(stats: DataFrame, estimates: DataFrame) -> DataFrame:
    """Add ``distance`` (squared, null without an estimate), ``base_failed`` and ``kept``.

    ``stats`` has lang_key, source_key and the statistics; ``estimates`` is what :func:`limits` gives.
    """
    keep = stats.columns
    rows = _distances(stats.select("*", *vector()), estimates, ["lang_key", "source_key"], "bound")
    return rows.select(
        *keep, F.col("d2").alias("distance"), base_failed().alias("base_failed"),
        (~base_failed() & F.coalesce(F.col("d2") <= F.col("bound"), F.lit(True))).alias("kept"),
    )


def quality_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Judge every row: doc_id, the statistics, distance, base_failed, kept.

    Null text counts as empty and fails the base rules, as does any text under 50 words. A missing
    language or source is a group like any other. Where no row passes the base rules there is nothing
    to learn from and distances are null. Very long texts are read whole. Repeated rows are judged
    alike, and so are rows at the same distance; an empty table gives no rows. Jobs run for the estimates.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), _name("lang").alias("lang_key"), _name("source").alias("source_key"), F.col(text_col).alias("text"))
    stats = stored(text_statistics(rows, whole_text("text")).drop("text"))
    return judged(stats, limits(stats, passing(stats)))


def drop_rejected(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows that are kept, with all their columns, decided as by :func:`quality_verdicts`.

    The statistics are computed a second time next to the rows, which costs less than sending the
    texts through a join on their ids and is right for ids that are null or occur more than once: no
    id is read. Columns of any name stay as they are; an empty table gives no rows.
    """
    narrow = docs.select(_name("lang").alias("lang_key"), _name("source").alias("source_key"), F.col(text_col).alias("text"))
    learned = stored(passing(text_statistics(narrow, whole_text("text"))))
    rows = docs.select(F.struct("*").alias("row"), _name("lang").alias("lang_key"), _name("source").alias("source_key"))
    stats = text_statistics(rows, whole_text(F.col("row")[text_col]))
    return judged(stats, limits(rows, learned)).where("kept").select("row.*")
