import random
import re
from collections import Counter

import numpy as np
from conftest import prose, table

from oddslake.llm import quality_rules as Q
from oddslake.llm.common import whole_text


def statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = Counter(windows)
    inside = {k for i, w in enumerate(windows) if counts[w] > 1 for k in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside)


EXTRA = ["a b c a b c", "a a a a a", "x\nx\n\nx \n\tx\r\nx\x85y", "#" * 40 + " |<>| " * 60, "so it is so it is not so it " * 20, "é ß 𝔘 " * 30, "\n\n\n", "one two three one two"]


def test_statistics(docs, rows, spark):
    extra = [(900 + i, t, "en", "s") for i, t in enumerate(EXTRA)]
    found = Q.text_statistics(docs.unionByName(table(spark, extra)).select("doc_id", "text"), whole_text("text")).collect()
    texts = {i: t or "" for i, t, *_ in [*rows, *extra]}
    for r in found:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == statistics(texts[r["doc_id"]]), r["doc_id"]


def test_chi2():
    assert abs(Q.chi2_below(5.348121, 6) - 0.5) < 1e-6 and abs(Q.chi2_quantile(0.975, 6) - 14.44938) < 1e-4


def test_outliers_go_and_others_stay(spark):
    rng, rows = random.Random(2), []
    for i in range(700):
        rows.append((i, prose(i, rng.randrange(60, 400)), "en" if i % 3 else "de", "ab"[i % 2]))
    bad = [(1000 + i, " ".join(w + "$$$" for w in prose(i, 150).split()), "en", "a") for i in range(40)]
    bad += [(2000 + i, prose(i, 200).upper() + "|" * 40, "de", None) for i in range(10)]
    short = [(3000, "a few words", "en", "a"), (3001, None, None, None)]
    docs = table(spark, rows + bad + short)
    found = {r["doc_id"]: r for r in Q.quality_verdicts(docs).collect()}
    assert len(found) == len(rows) + len(bad) + 2
    assert not any(found[r[0]]["kept"] for r in bad + short) and all(found[r[0]]["base_failed"] for r in short)
    assert sum(found[r[0]]["kept"] for r in rows) >= 0.99 * len(rows)
    kept = Q.drop_rejected(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in found.items() if r["kept"]}


def test_estimates_are_near_those_of_clean_rows(spark):
    """A quarter of far rows moves plain means, not the estimates."""
    rng = np.random.default_rng(1)
    clean = rng.normal(0, 1, (1500, 6)) @ np.diag([1, 2, 1, 1, 3, 1]) + 5
    clean[:, 1] += clean[:, 0]
    far = rng.normal(30, 1, (400, 6))
    rows = [("=en", "=a", *map(float, v)) for v in np.concatenate([clean, far])]
    df = spark.createDataFrame(rows, "lang_key STRING, source_key STRING, " + ", ".join(f"{n} DOUBLE" for n in Q.NAMES))
    one = next(r for r in Q.robust_estimates(df).collect() if r["source_key"] == "=a")
    centre = np.array([one[f"m_{i}"] for i in range(6)])
    assert np.abs(centre - clean.mean(0)).max() < 0.3
    assert max(abs(one[f"c_{i}_{i}"] / v - 1) for i, v in enumerate(np.var(clean, 0))) < 0.3


def chosen(x):
    """The robust centre, scatter and number of rows of one group, by definition."""
    floor = np.array(list(Q.SCALE_FLOORS.values()))
    median = lambda v: np.sort(np.floor(v * 1000 + 0.5), 0)[(len(v) + 1) // 2 - 1] / 1000
    moments = lambda v, factor: (v.mean(0), np.cov(v.T, bias=True) * factor + np.diag(floor**2))
    far = lambda m, c: np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)

    def nearest(d2, share):
        steps = np.floor(np.log1p(d2) * 1000 + 0.5)
        return x[steps <= np.sort(steps)[int(np.ceil(share * len(x))) - 1]]

    p = x.shape[1]
    consistency = Q.KEPT_SHARE / Q.chi2_below(Q.chi2_quantile(Q.KEPT_SHARE, p), p + 2)
    scaled = ((x - median(x)) / np.maximum(1.4826 * median(np.abs(x - median(x))), floor)) ** 2
    ends = []
    for d2 in (scaled.sum(1), scaled.max(1)):
        m, c = moments(nearest(d2, 0.5), consistency)
        for _ in range(Q.STEPS):
            m, c = moments(nearest(far(m, c), Q.KEPT_SHARE), consistency)
        ends.append((np.linalg.slogdet(c)[1], m, c))
    _, m, c = min(ends, key=lambda e: e[0])
    cut = Q.chi2_quantile(0.975, p)
    near = x[far(m, c) <= cut]
    return len(near), *moments(near, 0.975 / Q.chi2_below(cut, p + 2))


def verdicts(groups):
    """Distance and bound of every row, by definition; ``groups`` maps (language, source) to rows."""
    levels = lambda g: [None, (g[0], None), g]
    members = lambda level: np.concatenate([v for g, v in groups.items() if level in levels(g)])
    names = {level for g in groups for level in levels(g)}
    found, d2, out = {level: chosen(members(level)) for level in names}, {}, {}
    for g, x in groups.items():
        m, c = found[None][1], np.diag(np.array(list(Q.PRIOR_SCALES.values())) ** 2)
        for level in levels(g):
            n, m1, c1 = found[level]
            w = n / (n + Q.PRIOR_ROWS)
            m, c = w * m1 + (1 - w) * m, w * c1 + (1 - w) * c
        d2[g] = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
    law = [np.log(Q.chi2_quantile(q, 6)) for q in Q.BULK]
    tail = np.log(Q.chi2_quantile(1 - Q.TAIL, 6))
    for g in groups:
        line = list(law)
        for level in levels(g):
            steps = np.sort(np.floor(np.log(np.maximum(np.concatenate([d2[h] for h in groups if level in levels(h)]), 1e-6)) * 100 + 0.5))
            w = len(steps) / (len(steps) + Q.PRIOR_ROWS)
            line = [w * steps[int(np.ceil(q * len(steps))) - 1] / 100 + (1 - w) * old for q, old in zip(Q.BULK, line, strict=True)]
        out[g] = d2[g], np.exp(max(tail, line[1] + (line[1] - line[0]) / (law[1] - law[0]) * (tail - law[1])))
    return out


def test_verdicts_are_those_of_the_definition(spark):
    """Three groups of unlike size, heavy tails and far rows, against the method written in numpy."""
    rng = np.random.default_rng(7)
    groups = {}
    for g, n in {("=en", "=a"): 700, ("=en", "=b"): 90, ("=de", "=a"): 30}.items():
        x = rng.standard_t(4, (n, 6)) * [0.8, 0.1, 0.05, 0.1, 0.1, 0.03] + [5, 1.6, 0.1, 0.2, 0.2, 0.1]
        x[: n // 10] += 2
        groups[g] = x
    rows = [(*g, *map(float, v)) for g, x in groups.items() for v in x]
    df = spark.createDataFrame(rows, "lang_key STRING, source_key STRING, " + ", ".join(f"{n} DOUBLE" for n in Q.NAMES))
    found = Q._distances(df, Q.limits(df, df), ["lang_key", "source_key"], "bound").collect()
    expected = verdicts(groups)
    for g, x in groups.items():
        mine = sorted((r["x_length"], r["d2"], r["bound"]) for r in found if (r["lang_key"], r["source_key"]) == g)
        theirs = sorted(zip(x[:, 0], expected[g][0], strict=True))
        assert len(mine) == len(theirs)
        assert all(abs(a[1] / b[1] - 1) < 1e-6 and abs(a[2] / expected[g][1] - 1) < 1e-6 for a, b in zip(mine, theirs, strict=True))
        assert any(a[1] > a[2] for a in mine) and sum(a[1] > a[2] for a in mine) < 0.2 * len(mine)


def test_few_rows_and_none(spark, none):
    """A handful of rows leans on the assumed deviations: ordinary texts stay; without rows nothing is known."""
    few = table(spark, [(i, prose(i, 60 + 10 * i), "en" if i % 2 else None, None) for i in range(9)] + [(50, None, None, None)])
    found = Q.quality_verdicts(few).collect()
    assert len(found) == 10 and all(r["kept"] == (not r["base_failed"]) and r["distance"] is not None for r in found)
    short = Q.quality_verdicts(table(spark, [(1, "a few words", "en", "a"), (1, None, None, None)])).collect()
    assert [(r["kept"], r["distance"]) for r in short] == [(False, None)] * 2
    assert Q.quality_verdicts(none).count() == 0 and Q.drop_rejected(none).count() == 0


def test_repetition_alone_is_an_outlier(spark):
    """Texts that pass the base rules: short lines of a menu again and again, and a passage said twice."""
    lines = lambda text, n: "\n".join(" ".join(text.split(" ")[k : k + n]) for k in range(0, len(text.split(" ")), n))
    rng = random.Random(5)
    rows = [(i, lines(prose(i, rng.randrange(120, 500)), 10), "en", "a") for i in range(500)]
    menu = [(1000 + i, lines(prose(7000 + i, 300), 10) + "\n" + "\n".join(["home", "next"] * 20), "en", "a") for i in range(5)]
    twice = [(2000 + i, lines(f"{prose(8000 + i, 220)} {(said := prose(9000 + i, 43))} {prose(8500 + i, 4)} {said}", 10), "en", "a") for i in range(5)]
    found = {r["doc_id"]: r for r in Q.quality_verdicts(table(spark, rows + menu + twice)).collect()}
    assert not any(found[r[0]]["base_failed"] for r in menu + twice)
    assert all(found[r[0]]["n_dup_lines"] > 0.5 * 38 for r in menu) and all(found[r[0]]["n_dup_lines"] == 0 for r in twice)
    assert not any(found[r[0]]["kept"] for r in menu + twice)
    assert sum(found[r[0]]["kept"] for r in rows) >= 0.97 * len(rows)
