"""Quality rules: a decision list learnt from labelled statistics. DataFrame functions only.

Words are separated by white space (0x20, 0x09-0x0D). Base measures of each whole text feed threshold conditions;
sequential covering grows conjunctions that pick out rejected texts (FOIL gain on two thirds of the labelled rows),
prunes their last conditions on the other third, and drops rules that are not precise there. All counts come from
Spark aggregates over every labelled row: a histogram of binned measures per step, never the rows themselves. The
rules are given out as one ordered conditional expression. A rule grows while a condition gains anything and some good
text is left in it; rules are learnt until one isn't precise. Thresholds are cut half-way between neighbouring
quantiles of good and of bad texts' measures, BINS of each (approximate ones, to a thousandth).

Null and empty texts have no words and fail the base test. Repeated labels of a document count as one, 1 only if
all are 1. Repeated rows are judged one by one; other columns are ignored. Without labels no rule is learnt and
the base test alone decides. Texts of any length are measured whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

MIN_WORDS = 50
BINS = 24
#: A rule stays if at least this share of what it picks in the pruning rows is rejected by the labels.
PRECISION = 0.95

_SEPARATORS = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"

#: Measures that conditions may use, from the stored columns.
MEASURES = {
    "word_length": "word_chars / n_words",
    "symbol_share": "n_symbols / word_chars",
    "dup_line_share": "n_dup_lines / n_lines",
    "repeat_share": "n_repeat_words / n_words",
    "bang_share": "n_bangs / n_words",
    "upper_share": "n_upper / word_chars",
    "line_words": "n_words / n_lines",
    "digit_share": "n_digits / word_chars",
}


def _without(text: Column, letters: str) -> Column:
    for c in letters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def base_measures(documents: DataFrame) -> DataFrame:
    """doc_id and counts over each whole text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = documents.select("doc_id", text.alias("text"))
    words = F.filter(F.split("text", r"[ \t\n\x0B\f\r]+"), lambda w: w != "")
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^ \t\n\x0B\f\r]"))
    rows = rows.select("doc_id", "text", words.alias("words"), lines.alias("lines"))
    solid = F.array_join("words", "")
    rows = rows.select("doc_id", "words", "lines", solid.alias("solid"), F.size("words").cast("long").alias("n_words"), F.size("lines").cast("long").alias("n_lines"))
    hashes = F.transform(F.slice("words", F.lit(1), F.greatest(F.size("words") - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2)))
    rows = rows.select("doc_id", "n_words", "n_lines", "words", "solid", hashes.alias("hashes"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"))
    # only texts with some equal windows sort them: by hash, so that equal ones are neighbours
    again = F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    rows = rows.select("doc_id", "n_words", "n_lines", "n_dup_lines", "solid", "words", again.alias("again"))
    same = lambda a, b: (a["h"] == b["h"]) & (F.get("words", a["i"]) == F.get("words", b["i"])) & (F.get("words", a["i"] + 1) == F.get("words", b["i"] + 1)) & (F.get("words", a["i"] + 2) == F.get("words", b["i"] + 2))
    twice = F.filter("again", lambda x, i: F.coalesce((i > 0) & same(x, F.get("again", i - 1)), F.lit(False)) | F.coalesce(same(x, F.get("again", i + 1)), F.lit(False)))
    rows = rows.select("doc_id", "n_words", "n_lines", "n_dup_lines", "solid", F.sort_array(F.transform(twice, lambda x: x["i"])).alias("at"))
    covered = F.aggregate("at", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), lambda s, i: F.struct((s["n"] + i + 3 - F.greatest(s["end"], i)).alias("n"), (i + 3).alias("end")), lambda s: s["n"])
    less = lambda letters: (F.length("solid") - F.length(_without(F.col("solid"), letters))).cast("long")
    return rows.select(
        "doc_id", "n_words", F.length("solid").cast("long").alias("word_chars"), less(_SYMBOLS).alias("n_symbols"), "n_dup_lines", F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        "n_lines", less("!").alias("n_bangs"), F.regexp_count("solid", F.lit("[A-Z]")).cast("long").alias("n_upper"), F.regexp_count("solid", F.lit("[0-9]")).cast("long").alias("n_digits"))


def measures() -> dict[str, Column]:
    """Each measure as a column; 0 where its divisor is."""
    return {k: F.coalesce(F.expr(f"try_divide({v.split(' / ')[0]}, nullif({v.split(' / ')[1]}, 0))"), F.lit(0.0)) for k, v in MEASURES.items()}


Condition = tuple[str, bool, float]  # measure, whether it must be above the threshold, threshold


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def learn(counted: DataFrame, labels: DataFrame) -> list[list[Condition]]:
    """Ordered rules that pick texts to reject among those that pass the base test. counted: what base_measures gives."""
    marked = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg((F.min("quality") < 1).alias("bad"))
    columns = measures()
    rows = counted.filter(~base_failed()).join(marked, "doc_id").select("bad", (F.pmod(F.xxhash64("doc_id"), F.lit(3)) > 0).alias("grow"), *[c.alias(k) for k, c in columns.items()])
    rows = stored(rows, "quality-labelled")
    # thresholds half-way between the quantiles of good and of bad texts, so that rare ones have bins too
    share = [i / BINS for i in range(BINS + 1)]
    quantiles = rows.groupBy("bad").agg(*[F.percentile_approx(k, share, 1000).alias(k) for k in columns]).collect()
    values = {k: sorted({float(v) for r in quantiles for v in (r[k] or [])}) for k in columns}
    cuts = {k: [(a + b) / 2 for a, b in zip(v, v[1:])] or v for k, v in values.items()}
    if len(quantiles) < 2:
        return []

    def bin_of(k: str) -> Column:
        return F.size(F.filter(F.array(*[F.lit(c) for c in cuts[k]]), lambda c: c < F.col(k)))

    bins = {k: bin_of(k) for k in columns}
    rows = stored(rows.select("bad", "grow", *[b.alias(k) for k, b in bins.items()]).groupBy("bad", "grow", *columns).agg(F.count("*").alias("n")), "quality-binned")

    def fits(rule: Iterable[tuple[str, bool, int]]) -> Column:
        out = F.lit(True)
        for k, above, cut in rule:
            out = out & ((F.col(k) > cut) if above else (F.col(k) <= cut))
        return out

    def histogram(of: DataFrame) -> dict[str, dict[bool, list[int]]]:
        long = of.select("bad", "n", F.explode(F.create_map(*[x for k in columns for x in (F.lit(k), F.col(k))])).alias("k", "bin"))
        out = {k: {b: [0] * (len(cuts[k]) + 1) for b in (True, False)} for k in columns}
        for r in long.groupBy("k", "bin", "bad").agg(F.sum("n").alias("n")).collect():  # measures x bins x 2 rows
            out[r["k"]][r["bad"]][r["bin"]] = r["n"]
        return out

    rules: list[list[tuple[str, bool, int]]] = []
    left = rows
    while True:
        rule: list[tuple[str, bool, int]] = []
        inside = left.filter("grow")
        while True:
            table = histogram(inside.filter(fits(rule)))
            bad, good = (sum(next(iter(table.values()))[b]) for b in (True, False))
            if not bad or not good and rule:
                break
            base = math.log2(bad / (bad + good))
            best = max(
                ((p * (math.log2(p / (p + n)) - base), p / (p + n), k, above, cut)
                 for k, t in table.items() for cut in range(len(cuts[k])) for above in (True, False)
                 for p, n in [tuple(sum(t[b][cut + 1 :] if above else t[b][: cut + 1]) for b in (True, False))] if p),
                default=(0, 0, "", True, 0))
            if best[0] <= 0:
                break
            rule.append(best[2:])
        if not rule:
            break
        # prune: the shortest beginning of the rule that does best on the other rows
        other = left.filter(~F.col("grow"))
        sums = other.agg(*[F.sum(F.when(fits(rule[: i + 1]) & (F.col("bad") == b), F.col("n")).otherwise(0)).alias(f"x{i}{int(b)}") for i in range(len(rule)) for b in (True, False)]).first()
        worth = [(((p - n) / (p + n)) if p + n else -1.0, -i, p / (p + n) if p + n else 0.0) for i in range(len(rule)) for p, n in [(sums[f"x{i}1"] or 0, sums[f"x{i}0"] or 0)]]
        value, size, precision = max(worth)
        if precision < PRECISION:
            break
        rules.append(rule[: 1 - size])
        left = left.filter(~fits(rules[-1]))
    return [[(k, above, cuts[k][cut]) for k, above, cut in rule] for rule in rules]


def verdict(rules: list[list[Condition]]) -> Column:
    """The decision list as a conditional expression over base columns: false for texts to reject."""
    columns = measures()
    out: Column | None = None
    for rule in rules:
        fits = F.lit(True)
        for k, above, cut in rule:
            fits = fits & ((columns[k] > cut) if above else (columns[k] <= cut))
        out = F.when(fits, F.lit(False)) if out is None else out.when(fits, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def quality_rules(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    counted = stored(base_measures(documents), "quality-measures")
    rules = learn(counted, labels)
    failed = base_failed()
    return counted.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), F.when(failed, F.lit(False)).otherwise(verdict(rules)).alias("kept"))
