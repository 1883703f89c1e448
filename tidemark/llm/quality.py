"""Quality by weak supervision, in DataFrame and SQL functions only.

Rules vote good (1), bad (-1) or abstain (0) on each document. Expectation-maximisation over the counts of vote
patterns (at most 3 ** rules rows, however many documents) estimates how often each rule is right; the posterior
probability of "good" replaces an all-must-pass filter.

Edge cases: a null text is an empty one (0 words, so base_failed); an empty table gives no rows; repeated doc_ids give a
row each; further input columns are ignored by the report and kept by the filter. Texts of any length are counted whole;
a posterior equal to the threshold keeps the document.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Up to so many repeated windows in a text, membership costs less than the sort of pairs; either way is exact.
_FEW = 32
_WS = r"[\\x20\\x09-\\x0D]"
_WORD = r"[^\\x20\\x09-\\x0D]"


@dataclass(frozen=True)
class Rule:
    """Bad where bad_if holds, else good where good_if holds, else abstains; SQL over the columns of features()."""

    name: str
    bad_if: str
    good_if: str


#: Ratios are compared by products, so that no text divides by zero.
RULES = (
    Rule("symbols", "100 * n_symbols > 4 * word_chars", "false"),
    Rule("symbol_words", "100 * n_symbols > 12 * n_words", "n_symbols = 0"),
    Rule("shouting", "100 * n_upper > 10 * word_chars", "false"),
    Rule("exclamation", "100 * n_exclaim > 8 * n_words", "n_exclaim = 0"),
    Rule("repeats", "100 * n_repeat_words > 20 * n_words", "100 * n_repeat_words < 8 * n_words"),
    Rule("lines", "100 * n_dup_lines > 20 * n_lines", "false"),
    Rule("variety", "100 * n_distinct < 85 * n_grams", "false"),
    Rule("word_size", "word_chars < 2 * n_words or word_chars > 14 * n_words", "word_chars between 3 * n_words and 10 * n_words"),
)


def _let(value: str, name: str, body: str) -> str:
    """Bind value once: a lambda variable is evaluated a single time, whatever the optimiser merges."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _repeat_words(grams: str) -> str:
    """Words in 3-word windows that occur at least twice, from the array of window hashes in text order.

    Sorting the hashes gives those that repeat. Where they are few, positions are found by membership; else hashes are
    sorted together with their positions and compared with their neighbours. Both find the same positions.
    """
    twin = "(j > 0 and s[j - 1].x = y.x) or (j < size(s) - 1 and s[j + 1].x = y.x)"
    many = _let("sort_array(transform(h, (x, i) -> struct(x as x, cast(i as bigint) as i)))", "s", f"sort_array(transform(filter(s, (y, j) -> {twin}), y -> y.i))")
    few = "filter(transform(h, (x, i) -> if(array_contains(r, x), cast(i as bigint), -1L)), i -> i >= 0)"
    repeated = _let("sort_array(h)", "s", "array_distinct(filter(s, (x, j) -> j > 0 and x = s[j - 1]))")
    covered = "aggregate(transform(p, (x, k) -> if(k < size(p) - 1, least(3L, p[k + 1] - x), 3L)), 0L, (a, c) -> a + c)"
    places = _let(repeated, "r", f"if(size(r) <= {_FEW}, {few}, {many})")
    return f"if({grams}.distinct = size({grams}.hashes), 0L, {_let(f'{grams}.hashes', 'h', _let(places, 'p', covered))})"


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with one more struct column _tm_f of counts over the whole text."""
    t = f"coalesce(`{text}`, '')"
    words = f"filter(split({t}, '{_WS}+'), x -> x != '')"
    lines = f"filter(split({t}, '\\n'), x -> x rlike '{_WORD}')"
    grams = "if(size(_tm_w) >= 3, transform(sequence(0, size(_tm_w) - 3), i -> xxhash64(_tm_w[i], _tm_w[i + 1], _tm_w[i + 2])), cast(array() as array<bigint>))"
    grams = _let(grams, "h", "struct(h as hashes, size(array_distinct(h)) as distinct)")
    counts = docs.withColumns({"_tm_w": F.expr(words), "_tm_l": F.expr(lines)}).withColumn("_tm_g", F.expr(grams))
    whole = F.expr(t)
    return counts.withColumn(
        "_tm_f",
        F.struct(
            F.size("_tm_w").cast("long").alias("n_words"),
            F.length(F.array_join("_tm_w", "")).cast("long").alias("word_chars"),
            F.regexp_count(whole, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
            (F.size("_tm_l") - F.size(F.array_distinct("_tm_l"))).cast("long").alias("n_dup_lines"),
            F.expr(_repeat_words("_tm_g")).alias("n_repeat_words"),
            F.size("_tm_l").cast("long").alias("n_lines"),
            F.size("_tm_g.hashes").cast("long").alias("n_grams"),
            F.col("_tm_g.distinct").cast("long").alias("n_distinct"),
            F.regexp_count(whole, F.lit("[A-ZÀ-Þ]{2}")).cast("long").alias("n_upper"),
            (F.octet_length(whole) - F.octet_length(F.replace(whole, F.lit("!"), F.lit("")))).cast("long").alias("n_exclaim"),
        ),
    ).drop("_tm_w", "_tm_l", "_tm_g")


def base_failed(f: str = "_tm_f") -> Column:
    return (F.col(f"{f}.n_words") < 50) | (100 * F.col(f"{f}.n_repeat_words") > 50 * F.col(f"{f}.n_words"))


def votes(rules: tuple[Rule, ...] = RULES, f: str = "_tm_f") -> Column:
    names = "n_words word_chars n_symbols n_dup_lines n_repeat_words n_lines n_grams n_distinct n_upper n_exclaim".split()

    def over(sql: str) -> str:
        return " ".join(f"{f}.{w}" if w in names else w for w in sql.split())

    return F.array(*[F.expr(f"case when {over(r.bad_if)} then -1 when {over(r.good_if)} then 1 else 0 end") for r in rules])


def _posterior(p: str, t: str, m: int) -> str:
    """P(good | votes); t is [prior, then for every rule P(bad vote | good), P(bad vote | bad), P(good vote | good), P(good vote | bad)]."""
    weight = f"case {p}[j - 1] when -1 then ln({t}[j] / {t}[{m} + j]) when 1 then ln({t}[{2 * m} + j] / {t}[{3 * m} + j]) else 0D end"
    score = f"ln({t}[0] / (1 - {t}[0])) + aggregate(sequence(1, {m}), 0D, (a, j) -> a + {weight})"
    return f"(1 / (1 + exp(-({score}))))"


def fit(voted: DataFrame, column: str = "_tm_v", rules: tuple[Rule, ...] = RULES, rounds: int = 40) -> list[float]:
    """The prior and each rule's accuracies on good and bad documents, by expectation-maximisation in one SQL expression.

    Only vote patterns and their counts are gathered. Abstentions carry no evidence. Rules are taken to be better than
    chance: a bad vote never speaks for a document, nor a good vote against it.
    """
    m = len(rules)
    patterns = voted.groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    row = patterns.agg(F.array_sort(F.collect_list(F.struct("v", "n"))).alias("ps"))
    soft = f"transform(ps, p -> struct(p.v as v, p.n as n, {_posterior('p.v', 't', m)} as q))"
    total = "aggregate(qs, {0}D, (a, p) -> a + p.n * {1})"
    each = "transform(sequence(1, {m}), j -> greatest({lo}D, least({hi}D, aggregate(qs, {first}D, (a, p) -> a + if(p.v[j - 1] = {vote}, p.n * {q}, 0D)) / {total})))"
    good, bad = total.format(20, "p.q"), total.format(20, "(1 - p.q)")
    step = _let(
        soft,
        "qs",
        f"concat(array(greatest(0.5D, least(0.95D, {total.format(0, 'p.q')} / {total.format(0, '1')}))), "
        + ", ".join(
            (
                each.format(m=m, lo=0.002, hi=0.1, first=0.1, vote=-1, q="p.q", total=good),
                each.format(m=m, lo=0.1, hi=0.95, first=4.0, vote=-1, q="(1 - p.q)", total=bad),
                each.format(m=m, lo=0.5, hi=0.95, first=10.0, vote=1, q="p.q", total=good),
                each.format(m=m, lo=0.05, hi=0.5, first=5.0, vote=1, q="(1 - p.q)", total=bad),
            )
        )
        + ")",
    )
    start = "concat(array(0.9D), " + ", ".join(f"array_repeat({x}D, {m})" for x in (0.02, 0.3, 0.6, 0.4)) + ")"
    out = row.select(F.expr(f"if(size(ps) = 0, {start}, aggregate(sequence(1, {rounds}), {start}, (t, r) -> {step}))").alias("t")).first()
    return list(out.t)


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, threshold: float = 0.5, text: str = "text", columns: list[str] | None = None) -> DataFrame:
    """docs (or the named columns of it) with the columns _tm_f (counts), _tm_base (failed the base), _tm_p (posterior of good) and _tm_keep.

    Counts are written once and read back: the votes name them many times, and an optimiser that merges the two steps
    would count every text anew for each mention.
    """
    from tidemark.llm.common import hold, materialise

    kept = columns if columns is not None else docs.columns
    counted = materialise(features(docs, text).select(*[F.col(f"`{c}`") for c in kept], "_tm_f"))
    hold(docs.sparkSession, counted)
    counted = counted.withColumn("_tm_base", base_failed()).withColumn("_tm_v", votes(rules))
    t = "array(" + ", ".join(f"{x!r}D" for x in fit(counted.select("_tm_v"), rules=rules)) + ")"
    judged = counted.withColumn("_tm_p", F.expr(_posterior("_tm_v", t, len(rules))))
    return judged.withColumn("_tm_keep", ~F.col("_tm_base") & (F.col("_tm_p") >= threshold))


def report(docs: DataFrame, rules: tuple[Rule, ...] = RULES, threshold: float = 0.5) -> DataFrame:
    """The verdict on each row: its base counts, base_failed, kept, and the posterior as quality."""
    # only the counts go to the intermediate table, not the texts
    judged = judge(docs.select("doc_id", F.col("text").alias("_tm_text")), rules, threshold, "_tm_text", ["doc_id"])
    return judged.select(
        "doc_id",
        *[F.col(f"_tm_f.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        F.col("_tm_base").alias("base_failed"),
        F.col("_tm_keep").alias("kept"),
        F.col("_tm_p").alias("quality"),
    )


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES, threshold: float = 0.5) -> DataFrame:
    """The rows that the report keeps, with their own columns."""
    return judge(docs, rules, threshold).where("_tm_keep").select(*[F.col(f"`{c}`") for c in docs.columns])
