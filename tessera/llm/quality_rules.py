"""Quality rules: a threshold table compiled into one chain of projections - no user function, no shuffle.

Every text is measured whole. Null and blank texts have no words: all counts are 0, ratios are null-safe zeros, and the word
minimum rejects them. Rows are independent, so ties and repeated rows each get their own verdict; columns other than the id and
the text are never looked at; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK, ascii_lower, words

# Common function words of the four languages, lower case.
STOP_WORDS = (
    "the", "and", "of", "to", "in", "that", "is", "was", "for", "with", "on", "it", "be", "are", "by", "this",
    "le", "la", "les", "de", "des", "et", "que", "un", "une", "en", "dans", "est", "par", "pour", "avec", "du", "qui",
    "der", "die", "das", "und", "ist", "den", "dem", "ein", "eine", "mit", "von", "zu", "nicht", "auf", "im", "für",
    "el", "los", "las", "y", "se", "con", "no", "al", "para",
)


@dataclass(frozen=True)
class Rule:
    """Reject a text where `measure` (a ratio or count by name) lies outside [least, most]; `above` words only."""

    name: str
    measure: str
    least: float | None = None
    most: float | None = None
    above: int = 0


#: The table that the projection is compiled from. Ratios are per word, per line or per character of words as their names say.
RULES = (
    Rule("length", "n_words", least=20),
    Rule("repeats", "repeat_ratio", most=0.30),
    Rule("word_length", "mean_word_chars", least=2.0, most=14.0),
    Rule("symbols", "symbol_ratio", most=0.10),
    Rule("capitals", "capital_ratio", most=0.40),
    Rule("lines", "dup_line_ratio", most=0.50),
    Rule("stop_words", "stop_ratio", least=0.02, above=50),
)


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, the counts and the ratios of each text."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col), t.alias("t"), words(t).alias("w"))
    base = base.select(
        id_col, "t", "w",
        F.size("w").cast("long").alias("n_words"),
        F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        # Windows by hash; a text whose window hashes are all different has no repeated window, exactly.
        F.when(F.size("w") > 8, F.transform(F.sequence(F.lit(1), F.size("w") - 7), lambda i: F.xxhash64(*[F.element_at("w", i + k) for k in range(8)]))).alias("h"),
    )
    # Where a hash recurs, windows are compared as word arrays, so no collision can count.
    exact = F.array_sort(F.transform(F.sequence(F.lit(0), F.size("w") - 8), lambda i: F.struct(F.slice("w", i + 1, 8).alias("g"), i.alias("p"))))
    base = base.select(
        id_col, "t", "w", "n_words", "lines",
        F.when(F.size("h") > F.size(F.array_distinct("h")), exact).alias("s"),
    )
    same = F.transform("s", lambda x, i: F.when(
        ((i > 0) & (x["g"] == F.get("s", i - 1)["g"])) | ((i + 1 < F.size("s")) & (x["g"] == F.get("s", i + 1)["g"])), x["p"]))
    base = base.select(id_col, "t", "w", "n_words", "lines", F.array_sort(F.filter(same, lambda p: p.isNotNull())).alias("p"))
    covered = F.aggregate(F.transform("p", lambda p, i: F.least(F.lit(8), F.coalesce(F.get("p", i + 1), F.lit(2147483647)) - p)), F.lit(0), lambda a, x: a + x)
    n_lines = F.size("lines")
    out = base.select(
        id_col, "n_words",
        F.length(F.translate("t", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (n_lines - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        n_lines.cast("long").alias("n_lines"),
        (F.length("t") - F.length(F.regexp_replace("t", r"\p{Lu}+", ""))).cast("long").alias("n_capitals"),
        F.size(F.filter("w", lambda x: ascii_lower(x).isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
    )

    def ratio(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)

    return out.select(
        "*", ratio("word_chars", "n_words").alias("mean_word_chars"), ratio("n_symbols", "n_words").alias("symbol_ratio"), ratio("n_dup_lines", "n_lines").alias("dup_line_ratio"),
        ratio("n_repeat_words", "n_words").alias("repeat_ratio"), ratio("n_capitals", "word_chars").alias("capital_ratio"), ratio("n_stop_words", "n_words").alias("stop_ratio"),
    )


def compile_rules(rules: tuple[Rule, ...] = RULES) -> Column:
    """array<string> of the names of the rules that a row of `measures` breaks."""

    def broken(r: Rule) -> Column:
        c = F.lit(False)
        if r.least is not None:
            c = c | (F.col(r.measure) < r.least)
        if r.most is not None:
            c = c | (F.col(r.measure) > r.most)
        return c & (F.col("n_words") >= r.above)

    return F.filter(F.array(*[F.when(broken(r), F.lit(r.name)) for r in rules]), lambda x: x.isNotNull())


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measures of each document, `base_failed`, the names of broken rules in `broken`, and `kept` (no rule broken)."""
    m = measures(docs, id_col, text_col).withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    m = m.withColumn("broken", compile_rules(rules))
    return m.withColumn("kept", ~F.col("base_failed") & (F.size("broken") == 0))


def rule_sql(rules: tuple[Rule, ...] = RULES, table: str = "documents") -> str:
    """The same table of thresholds compiled for DuckDB."""
    broken = []
    for r in rules:
        parts = ([f"{r.measure} < {r.least}"] if r.least is not None else []) + ([f"{r.measure} > {r.most}"] if r.most is not None else [])
        broken.append(f"(n_words >= {r.above} and ({' or '.join(parts)}))")
    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return rf"""
with t as (select doc_id, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from {table}),
m as (select doc_id, t, w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) lines from t),
g as (select doc_id, i, w[i:i+7] g from (select doc_id, w, unnest(range(1, len(w) - 6)) i from m where len(w) >= 8)),
d as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) n from g) where n > 1),
r as (select doc_id, sum(least(8, coalesce(nx, 2147483647) - i)) n from (select doc_id, i, lead(i) over (partition by doc_id order by i) nx from d) group by doc_id),
c as (select m.doc_id, len(w)::bigint n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::bigint word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint n_symbols, (len(lines) - len(list_distinct(lines)))::bigint n_dup_lines,
  coalesce(r.n, 0)::bigint n_repeat_words, len(lines)::bigint n_lines,
  length(t) - length(regexp_replace(t, '\p{{Lu}}+', '', 'g')) n_capitals,
  len(list_filter(w, lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') in ({stops}))) n_stop_words
  from m left join r using (doc_id)),
q as (select *, case when n_words > 0 then word_chars::double / n_words else 0 end mean_word_chars, case when n_words > 0 then n_symbols::double / n_words else 0 end symbol_ratio,
  case when n_lines > 0 then n_dup_lines::double / n_lines else 0 end dup_line_ratio, case when n_words > 0 then n_repeat_words::double / n_words else 0 end repeat_ratio,
  case when word_chars > 0 then n_capitals::double / word_chars else 0 end capital_ratio, case when n_words > 0 then n_stop_words::double / n_words else 0 end stop_ratio,
  n_words < 20 or 100 * n_repeat_words > 30 * n_words base_failed from c)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not (base_failed or {' or '.join(broken)}) kept from q
"""
