r"""Quality rules: a table of thresholds compiled into one Spark projection.

Every measure is a built-in expression, so the plan is one scan and two
projections: no shuffle, no user function, nothing sent to the driver. A document
is read once, whole, and needs memory for its own words only.

Defined results: a null, empty or blank text has zero of everything and fails the
base rule (fewer than ten words); very long texts are measured whole. Nulls in other
columns do not matter. Of lines that are alike (ties) the first is no repetition, of
windows every one is; windows are compared by 64-bit hashes within one text. Repeated
rows are judged each alone. Every input column is kept, whatever its name; the measures
are put into one struct column, whose name has to be new. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.llm.columns import free_name, own

WORD_BREAK = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in is that it for as was with be by on at this from are or an not "
    "le la les de des du un une et en que qui dans pour par sur au il est pas "
    "der die das und ist den von zu mit ein eine auf im nicht dem sich es auch als "
    "el los las y del se una con para su al lo como más no"
).split()


@dataclass(frozen=True)
class Rule:
    """``measure`` has to lie in [least, most] for texts of ``from_words`` words or more."""

    measure: str
    least: float | None = None
    most: float | None = None
    from_words: int = 0


#: The verdict's thresholds, all of which have to hold.
RULES = (
    Rule("mean_word_chars", 2.0, 14.0),
    Rule("symbols_per_word", most=0.3),
    Rule("stop_word_ratio", least=0.05, from_words=20),
    Rule("dup_line_ratio", most=0.3),
)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a.cast("double") / b).otherwise(F.lit(0.0))


def repeated_window_words(words: Column, n: int = 5) -> Column:
    """Words that lie in an ``n``-word window found twice or more in ``words``.

    Most texts repeat no window, which a comparison of the number of distinct
    window hashes tells. For the others windows are sorted with their positions, so
    that equal ones are neighbours, and the union of their extents is measured in
    one pass: n log n steps for any text, however repetitive.
    """

    def extent(windows: Column) -> Column:
        by_hash = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = let(
            by_hash,
            lambda s: F.filter(
                F.transform(
                    s,
                    lambda x, j: F.when(
                        F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False))
                        | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False)),
                        x["i"],
                    ),
                ),
                lambda i: i.isNotNull(),
            ),
        )
        return let(
            F.sort_array(twice),
            lambda p: F.aggregate(
                F.transform(p, lambda i, j: F.least(F.lit(n), F.coalesce(F.get(p, j + 1) - i, F.lit(n)))),
                F.lit(0),
                lambda a, x: a + x,
            ),
        )

    hashes = F.transform(
        F.sequence(F.lit(0), F.size(words) - n), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(n)])
    )
    counted = let(
        hashes, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(extent(w))
    )
    return F.when(F.size(words) <= n, F.lit(0)).otherwise(counted).cast("long")


def measures(text: Column, words: Column) -> dict[str, Column]:
    """The measures of a non-null text with its non-empty words."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_stop_words": F.size(F.filter(words, lambda w: F.lower(w).isin(STOP_WORDS))).cast("long"),
        "n_repeat_words": repeated_window_words(words),
    }


def verdict(m: Column, rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """(base rule fails, every threshold of the table holds)."""
    derived = {
        "mean_word_chars": _ratio(m["word_chars"], m["n_words"]),
        "symbols_per_word": _ratio(m["n_symbols"], m["n_words"]),
        "stop_word_ratio": _ratio(m["n_stop_words"], m["n_words"]),
        "dup_line_ratio": _ratio(m["n_dup_lines"], m["n_lines"]),
    }
    base_failed = (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])
    holds = F.lit(True)
    for r in rules:
        x = derived[r.measure]
        ok = F.lit(True)
        if r.least is not None:
            ok = ok & (x >= r.least)
        if r.most is not None:
            ok = ok & (x <= r.most)
        holds = holds & ((m["n_words"] < r.from_words) | ok)
    return base_failed, holds


def judge_quality(
    df: DataFrame, text: str = "text", into: str = "quality", rules: tuple[Rule, ...] = RULES
) -> DataFrame:
    """``df`` and a struct column ``into`` of measures, ``base_failed`` and ``kept``.

    ``into`` has to be a name that ``df`` doesn't have.
    """
    kept = own(df)
    words, made_ = free_name(df, "words"), free_name(df, "measures")
    whole = F.coalesce(F.col(text), F.lit(""))
    split = df.select(*kept, F.filter(F.split(whole, WORD_BREAK), lambda w: w != "").alias(words))
    made = F.struct(*[c.alias(k) for k, c in measures(whole, F.col(words)).items()])
    # What hangs on a row's number (always true here) is computed once: the optimizer
    # neither copies it into each place that reads a measure nor pushes a later filter
    # on the verdict below it, where words would be split anew for every window.
    measured = split.select(*kept, F.when(F.monotonically_increasing_id() >= 0, made).alias(made_))
    m = F.col(made_)
    base_failed, holds = verdict(m, rules)
    fields = [m[k].alias(k) for k in measures(whole, whole)]
    return measured.select(
        *kept, F.struct(*fields, base_failed.alias("base_failed"), (~base_failed & holds).alias("kept")).alias(into)
    )


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_stop_words", "n_lines")
    return judge_quality(docs).select("doc_id", *[f"quality.{k}" for k in names])


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the rules keep."""
    name = free_name(docs, "quality")
    return judge_quality(docs, into=name).where(F.col(name)["kept"]).drop(name)


_STOP_SQL = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))

SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT r, doc_id, t,
         list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM d
), win AS (
  SELECT r, i, words[i] || ' ' || words[i+1] || ' ' || words[i+2] || ' ' || words[i+3] || ' ' || words[i+4] AS g
  FROM (SELECT r, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM win) WHERE c >= 2
), covered AS (
  SELECT r, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest(range(0, 5)) AS k) GROUP BY r
), m AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) AS BIGINT) AS n_lines,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(len(list_filter(words, lambda x: lower(x) IN ({_STOP_SQL}))) AS BIGINT) AS n_stop_words,
         CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN covered USING (r)
), v AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed
         AND word_chars / n_words BETWEEN 2.0 AND 14.0
         AND n_symbols / n_words <= 0.3
         AND (n_words < 20 OR n_stop_words / n_words >= 0.05)
         AND (n_lines = 0 OR n_dup_lines / n_lines <= 0.3) AS kept,
       n_stop_words, n_lines
FROM v
"""
