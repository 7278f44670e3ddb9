"""Quality rules (operator 2): a threshold table compiled into Spark projections.

Every measure is a built-in expression over the whole text; no user function
runs. Repeated windows are found by hashes first (a text whose window hashes
are all distinct has none) and only else by comparing the windows themselves.

Defined results: null text counts as empty; an empty text has zero measures and
fails the base test; repeated rows are judged alike; an empty table gives no
rows; other columns, whatever their names, aren't read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SPACE = " \t\n\x0b\f\r"
_SYMBOLS = "#*$%&|<>"
WINDOW = 8
STOP_WORDS = tuple(dict.fromkeys("""
the of and to in is it that was for on are with as by be this from at or an not he she they we you his her
le la les de des du un une et en est que qui dans pour par sur au aux ne pas ce se il elle
der die das und ist von zu den mit sich des auf für ein eine nicht als auch dem im es
el los las del al y que en un una por con su para se es lo no como
""".split()))


@dataclass(frozen=True)
class Rule:
    """``measure`` must lie within ``least`` and ``most`` (either may be None)."""

    measure: str
    least: float | None = None
    most: float | None = None


#: The method's verdict; measures are columns of ``measures``.
RULES = (
    Rule("mean_word_chars", 2.0, 14.0),
    Rule("symbols_per_word", None, 0.3),
    Rule("marks_per_word", None, 0.4),
    Rule("stop_word_share", 0.02, None),
    Rule("dup_line_share", None, 0.5),
)


def measures(docs: DataFrame, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, the measures that rules may name, and ``carried``: a struct
    of the columns to carry along."""
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    along = F.struct(*(F.col(f"`{c}`") for c in carry)) if carry else F.lit(None).cast("boolean")
    a = docs.select(F.col(f"`{key}`").alias("doc_id"), t.alias("t"), along.alias("carried"))
    bare = F.btrim("t", F.lit(_SPACE))
    kept = F.col("t")
    a = a.select(
        "doc_id", "carried",
        F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[ \t\n\x0B\f\r]+")).alias("words"),
        F.filter(F.split("t", "\n", -1), lambda x: F.btrim(x, F.lit(_SPACE)) != "").alias("lines"),
        F.length(F.translate(kept, _SPACE, "")).cast("long").alias("word_chars"),
        (F.length(kept) - F.length(F.translate(kept, _SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length(kept) - F.length(F.translate(kept, "!", ""))).cast("long").alias("n_marks"),
    )
    n = F.size("words")
    starts = F.when(n >= WINDOW, F.sequence(F.lit(1), n - WINDOW + 1)).otherwise(F.array().cast("array<int>"))
    a = a.select(
        "doc_id", "carried", "words", "word_chars", "n_symbols", "n_marks",
        n.cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("words", lambda w: w.isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
        starts.alias("starts"),
        F.transform(starts, lambda i: F.xxhash64(F.slice("words", i, WINDOW))).alias("hashes"),
    )
    text_of = lambda i: F.struct(F.array_join(F.slice("words", i, WINDOW), " ").alias("s"), i.alias("i"))
    none = F.array().cast("array<struct<s:string,i:int>>")
    a = a.withColumn("sorted", F.when(F.size(F.array_distinct("hashes")) == F.size("hashes"), none).otherwise(F.sort_array(F.transform("starts", text_of))))
    a = a.drop("words", "starts", "hashes")
    at = lambda j: F.get("sorted", j)["s"]
    twice = F.filter("sorted", lambda x, j: F.coalesce(x["s"] == at(j - 1), F.lit(False)) | F.coalesce(x["s"] == at(j + 1), F.lit(False)))
    found = F.sort_array(F.transform(twice, lambda x: x["i"]))
    zero = F.struct(F.lit(0).alias("total"), F.lit(0).alias("reach"))
    step = lambda acc, i: F.struct((acc["total"] + i + WINDOW - F.greatest(i, acc["reach"])).alias("total"), (i + WINDOW).alias("reach"))
    total = F.aggregate(found, zero, step, lambda acc: acc["total"]).cast("long")
    # the condition always holds; as it isn't deterministic, no filter on the
    # result moves below, where "sorted" would be made anew for each element
    a = a.withColumn("n_repeat_words", F.when(F.monotonically_increasing_id() >= 0, total)).drop("sorted")
    share = lambda x, y: F.when(F.col(y) > 0, F.col(x) / F.col(y)).otherwise(F.lit(0.0))
    return a.select(
        "doc_id", "carried", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words",
        share("word_chars", "n_words").alias("mean_word_chars"),
        share("n_symbols", "n_words").alias("symbols_per_word"),
        share("n_marks", "n_words").alias("marks_per_word"),
        share("n_stop_words", "n_words").alias("stop_word_share"),
        share("n_dup_lines", "n_lines").alias("dup_line_share"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """The table as one boolean expression."""
    out = F.lit(True)
    for rule in rules:
        m = F.col(rule.measure)
        if rule.least is not None:
            out = out & (m >= rule.least)
        if rule.most is not None:
            out = out & (m <= rule.most)
    return out


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``doc_id``, the counts, ``base_failed``, ``kept`` and the measures."""
    m = measures(docs)
    ratios = [r.measure for r in rules]
    return m.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), (~base_failed() & verdict(rules)).alias("kept"), *ratios)


def keep(docs: DataFrame, names: tuple[str, ...], rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that pass, with the named columns; nothing is shuffled."""
    return measures(docs, carry=names).where(~base_failed() & verdict(rules)).select("carried.*")


def _list(words: tuple[str, ...]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def oracle(rules: tuple[Rule, ...] = RULES) -> str:
    """The same in DuckDB's SQL."""
    tests = [f"{r.measure} >= {r.least}" for r in rules if r.least is not None] + [f"{r.measure} <= {r.most}" for r in rules if r.most is not None]
    share = lambda x, y: f"CASE WHEN {y} > 0 THEN {x}::DOUBLE / {y} ELSE 0.0 END"
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, rid, t, list_filter(regexp_split_to_array(t, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS ws,
  list_filter(string_split(t, chr(10)), lambda x: regexp_replace(x, '[ \\t\\n\\x0B\\f\\r]', '', 'g') <> '') AS ls FROM d),
o AS (SELECT rid, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS s FROM (SELECT rid, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w)),
p AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS c FROM o),
r AS (SELECT rid, count(DISTINCT k) AS n FROM (SELECT rid, unnest(range(i, i + {WINDOW})) AS k FROM p WHERE c > 1) GROUP BY rid),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[ \\t\\n\\x0B\\f\\r]', '', 'g'))::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (length(t) - length(replace(t, '!', '')))::BIGINT AS n_marks,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls) AS n_lines,
  len(list_filter(ws, lambda x: x IN ({_list(STOP_WORDS)}))) AS n_stop, coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN r USING (rid)),
q AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  {share('word_chars', 'n_words')} AS mean_word_chars, {share('n_symbols', 'n_words')} AS symbols_per_word,
  {share('n_marks', 'n_words')} AS marks_per_word, {share('n_stop', 'n_words')} AS stop_word_share,
  {share('n_dup_lines', 'n_lines')} AS dup_line_share FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {' AND '.join(tests)} AS kept, {', '.join(r.measure for r in rules)} FROM q
"""
