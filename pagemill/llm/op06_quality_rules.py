"""Quality rules as a short-circuit cascade, in DataFrame expressions only.

Each rule is an expression of its own over the text, true for text to reject. order() takes a bounded sample (the
first SAMPLE_ROWS rows of at most SAMPLE_BYTES bytes that Spark delivers, which reads partitions until it has them; both are
parameters), runs every rule alone on it, once to warm up and then timed, counts what it rejects there, and orders the rules by rejections per
second. A nested CASE evaluates them in that order for each row and stops at the first that rejects; what several rules look at
(the array of words) is made when the first rule that needs it is reached, and not before. The
order changes the cost only: a row is kept if no rule rejects it, so reruns agree.

good() filters by all rules, the base rules among them. judge() returns the counts of every row, so these are made first, and
rules that look at counts only cost nothing more; the others run for rows that no rule before rejects.

Null texts count as empty: all counts are 0 and base_failed is true. Repeated rows give a row each, an empty table gives none; other
columns are not looked at, and good() keeps them, whatever their names. Texts of any length are taken whole.
Eight-word windows are compared by 64-bit hashes of the words' 64-bit hashes, within one text.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.shared import SPACES, WORD, discard, let, table, without, written

SYMBOLS = "#*$%&|<>"
WINDOW = 8
SAMPLE_ROWS, SAMPLE_BYTES = 1000, 1 << 15


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def lines(text: Column) -> Column:
    """Lines with a word."""
    return F.filter(F.split(text, "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))


def n_symbols(text: Column) -> Column:
    """Symbols are single bytes, so bytes that go with them count them."""
    return (F.octet_length(text) - F.octet_length(without(text, SYMBOLS))).cast("long")


def n_repeat_words(w: Column, window: int = WINDOW) -> Column:
    """Words inside windows that occur twice or more. Texts without a repeated window, most of
    them, end at the distinct count; for others the windows are sorted by hash, those with an
    equal neighbour are put in order of position again, and their lengths without overlaps added."""

    def covered(x):
        def starts(p):
            twice = lambda j: ((j > 0) & (F.get(p, j - 1)["v"] == F.get(p, j)["v"])) | (F.get(p, j + 1)["v"] == F.get(p, j)["v"])
            return F.array_sort(F.filter(F.transform(F.sequence(F.lit(0), F.size(p) - 1), lambda j: F.when(twice(j), F.get(p, j)["i"])), lambda i: i.isNotNull()))

        def total(s):
            step = lambda j: F.least(F.lit(window), F.coalesce(F.get(s, j + 1) - F.get(s, j), F.lit(window)))
            return F.aggregate(F.sequence(F.lit(0), F.size(s) - 1), F.lit(0), lambda a, j: a + step(j))

        return let(F.array_sort(F.transform(x, lambda v, i: F.struct(v.alias("v"), i.alias("i")))), lambda p: let(starts(p), total))

    def counted(h):
        hashes = F.transform(F.sequence(F.lit(0), F.size(h) - window), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(window)]))
        return let(hashes, lambda x: F.when(F.size(F.array_distinct(x)) == F.size(x), 0).otherwise(covered(x)))

    return F.when(F.size(w) <= window, 0).otherwise(let(F.transform(w, lambda x: F.xxhash64(x)), counted)).cast("long")


def n_stutter(w: Column) -> Column:
    """Words equal to the one before."""
    same = F.aggregate(F.sequence(F.lit(1), F.size(w)), F.lit(0), lambda a, i: a + F.when(F.get(w, i) == F.get(w, i - 1), 1).otherwise(0))
    return F.when(F.size(w) == 0, 0).otherwise(same)


def letters(text: Column, kind: str) -> Column:
    return F.char_length(F.regexp_replace(text, f"\\P{{{kind}}}+", ""))


@dataclass(frozen=True)
class Facts:
    """What rules look at. Counts that are known are columns, others are expressions of the text."""

    text: Column
    words: Column | None = None
    counts: Column | None = None

    def count(self, name: str, otherwise: Callable[[], Column]) -> Column:
        return otherwise() if self.counts is None else self.counts[name]

    def n_words(self) -> Column:
        return self.count("n_words", lambda: F.regexp_count(self.text, F.lit(WORD)) if self.words is None else F.size(self.words))

    def word_chars(self) -> Column:
        return self.count("word_chars", lambda: F.char_length(without(self.text, SPACES)))

    def n_symbols(self) -> Column:
        return self.count("n_symbols", lambda: n_symbols(self.text))

    def n_repeat_words(self) -> Column:
        return self.count("n_repeat_words", lambda: n_repeat_words(self.words))

    def line_share(self, over: Callable[[Column, Column], Column]) -> Column:
        """over(repeated lines, lines)."""
        return let(lines(self.text), lambda x: over(F.size(x) - F.size(F.array_distinct(x)), F.size(x)))


@dataclass(frozen=True)
class Rule:
    """rejects(facts); needs_words: it looks at the array of words."""

    rejects: Callable[[Facts], Column]
    needs_words: bool = False


#: The rules of the contract.
BASE = {
    "too_short": Rule(lambda f: f.n_words() < 20),
    "repeated_words": Rule(lambda f: 100 * f.n_repeat_words() > 30 * f.n_words(), True),
}
#: Default rules. The limits only meet plain junk.
RULES = {
    "symbols": Rule(lambda f: f.n_symbols() * 10 > f.n_words()),
    "repeated_lines": Rule(lambda f: f.line_share(lambda again, n: again * 10 > n * 4)),
    "stutter": Rule(lambda f: n_stutter(f.words) * 2 > f.n_words(), True),
    "word_length": Rule(lambda f: (f.word_chars() < 2 * f.n_words()) | (f.word_chars() > 20 * f.n_words())),
    "shouting": Rule(lambda f: letters(f.text, "Lu") * 10 > letters(f.text, "L") * 6),
}


def order(df: DataFrame, found: dict[str, Column], sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """Names by rejections per second on the first rows of df, best first. found: columns over df."""
    rows = df.limit(sample_rows).collect()  # reads partitions, the first one and then more, until it has them
    sample = written(df.sparkSession.createDataFrame(rows, df.schema).coalesce(1), "rule-sample")

    def timed(rule):
        began = time.perf_counter()
        hit = sample.agg(F.sum(F.when(rule, 1).otherwise(0))).head()[0] or 0
        return hit, time.perf_counter() - began

    def warm(rule):
        timed(rule)
        return timed(rule)

    floor = warm(F.lit(False))[1]
    rate = {}
    for name, rule in found.items():
        hit, s = warm(rule)
        rate[name] = hit / max(s - floor, 1e-3)
    discard(sample)
    return sorted(found, key=lambda k: (-rate[k], k))


def measured_order(df: DataFrame, rules: dict[str, Rule], sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> list[str]:
    """order() of the rules, each alone. df: text."""
    facts = Facts(F.col("text"))

    def with_words(rule: Rule) -> Column:
        return let(words(facts.text), lambda w: rule.rejects(replace(facts, words=w)))

    alone = {k: with_words(r) if r.needs_words else r.rejects(facts) for k, r in rules.items()}
    return order(df.select("text").where(F.octet_length("text") <= sample_bytes), alone, sample_rows)


def passes(names: list[str], rules: dict[str, Rule], facts: Facts) -> Column:
    """True where no rule rejects, evaluated in this order."""
    if not names:
        return F.lit(True)
    first = rules[names[0]]
    if first.needs_words and facts.words is None:
        return let(words(facts.text), lambda w: passes(names, rules, replace(facts, words=w)))
    return F.when(F.coalesce(first.rejects(facts), F.lit(False)), F.lit(False)).otherwise(passes(names[1:], rules, facts))


def good(docs: DataFrame, text_col: str = "text", rules: dict[str, Rule] = BASE | RULES) -> DataFrame:
    """The rows of docs that pass, with all their columns."""
    d = docs.select(F.struct("*").alias("doc"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    return d.where(passes(measured_order(d, rules), rules, Facts(F.col("text")))).select("doc.*")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: dict[str, Rule] = RULES) -> DataFrame:
    """doc_id, the counts, base_failed and kept, a row for each row of docs."""
    d = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    names, text = measured_order(d, rules), F.col("text")
    counted = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def of_words(w):
        f = Facts(text, w)
        counts = dict(zip(counted, (f.n_words(), f.word_chars(), f.n_symbols(), f.line_share(lambda again, n: again), f.n_repeat_words()), strict=True))

        def verdict(c):
            base = BASE["too_short"].rejects(replace(f, counts=c)) | BASE["repeated_words"].rejects(replace(f, counts=c))
            kept = F.when(base, F.lit(False)).otherwise(passes(names, rules, replace(f, counts=c)))
            return F.struct(*[c[k].alias(k) for k in counted], base.alias("base_failed"), kept.alias("kept"))

        return let(F.struct(*[v.cast("long").alias(k) for k, v in counts.items()]), verdict)

    m = d.select("doc_id", let(words(text), of_words).alias("m"))
    return m.select("doc_id", *[F.col(f"m.{k}") for k in (*counted, "base_failed", "kept")])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS s FROM t, unnest(range(1, len(w) - 6)) AS u(i) WHERE len(w) >= 8),
dup AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
gap AS (SELECT doc_id, least(8, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 8)) AS n FROM dup),
rep AS (SELECT doc_id, sum(n)::BIGINT AS n FROM gap GROUP BY doc_id),
stutter AS (SELECT doc_id, count(*) AS n FROM t, unnest(range(1, len(w))) AS u(i) WHERE w[i] = w[i + 1] GROUP BY doc_id),
m AS (SELECT t.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, len(l) AS n_lines,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(stutter.n, 0) AS n_stutter,
  length(regexp_replace(text, '\P{Lu}+', '', 'g')) AS upper_n, length(regexp_replace(text, '\P{L}+', '', 'g')) AS letter_n
  FROM t LEFT JOIN rep USING (doc_id) LEFT JOIN stutter USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR n_symbols * 10 > n_words OR n_dup_lines * 10 > n_lines * 4 OR n_stutter * 2 > n_words
    OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR upper_n * 10 > letter_n * 6) AS kept FROM b
"""
