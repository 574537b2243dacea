"""Quality rules, line first, in DataFrame functions only.

Each line with a word is judged by three rules, whatever its length: punctuation
(it has a letter, few of its characters are marks of ``[#*$%&|<>]``, and a line of
some words has a sentence mark), navigation (it isn't a row of menu entries: of
``LEAST_ENTRIES`` or more entries between ``SEPARATORS``, at least ``SHORT_SHARE``
are no longer than ``ENTRY_CHARS``) and boilerplate (notices and prompts of web
pages make up less than ``BOILERPLATE_SHARE`` of it). Lines that fail a rule are
taken out; a document that loses more than ``MOST_LOST`` of the characters of its
words is rejected, as is one that fails the base rules.

Null text has no words. Empty and blank texts have neither words nor lines.
Every row is judged alone, so ties and repeated rows change nothing, and no row
moves between tasks; other columns are not read. Three-word windows are
compared by a hash of which at least 40 bits are kept beside the place, and
equal hashes by their words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxlane.llm.common import SPACE

SYMBOLS = "#*$%&|<>"
MOST_LOST = 0.6
#: Share of a line's characters that may be symbols.
SYMBOL_SHARE = 0.1
LEAST_WORDS, MOST_REPEATED = 50, 0.5
BOILERPLATE = (
    "(?i)(all rights reserved|terms of (use|service)|privacy policy|cookie(s| policy)|enable javascript|click here|sign up|log ?in to|subscribe (now|to)"
    "|read more|share (this|on)|follow us|licensed under|copyright)"
)
#: A phrase of these makes a line boilerplate if the phrases hold such a share of its characters.
BOILERPLATE_SHARE = 0.05
#: Marks between the entries of a menu, how many entries make one, and how many of them are short.
SEPARATORS, LEAST_ENTRIES, ENTRY_CHARS, SHORT_SHARE = "[|>»·•]", 3, 24, 0.8


def _drop(text: Column, marks: str) -> Column:
    for m in marks:
        text = F.replace(text, F.lit(m), F.lit(""))
    return text


def _held(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that later steps read as values: a generator keeps them from being copied into lambdas."""
    names = list(columns)
    packed = F.array(F.struct(*[columns[n].alias(n) for n in names]))
    return df.select("*", F.inline(packed))


def measured(documents: DataFrame) -> DataFrame:
    """doc_id, text, words (array), lines (array) and the base counts of every row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    bare = F.trim(text, F.lit(SPACE))
    split = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, "[\\x20\\x09-\\x0D]+"))
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x, F.lit(SPACE)) != "")
    df = _held(documents.select("doc_id", text.alias("text")), words=split, lines=lines)
    n = F.size("words")
    # a window's hash gives its upper bits to its place: sorting brings equal windows together
    bits = F.greatest(F.lit(1), F.ceil(F.log2(n + 1)).cast("int"))
    df = _held(df, n_words=n.cast("long"), bits=bits)
    packed = F.expr("transform(sequence(0, cast(n_words as int) - 3), i -> shiftleft(xxhash64(words[i], words[i + 1], words[i + 2]), bits) | cast(i as bigint))")
    df = _held(df, keys=F.when(F.col("n_words") >= 3, F.sort_array(packed)).otherwise(F.array().cast("array<bigint>")))
    # neighbours of equal hash and equal words
    same = (
        "k > 0 and shiftrightunsigned(keys[k - 1], bits) = shiftrightunsigned(x, bits)"
        " and words[place(keys[k - 1])] = words[place(x)] and words[place(keys[k - 1]) + 1] = words[place(x) + 1] and words[place(keys[k - 1]) + 2] = words[place(x) + 2]"
    )
    after = same.replace("keys[k - 1]", "get(keys, k + 1)").replace("k > 0 and ", "")
    hit = f"({same}) or (k + 1 < size(keys) and {after})"
    for name in ("keys[k - 1]", "get(keys, k + 1)", "x"):
        hit = hit.replace(f"place({name})", f"cast({name} & (shiftleft(1L, bits) - 1) as int)")
    found = F.expr(f"sort_array(transform(filter(keys, (x, k) -> {hit}), x -> cast(x & (shiftleft(1L, bits) - 1) as int)))")
    df = _held(df, places=found)
    repeated = F.expr("aggregate(places, struct(0L as n, -3 as last), (a, p) -> struct(a.n + least(3, p - a.last) as n, p as last), a -> a.n)")
    return df.select(
        "doc_id", "text", "lines", "n_words",
        F.length(_drop(F.col("text"), SPACE)).cast("long").alias("word_chars"),
        (F.octet_length("text") - F.octet_length(_drop(F.col("text"), SYMBOLS))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated.cast("long").alias("n_repeat_words"),
    )


def line_passes(line: Column) -> Column:
    """Whether a line passes the punctuation, navigation and boilerplate rules."""
    symbols = F.octet_length(line) - F.octet_length(_drop(line, SYMBOLS))
    lettered = line.rlike("\\p{L}")
    # a split with a limit looks at eight words and no more; a pattern would try every start of a long run
    few = F.size(F.split(F.trim(line, F.lit(SPACE)), "[\\x20\\x09-\\x0D]+", 9)) < 8
    ended = line.rlike("[.!?…。？！:;,\"'”)]") | few
    entries = F.filter(F.split(line, SEPARATORS), lambda e: F.trim(e, F.lit(SPACE)) != "")
    short = F.filter(entries, lambda e: F.length(F.trim(e, F.lit(SPACE))) <= ENTRY_CHARS)
    menu = line.rlike(SEPARATORS) & (F.size(entries) >= LEAST_ENTRIES) & (F.size(short) >= F.size(entries) * SHORT_SHARE)
    notices = F.length(line) - F.length(F.regexp_replace(line, BOILERPLATE, ""))
    notice = line.rlike(BOILERPLATE) & (notices >= F.length(line) * BOILERPLATE_SHARE)
    return lettered & (symbols <= F.length(line) * SYMBOL_SHARE) & ended & ~menu & ~notice


def clean(documents: DataFrame) -> DataFrame:
    """Base counts, clean_text (the lines that pass), base_failed and kept of every row."""
    df = _held(measured(documents), passed=F.filter("lines", line_passes))
    left = F.length(_drop(F.concat_ws("\n", "passed"), SPACE))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > int(100 * MOST_REPEATED) * F.col("n_words"))
    enough = left >= F.col("word_chars") * (1 - MOST_LOST)
    return df.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & enough).alias("kept"), F.concat_ws("\n", "passed").alias("clean_text"),
    )


def verdicts(documents: DataFrame) -> DataFrame:
    return clean(documents).drop("clean_text")


def _bare(name: str) -> str:
    return f"regexp_replace({name}, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g')"


#: The same in DuckDB's SQL.
ORACLE = f"""
WITH base AS (
  SELECT row_number() OVER () AS rn, doc_id, coalesce(text, '') AS text FROM documents
), split AS (
  SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines,
         regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words
  FROM base
), grams AS (
  SELECT rn, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram
  FROM (SELECT rn, words, unnest(range(1, len(words) - 1)) AS i FROM split)
), repeated AS (
  SELECT rn, i FROM (SELECT rn, i, count(*) OVER (PARTITION BY rn, gram) AS n FROM grams) WHERE n > 1
), covered AS (
  SELECT rn, count(DISTINCT p) AS n FROM (SELECT rn, i + unnest([0, 1, 2]) AS p FROM repeated) GROUP BY rn
), counted AS (
  SELECT s.rn, doc_id, lines, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
         list_filter(lines, lambda x: regexp_matches(x, '\\p{{L}}')
           AND length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g')) <= length(x) * {SYMBOL_SHARE}
           AND (regexp_matches(x, '[.!?…。？！:;,"''”)]') OR len(regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+')) < 8)
           AND NOT (len(list_filter(string_split_regex(x, '{SEPARATORS}'), lambda e: {_bare("e")} <> '')) >= {LEAST_ENTRIES}
             AND len(list_filter(string_split_regex(x, '{SEPARATORS}'), lambda e: length({_bare("e")}) BETWEEN 1 AND {ENTRY_CHARS}))
               >= len(list_filter(string_split_regex(x, '{SEPARATORS}'), lambda e: {_bare("e")} <> '')) * CAST({SHORT_SHARE} AS DOUBLE))
           AND NOT (regexp_matches(x, '{BOILERPLATE}')
             AND length(x) - length(regexp_replace(x, '{BOILERPLATE}', '', 'g')) >= length(x) * CAST({BOILERPLATE_SHARE} AS DOUBLE))) AS passed
  FROM split s LEFT JOIN covered c ON s.rn = c.rn
), judged AS (
  SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {int(100 * MOST_REPEATED)} * n_words AS base_failed,
         length(regexp_replace(array_to_string(passed, chr(10)), '[\\x20\\x09-\\x0D]', '', 'g')) >= word_chars * {1 - MOST_LOST} AS enough
  FROM counted
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND enough AS kept FROM judged
"""
