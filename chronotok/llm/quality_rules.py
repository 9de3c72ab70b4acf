"""Quality rules (operator 3): line-first cleaning with native column functions only.

The lines of a text are judged first: punctuation (symbols in place of prose, runs of marks, long lines without any
sentence mark), navigation (separators, menu words, bare links, runs of short lines without a mark) and boilerplate
(licence, cookie, copyright and similar notices). Failing lines are removed, and a document that loses more than
``max_lost`` of its word characters is rejected.

Two rules look beyond the line. A long line without a sentence mark stays where it is plainly wrapped prose: the
sentence goes on in the next lines, which do not begin with a capital, and ends there, or it began in such a way in
the lines before. A line of at most ``SHORT_WORDS`` words without a mark is a menu entry where ``MENU_RUN`` such lines
follow one another, whatever their language. For both a text is written as one letter a line, and one pattern over
these letters finds the lines that go. Everything is evaluated inside one row, so there is no shuffle and no group
that a hot key could fill.

Defined results: a null or empty text has no words, fails the base rule and is rejected; rows are judged one by
one, so repeated rows and ties give repeated results; extra columns stay inside ``row``; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from chronotok.llm.text import WHITE, words

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
MAX_LOST = 0.5

LONG_WORDS = 12
SHORT_WORDS = 3
MENU_RUN = 4
WRAPPED_LINES = 8

# Sentence marks: Latin, Greek, Armenian, Arabic, Urdu, Devanagari, Myanmar, Ethiopic, Khmer, Chinese and Japanese.
SENTENCE_MARK = ("[.!?\\u2026\\u037E\\u0589\\u061F\\u06D4\\u0964\\u0965\\u104A\\u104B\\u1362\\u1367\\u17D4"
                 "\\u3002\\uFF01\\uFF1F\\uFF61]")
ENDS_SENTENCE = SENTENCE_MARK + "[\"'\u201D\u2019\u00BB\u300D)\\]]*$"
GOES_ON = "[\\p{Ll}\\p{Lo}\\p{Lm}]"  # a first letter that is no capital
MARK_RUN = "[!?]{2,}"
SEPARATOR = "[|\\u00BB\\u203A\\u2022\\u00B7]"
MENU_LINE = ("(?i)^(home|menu|log ?in|log ?out|sign ?(in|up)|register|search|next|previous|back|top|share|"
             "contact( us)?|about( us)?|sitemap|skip to (main )?content|read more|click here)[ .:!]*$")
BARE_LINK = "^[\\x20\\x09-\\x0D]*(https?://|www\\.)[^\\x20\\x09-\\x0D]+[\\x20\\x09-\\x0D]*$"
COPYRIGHT = "(\u00A9|\\(c\\)) ?[0-9]{4}"
BOILERPLATE = ("all rights reserved", "licensed under", "released under the", "accept cookies", "accept all cookies",
               "uses cookies", "use cookies", "cookie policy", "cookie settings", "privacy policy", "terms of use",
               "terms of service", "terms and conditions", "enable javascript", "lorem ipsum", "subscribe to our")


def line_code(line: Column, low: Column, n: Column) -> Column:
    """One letter for a line of ``n`` words; ``low`` is the line in lower case.

    ``-`` fails on its own; ``e`` has no word; with a sentence mark ``E`` ends in one and ``M`` does not; without one
    ``s`` is short, ``m`` is of middle length and ``D`` long. F, C, c and d are E, M, m and D beginning without a
    capital.
    """
    notice = (F.contains(low, F.lit("\u00A9")) | F.contains(low, F.lit("(c)"))) & low.rlike(COPYRIGHT)
    for phrase in BOILERPLATE:
        notice = notice | F.contains(low, F.lit(phrase))
    link = (F.contains(low, F.lit("://")) | F.contains(low, F.lit("www."))) & low.rlike(BARE_LINK)
    many = lambda pattern: F.regexp_count(line, F.lit(pattern)) * 5 > n
    trimmed = F.btrim(line, F.lit(WHITE))
    on = F.substring(trimmed, 1, 1).rlike(GOES_ON)
    either = lambda goes_on, begins: F.when(on, F.lit(goes_on)).otherwise(F.lit(begins))
    return (F.when(n == 0, F.lit("e"))
            .when(many("[#*$%&|<>]") | many(MARK_RUN) | many(SEPARATOR) | line.rlike(MENU_LINE) | link | notice, F.lit("-"))
            .when(F.right(trimmed, F.lit(4)).rlike(ENDS_SENTENCE), either("F", "E"))
            .when(line.rlike(SENTENCE_MARK), either("C", "M"))
            .when(n <= SHORT_WORDS, F.lit("s"))
            .when(n < LONG_WORDS, either("c", "m"))
            .otherwise(either("d", "D")))


def _failing() -> str:
    """Pattern of the letters, in a text's letters, of lines that fail by what stands around them."""
    wrapped = f"[cd]{{0,{WRAPPED_LINES}}}"
    menu = [f"(?<=s{{{k}}})s(?=s{{{MENU_RUN - 1 - k}}})" for k in range(MENU_RUN)]
    return "|".join([f"D(?!{wrapped}[CF])", f"(?<![MC]{wrapped})d(?!{wrapped}[CF])", *menu])


def _repeated_words(n: Column, hashes: Column) -> Column:
    """Words inside windows whose hash occurs twice or more: sort (hash, start), compare neighbours, join spans."""
    m = F.size(hashes)
    ordered = F.sort_array(F.arrays_zip(hashes.alias("h"), F.sequence(F.lit(0), m - 1).alias("p")))
    return F.when(F.size(F.array_distinct(hashes)) < m, ordered)


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the whole input ``row``, its id, the cleaned text, the counted features and what was
    lost."""
    nothing = F.array().cast("array<bigint>")
    d = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), F.col(id_col).alias("doc_id"),
                    F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    d = d.withColumn("_words", words(F.col("_t"))).withColumn("_low", F.transform(F.split("_t", "\n"), F.lower))
    d = d.withColumn("_lines", F.split("_t", "\n"))
    counts = F.transform("_lines", lambda x: F.regexp_count(x, F.lit("[^\\x20\\x09-\\x0D]+")))
    d = d.withColumn("_codes", F.transform(F.arrays_zip("_lines", "_low", counts.alias("n")),
                                           lambda x: line_code(x["_lines"], x["_low"], x["n"])))
    fate = F.regexp_replace(F.array_join("_codes", ""), F.lit(_failing()), F.lit("-"))
    d = d.withColumn("_lines", F.arrays_zip(F.col("_lines").alias("line"), F.col("_codes").alias("code"),
                                            F.split(fate, "").alias("fate")))
    d = d.withColumn("_w", F.transform("_words", lambda w: F.xxhash64(w)))
    n = F.size("_w")
    shifted = [F.slice("_w", j + 1, n - (WINDOW - 1)).alias(f"w{j}") for j in range(WINDOW)]
    d = d.select(
        "row", "doc_id", "_t", F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.when(n >= WINDOW, F.transform(F.arrays_zip(*shifted), lambda z: F.xxhash64(z))).otherwise(nothing).alias("_h"),
        F.transform(F.filter("_lines", lambda x: x["code"] != "e"), lambda x: x["line"]).alias("_spoken"),
        F.transform(F.filter("_lines", lambda x: x["fate"] != "-"), lambda x: x["line"]).alias("_kept"),
        F.size("_lines").cast("long").alias("n_lines"))
    d = d.withColumn("_s", _repeated_words(F.col("n_words"), F.col("_h")))
    m = F.size("_s")
    gone = F.lit(None).cast("bigint")
    around = F.arrays_zip(
        F.col("_s.p").alias("p"), F.col("_s.h").alias("h"),
        F.concat(F.array(gone), F.slice(F.col("_s.h"), 1, m - 1)).alias("before"),
        F.concat(F.slice(F.col("_s.h"), 2, m - 1), F.array(gone)).alias("after"))
    starts = F.filter(around, lambda x: x["h"].eqNullSafe(x["before"]) | x["h"].eqNullSafe(x["after"]))
    d = d.withColumn("_p", F.when(F.col("_s").isNotNull(), F.sort_array(F.transform(starts, lambda x: x["p"]))))
    k = F.size("_p")
    following = F.concat(F.slice("_p", 2, k - 1), F.array(F.element_at("_p", -1) + WINDOW))
    covered = F.aggregate(F.zip_with("_p", following, lambda a, b: F.least(F.lit(WINDOW), b - a).cast("bigint")),
                          F.lit(0).cast("bigint"), lambda a, x: a + x)
    whole = F.size("_kept") == F.col("n_lines")
    text = F.when(whole, F.col("_t")).otherwise(F.array_join("_kept", "\n"))
    left = F.when(whole, F.col("word_chars")).otherwise(F.length(F.translate(text, WHITE, "")).cast("long"))
    return d.select(
        "row", "doc_id", text.alias("clean_text"), "n_words", "word_chars",
        F.regexp_count("_t", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_spoken") - F.size(F.array_distinct("_spoken"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        (F.col("n_lines") - F.size("_kept")).cast("long").alias("n_lines_removed"), left.alias("kept_chars"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_lost: float = MAX_LOST) -> DataFrame:
    """Features, ``base_failed`` and ``kept``; ``clean_text`` is the text without its failing lines."""
    f = features(docs, id_col, text_col)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    lost = (F.col("word_chars") - F.col("kept_chars")) > F.col("word_chars") * F.lit(max_lost)
    return f.withColumn("base_failed", failed).withColumn("kept", ~failed & ~lost)


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_lost: float = MAX_LOST) -> DataFrame:
    """The kept rows with all columns of ``docs`` and the text without its failing lines."""
    judged = judge(docs, id_col, text_col, max_lost)
    row = F.struct(*(F.col("clean_text").alias(c) if c == text_col else F.col("row")[c].alias(c)
                     for c in docs.columns))
    # A filter would be pushed below the columns it needs, which would then be computed for it once more.
    return judged.select(F.explode(F.when(F.col("kept"), F.array(row))).alias("row")).select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    from chronotok.llm.text import table

    return judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_lines_removed", "kept_chars")


# The same rules in DuckDB SQL, from their own lists.
ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
grams AS (
  SELECT r, i, array_to_string(ws[i:i + 7], ' ') AS g
  FROM (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)
),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM grams) WHERE c > 1),
covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY r),
measured AS (
  SELECT r, i, l, regexp_replace(regexp_replace(l, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '') AS trimmed,
         len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS n,
         regexp_matches(l, '[.!?\x{2026}\x{037E}\x{0589}\x{061F}\x{06D4}\x{0964}\x{0965}\x{104A}\x{104B}\x{1362}\x{1367}\x{17D4}\x{3002}\x{FF01}\x{FF1F}\x{FF61}]') AS mark,
         length(regexp_replace(l, '[\x20\x09-\x0D]+', '', 'g')) AS chars,
         5 * len(regexp_extract_all(l, '[#*$%&|<>]')) > n OR 5 * len(regexp_extract_all(l, '[!?]{2,}')) > n
         OR 5 * len(regexp_extract_all(l, '[|»›•·]')) > n
         OR regexp_matches(l, '(?i)^(home|menu|log ?in|log ?out|sign ?(in|up)|register|search|next|previous|back|top|share|contact( us)?|about( us)?|sitemap|skip to (main )?content|read more|click here)[ .:!]*$')
         OR regexp_matches(lower(l), 'all rights reserved|licensed under|released under the|accept (all )?cookies|uses? cookies|cookie (policy|settings)|privacy policy|terms of (use|service)|terms and conditions|enable javascript|lorem ipsum|subscribe to our|(©|\(c\)) ?[0-9]{4}|^[\x20\x09-\x0D]*(https?://|www\.)[^\x20\x09-\x0D]+[\x20\x09-\x0D]*$') AS bad
  FROM (SELECT r, unnest(ls) AS l, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT r, string_split(t, chr(10)) AS ls FROM d))
),
named AS (
  SELECT *, regexp_matches(trimmed, '[.!?\x{2026}\x{037E}\x{0589}\x{061F}\x{06D4}\x{0964}\x{0965}\x{104A}\x{104B}\x{1362}\x{1367}\x{17D4}\x{3002}\x{FF01}\x{FF1F}\x{FF61}]["''”’»」)\]]{0,3}$') AS ends, regexp_matches(trimmed, '^[\p{Ll}\p{Lo}\p{Lm}]') AS goes
  FROM measured
),
coded AS (
  SELECT *, CASE WHEN n = 0 THEN 'e' WHEN bad THEN '-' WHEN ends THEN if(goes, 'F', 'E') WHEN mark THEN if(goes, 'C', 'M')
                 WHEN n <= 3 THEN 's' WHEN n < 12 THEN if(goes, 'c', 'm') ELSE if(goes, 'd', 'D') END AS code
  FROM named
),
around AS (
  SELECT *, string_agg(code, '') OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 9 PRECEDING AND 1 PRECEDING) AS before,
         string_agg(code, '') OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 9 FOLLOWING) AS after
  FROM coded
),
judged AS (
  SELECT *, code = '-'
         OR code IN ('d', 'D') AND NOT regexp_matches(coalesce(after, ''), '^[cd]{0,8}[CF]')
            AND NOT (code = 'd' AND regexp_matches(coalesce(before, ''), '[MC][cd]{0,8}$'))
         OR code = 's' AND 1 + length(regexp_extract(coalesce(before, ''), 's*$'))
                             + length(regexp_extract(coalesce(after, ''), '^s*')) >= 4 AS fails
  FROM around
),
per AS (
  SELECT r, CAST(count(*) FILTER (n > 0) - count(DISTINCT l) FILTER (n > 0) AS BIGINT) AS n_dup_lines,
         CAST(count(*) FILTER (fails) AS BIGINT) AS n_lines_removed,
         CAST(coalesce(sum(chars) FILTER (NOT fails), 0) AS BIGINT) AS kept_chars
  FROM judged GROUP BY r
),
f AS (
  SELECT d.doc_id, CAST(len(w.ws) AS BIGINT) AS n_words, CAST(length(array_to_string(w.ws, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(d.t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, per.n_dup_lines,
         CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words, per.n_lines_removed, per.kept_chars
  FROM d JOIN w USING (r) JOIN per USING (r) LEFT JOIN covered USING (r)
),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (word_chars - kept_chars > word_chars * 0.5) AS kept, n_lines_removed, kept_chars
FROM b"""
