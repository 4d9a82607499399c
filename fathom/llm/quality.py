"""Line-first cleaning, in DataFrame functions only.

Each line is judged by itself: navigation bars (three separators or more, and one for every four words), symbol litter (a
symbol for every two words), shouting (30 letters or more, 70 % of them capitals, and an exclamation mark for every two
words), and in lines of at most SHORT_WORDS words: boilerplate phrases, a broken end (an ellipsis), and without a mark that ends a
sentence also stubs of at most STUB_WORDS words, list items of at most ITEM_WORDS words and menus (nothing but words of navigation). Lines that fail are removed, and a document that loses more than
half of its words is rejected. Base rules come first: 20 words at least, and not more than 30 % of the words in 8-word
windows that the text repeats.

Everything is computed within the row, so nothing is shuffled. Defined results: a null text has no words, no lines that
count, and fails the base; a very long text is one row like all others; repeated rows are judged alike; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 8
MIN_WORDS = 20
REPEATED_PERCENT = 30
LOST_PERCENT = 50
SYMBOLS = "#*$%&|<>"
SPACE_CLASS = r"[ \t\n\x0B\f\r]+"
#: Phrases that mark boilerplate in a line of at most BOILERPLATE_WORDS words.
BOILERPLATE = (
    "all rights reserved|privacy policy|cookie policy|terms of service|terms of use|terms and conditions|enable javascript|"
    "javascript is disabled|uses cookies|use cookies|click here|read more|sign in|log in|sign up|subscribe to|share this|"
    "skip to content|powered by|lorem ipsum"
)
SHORT_WORDS, ITEM_WORDS, STUB_WORDS = 12, 5, 2
#: Words of menus.
MENU = "home|about|about us|contact|contact us|news|blog|shop|search|login|register|help|faq|sitemap|menu|archive|accueil|recherche|startseite|kontakt|impressum|inicio|contacto|buscar"
#: Characters that list items begin with, and marks that end a sentence, a heading or a quotation.
BULLETS, ENDS = "•‣▪▸·*–-", r"[.!?…:;,\")\]”»«’。！？]"


def count_of(text: Column, chars: str) -> Column:
    """How many of these characters; texts without any are passed over by a search for the first."""
    counted = F.length(text) - F.length(F.translate(text, chars, ""))
    found = F.contains(text, F.lit(chars[0])) if len(chars) == 1 else text.rlike("[" + chars + "]")
    return F.when(found, counted).otherwise(0).cast("long")


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE_CLASS), "")


def n_words(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def failed_line(line: Column) -> Column:
    """Does a line fail one of the line rules? Cheap tests come first; most lines are not looked at any further."""
    words = n_words(line)
    symbols, marks = count_of(line, SYMBOLS), count_of(line, "!")
    bars = count_of(line, "|›") + F.greatest(count_of(line, "»") - count_of(line, "«"), F.lit(0).cast("long"))  # quotations have both
    capitals = F.length(line) - F.length(F.regexp_replace(line, r"\p{Lu}", ""))
    letters = F.length(line) - F.length(F.regexp_replace(line, r"\p{L}", ""))
    navigation = (bars >= 3) & (bars * 4 >= words)
    litter = (symbols >= 3) & (symbols * 2 >= words)
    shouting = (marks >= 3) & (marks * 2 >= words) & (letters >= 30) & (capitals * 10 >= letters * 7)
    space, word = r"[ \t\n\x0B\f\r]", r"[^ \t\n\x0B\f\r]"
    longer = lambda n: line.rlike(f"^{space}*+(?:{word}++{space}++){{{n}}}{word}")
    small = F.lower(line)
    menu = small.rlike(f"^[^a-z]*(?:(?:{MENU})(?:[^a-z]+|\\z))+\\z")
    item = line.rlike(f"^{space}*+[{BULLETS}]{space}") & ~longer(ITEM_WORDS)
    stub = line.rlike(word) & ~longer(STUB_WORDS)
    open_end = ~line.rlike(f"{ENDS}{space}*+\\z")
    short = small.rlike(BOILERPLATE) | line.rlike(rf"(?:\.\.\.|…){space}*+\z") | (open_end & (stub | item | menu))
    return navigation | litter | shouting | (~longer(SHORT_WORDS) & short)


def repeated_words(hashes: Column) -> Column:
    """How many words windows cover that occur twice or more; hashes: one for each window, in order."""
    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    following = F.slice(pairs, 2, F.greatest(F.size(pairs) - 1, F.lit(1)))
    equal = F.zip_with(pairs, following, lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False)))  # with the next; the last has none
    before = F.concat(F.array(F.lit(False)), equal)
    marked = F.zip_with(pairs, F.zip_with(equal, before, lambda a, b: F.coalesce(a, F.lit(False)) | b), lambda p, m: F.when(m & p["i"].isNotNull(), p["i"]))
    places = F.sort_array(F.array_compact(marked))
    steps = F.zip_with(places, F.slice(places, 2, F.greatest(F.size(places), F.lit(1))), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda total, x: total + x)


def judged(docs: DataFrame) -> DataFrame:
    """For each row of docs: doc_id, the base figures, base_failed, n_lines_removed, n_words_lost, clean (the text that is left), kept."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    out = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text.alias("text"))
    out = out.select("doc_id", "text", words_of(F.col("text")).alias("words"), F.split("text", "\n").alias("lines"))
    out = out.select("doc_id", "text", "lines", F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"), F.when(F.size("words") >= WINDOW, F.transform(F.sequence(F.lit(1), F.size("words") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("words", i, WINDOW)))).alias("hashes"))
    out = out.withColumn("bad", F.filter("lines", failed_line))
    worded = F.filter("lines", lambda x: x.rlike(r"[^ \t\n\x0B\f\r]"))
    figures = out.select(
        "doc_id",
        "n_words",
        "word_chars",
        count_of(F.col("text"), SYMBOLS).alias("n_symbols"),
        (F.size(worded) - F.size(F.array_distinct(worded))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), repeated_words(F.col("hashes"))).otherwise(F.lit(0).cast("long")).alias("n_repeat_words"),
        F.size("bad").cast("long").alias("n_lines_removed"),
        F.aggregate("bad", F.lit(0).cast("long"), lambda total, x: total + n_words(x)).alias("n_words_lost"),
        F.array_join(F.filter("lines", lambda x: ~failed_line(x)), "\n").alias("clean"),
    )
    base = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * REPEATED_PERCENT)
    return figures.withColumn("base_failed", base).withColumn("kept", ~base & (F.col("n_words_lost") * 100 <= F.col("n_words") * LOST_PERCENT))


#: The same in DuckDB SQL.
ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () r, doc_id, coalesce(text, '') t FROM documents),
w AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') ws FROM d),
g AS (SELECT r, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') k FROM w, unnest(range(1, greatest(len(ws) - {WINDOW - 2}, 1))) u(i)),
rep AS (SELECT r, unnest(range(i, i + {WINDOW})) p FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) c FROM g) WHERE c > 1),
rw AS (SELECT r, count(DISTINCT p) n FROM rep GROUP BY r),
l AS (SELECT r, unnest(string_split(t, chr(10))) x FROM d),
f AS (SELECT r, x, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) n, length(x) - length(translate(x, '|›', '')) + greatest(length(translate(x, '«', '')) - length(translate(x, '»', '')), 0) bars,
  length(x) - length(translate(x, '{SYMBOLS}', '')) syms, length(x) - length(translate(x, '!', '')) marks,
  length(x) - length(regexp_replace(x, '\p{{Lu}}', '', 'g')) caps, length(x) - length(regexp_replace(x, '\p{{L}}', '', 'g')) letters FROM l),
s AS (SELECT r, coalesce(sum(n) FILTER ((bars >= 3 AND bars * 4 >= n) OR (syms >= 3 AND syms * 2 >= n)
    OR (marks >= 3 AND marks * 2 >= n AND letters >= 30 AND caps * 10 >= letters * 7)
    OR (n <= {SHORT_WORDS} AND (regexp_matches(lower(x), '{BOILERPLATE}') OR regexp_matches(x, '(?:\.\.\.|…)[\x20\x09-\x0D]*\z')
      OR (NOT regexp_matches(x, '{ENDS}[\x20\x09-\x0D]*\z') AND (n BETWEEN 1 AND {STUB_WORDS}
        OR (n <= {ITEM_WORDS} AND regexp_matches(x, '^[\x20\x09-\x0D]*[{BULLETS}][\x20\x09-\x0D]'))
        OR regexp_matches(lower(x), '^[^a-z]*(?:(?:{MENU})(?:[^a-z]+|\z))+\z')))))), 0) lost,
  count(*) FILTER (n > 0) - count(DISTINCT x) FILTER (n > 0) dup FROM f GROUP BY r),
a AS (SELECT doc_id, CAST(len(ws) AS BIGINT) n_words,
  CAST(length(translate(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS BIGINT) word_chars,
  CAST(length(t) - length(translate(t, '{SYMBOLS}', '')) AS BIGINT) n_symbols, CAST(dup AS BIGINT) n_dup_lines,
  CAST(coalesce(rw.n, 0) AS BIGINT) n_repeat_words, lost FROM d JOIN w USING (r) JOIN s USING (r) LEFT JOIN rw USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < {MIN_WORDS} OR n_repeat_words * 100 > n_words * {REPEATED_PERCENT}) base_failed,
  NOT (n_words < {MIN_WORDS} OR n_repeat_words * 100 > n_words * {REPEATED_PERCENT}) AND lost * 100 <= n_words * {LOST_PERCENT} kept FROM a
"""
