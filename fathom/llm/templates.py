"""Line dedup with a log-template tree.

A line's tokens that hold a digit are variable at once and become <*>. The tree has a fixed depth: the first level is the
number of tokens, the next LEADING levels the leading tokens; a path of these is a leaf. Inside a leaf, a token stays if
half of the leaf's different lines or more have it at that place, and becomes <*> if not; where a line keeps too few of its tokens,
it is a template of its own. A template that fixes fewer than half of its tokens says too little and never recurs. Leaves that
are found in fewer documents than a template must be are never looked into.

A line is dropped if its template recurs across documents. How often it does is counted in one of two ways, neither of which looks
at the lines around it, so the inner lines of a block go with the outer ones, and a refrain inside one document stays.

* `deduped`, which the query and its SQL define, counts different texts: copies of a whole document count once. Of the texts
  that have a template found in MIN_DOCUMENTS of them, those count again that have something of their own: such lines make up
  OWN_PERCENT of their characters at most. A template recurs if MIN_DOCUMENTS of these have it. So a group of
  copies that differ in places, of which nearly every line is in the others as well, makes no line recur.
* `without_boilerplate`, the pipeline's stage, counts groups of near copies (the components of near-dedup, at its threshold, over
  the texts as they come in): a template recurs if MIN_GROUPS of them have it.

Copies are left to near-dedup in both. All keys are hashes that are counted in part before they are shuffled (texts are named
by 128 bits); the text of lines moves only for busy leaves, whole texts move once, to drop the lines.

Defined results: blank lines stay; a null text stays null; a document of which nothing but boilerplate was left stays with an empty
text in `deduped`, and goes in `without_boilerplate`; rows that repeat a text are treated alike, whatever their doc_id (null too);
the order of rows and of lines decides nothing, so there are no ties; very long lines and texts are treated like all others, in time
proportional to their length; extra columns are kept (a column n_lines_dropped of docs gives way to the count in `deduped` and is kept by
`without_boilerplate`); an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm import near_copies
from fathom.llm import shared as S

LEADING = 2
#: Different texts, with something of their own, that a template is found in at least.
MIN_DOCUMENTS = 10
#: Groups of near copies that a template is found in at least, in the pipeline.
MIN_GROUPS = 10
#: A token stays if so many percent of the different lines of its leaf have it at its place (one half: two tokens can at most).
SHARE_PERCENT = 50
#: A template keeps so many percent of its tokens at least.
FIXED_PERCENT = 60
#: Lines with templates that are found often make up so many percent of a text at most, or it is a copy.
OWN_PERCENT = 50
TEXT = ["text_a", "text_b"]


def named(docs: DataFrame, *more) -> DataFrame:
    """The columns given, and two hashes that name the text."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    return docs.select(*more, F.xxhash64(text).alias("text_a"), F.xxhash64(F.lit(1), text).alias("text_b"))


def lines_of(docs: DataFrame) -> DataFrame:
    """Every line that is not blank: text, place, masked line, its size and the text's, leaf and name of the line."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    rows = named(docs, F.split(text, "\n").alias("lines"), F.length(text).alias("total"))
    each = rows.select(*TEXT, "total", F.posexplode("lines").alias("place", "x"))
    masked = F.regexp_replace(F.trim("x"), r"(?<![^ ])[^ 0-9]*+[0-9][^ ]*+", "<*>")
    out = each.select(*TEXT, "total", "place", masked.alias("masked")).filter("masked <> ''")
    tokens = F.length("masked") - F.length(F.translate("masked", " ", ""))
    leaf = F.xxhash64(tokens, F.substring_index("masked", " ", LEADING))
    return out.select(*TEXT, "place", F.length("masked").alias("size"), "total", leaf.alias("leaf"), F.xxhash64("masked").alias("line"), "masked")


def groups_of(docs: DataFrame) -> DataFrame:
    """text_a, group: the stored components of near copies that the texts are in."""
    with S.passing(docs.sparkSession):
        rows = named(docs, "text").select(F.col("text_a").alias("doc_id"), "text")  # never null, unlike ids
        found = near_copies.near_copies(rows, near_copies.STAGE_PERCENT)
        return S.stored(found.groupBy(F.col("doc_id").alias("text_a")).agg(F.min("component_id").alias("who")), "groups", keep=True)


def frequent(rows: DataFrame, key: str, who: list[str], least: int) -> DataFrame:
    """The stored values of key that `least` different `who` have at least, with their number."""
    counted = rows.select(key, *who).distinct().groupBy(key).agg(F.count("*").alias("documents"))
    return S.stored(counted.filter(F.col("documents") >= least), f"frequent-{key}")


def joined(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """An inner join of stored tables, sorted by key at every size; a hot key's rows can be split."""
    return left.hint("merge").join(right.hint("merge"), on)


def templates_of(here: DataFrame) -> DataFrame:
    """leaf, line, template, t: the stored templates of the different lines of busy leaves."""
    each = S.stored(here.groupBy("leaf", "line").agg(F.first("masked").alias("masked")), "different-lines")
    token = each.select("leaf", F.posexplode(F.split("masked", " ")).alias("at", "token"))
    share = token.groupBy("leaf", "at", F.xxhash64("token").alias("h")).agg(F.count("*").alias("n"))
    # at most two tokens of a place have half of it: the most frequent one, and the least frequent one if it has the other half
    place = share.groupBy("leaf", "at").agg(F.sum("n").alias("m"), F.max(F.struct("n", "h")).alias("hi"), F.min(F.struct("n", "h")).alias("lo")).filter("m > 1")
    fixed = lambda x: F.when(F.col(x)["n"] * 100 >= F.col("m") * SHARE_PERCENT, F.col(x)["h"])
    places = S.stored(place.groupBy("leaf").agg(F.array_sort(F.collect_list(F.struct("at", fixed("hi").alias("a"), fixed("lo").alias("b")))).alias("fixed")), "leaves")
    # a leaf with one line fixes nothing, and its line is its own template
    marked = each.hint("merge").join(places.hint("merge"), "leaf", "left").withColumn("tokens", F.split("masked", " "))
    here_fixed = lambda t, i: (F.xxhash64(t) == F.get("fixed", i)["a"]) | (F.xxhash64(t) == F.get("fixed", i)["b"])
    marked = marked.withColumn("general", F.transform("tokens", lambda t, i: F.when(here_fixed(t, i), t).otherwise(F.lit("<*>"))))
    kept = F.size(F.filter("general", lambda t: t != "<*>"))
    template = F.when(F.col("fixed").isNotNull() & (kept * 100 >= F.size("tokens") * FIXED_PERCENT), F.array_join("general", " ")).otherwise(F.col("masked"))
    out = marked.select("leaf", "line", template.alias("template"))
    says = F.size(F.filter(F.split("template", " "), lambda t: t != "<*>")) * 2 >= F.size(F.split("template", " "))
    return S.stored(out.filter(says).select("leaf", "line", "template", F.xxhash64("leaf", "template").alias("t")), "templates")


def recurring_lines(docs: DataFrame, by_groups: bool = False) -> tuple[DataFrame, DataFrame]:
    """The stored places (text_a, text_b, place, t) of all lines whose template recurs, and the templates (t, template, documents)."""
    least = MIN_GROUPS if by_groups else MIN_DOCUMENTS
    lines, who = lines_of(docs), TEXT
    if by_groups:
        lines, who = lines.join(groups_of(docs), "text_a"), ["who"]
    lines = S.stored(lines, "lines")
    here = S.stored(joined(lines, frequent(lines, "leaf", who, least).select("leaf"), ["leaf"]), "busy-lines")
    names = templates_of(here)
    found = S.stored(joined(here.drop("masked"), names.drop("template"), ["leaf", "line"]).drop("leaf", "line"), "found")
    often = frequent(found, "t", who, least)
    found = S.stored(joined(found, often.select("t"), ["t"]).select(*TEXT, "place", "t", "size", "total"), "often")
    found = S.stored(found.distinct(), "places")  # by itself: a join that is distinct at once could not split a hot key
    if not by_groups:
        own = found.groupBy(*TEXT).agg(F.sum("size").alias("size"), F.first("total").alias("total")).filter(F.col("size") * 100 <= F.col("total") * OWN_PERCENT)
        often = frequent(joined(found.select("t", *TEXT), S.stored(own.select(*TEXT), "own"), TEXT), "t", TEXT, least)
        found = S.stored(joined(found, often.select("t"), ["t"]), "dropped-lines")
    return found.select(*TEXT, "place", "t"), often.join(names.select("t", "template").distinct(), "t")


def deduped(docs: DataFrame, by_groups: bool = False) -> DataFrame:
    """docs with `text` without the lines whose template recurs; n_lines_dropped is added (and n_chars, if it is there, follows)."""
    return without(docs, recurring_lines(docs, by_groups)[0], "n_lines_dropped")


def without(docs: DataFrame, lines: DataFrame, count: str) -> DataFrame:
    """docs without these lines, and their number in a column of the given name."""
    gone = lines.groupBy(*TEXT).agg(F.array_sort(F.collect_set("place")).alias("gone"))
    before = lambda i: F.coalesce(F.get("gone", i - 1), F.lit(-1))
    flags = F.flatten(F.transform("gone", lambda p, i: F.concat(F.array_repeat(F.lit(False), p - before(i) - 1), F.array(F.lit(True)))))
    key, go, n = (S.free_name(docs, x) for x in ("fathom_text", "fathom_gone", "fathom_count"))
    gone = gone.select(F.struct(*TEXT).alias(key), flags.alias(go), F.size("gone").cast("long").alias(n))
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    rows = docs.withColumn(key, F.struct(F.xxhash64(text).alias("text_a"), F.xxhash64(F.lit(1), text).alias("text_b")))
    rows = rows.hint("merge").join(gone.hint("merge"), key, "left")
    some = F.col(go).isNotNull()
    out = {c: F.col(f"`{c}`") for c in docs.columns if c.lower() != count.lower()}
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.coalesce(F.get(go, i), F.lit(False))), "\n")
    out["text"] = F.when(some, kept).otherwise(F.col("text"))
    if "n_chars" in out:
        out["n_chars"] = F.when(some, F.length(kept).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return rows.select(*[x.alias(c) for c, x in out.items()], F.coalesce(n, F.lit(0).cast("long")).alias(count))


def without_boilerplate(docs: DataFrame) -> DataFrame:
    """The same by groups of near copies, with the columns of docs, and without documents that had text and have none now."""
    count = S.free_name(docs, "fathom_dropped")
    out = without(docs, recurring_lines(docs, by_groups=True)[0], count)
    return out.filter(~((F.col(count) > 0) & (F.trim("text") == ""))).select(*[F.col(f"`{c}`") for c in docs.columns])


#: The lines dropped, in DuckDB SQL.
ORACLE_SQL = rf"""
WITH k AS (SELECT row_number() OVER () r, text, length(text) total, string_split(text, chr(10)) ls FROM (SELECT DISTINCT coalesce(text, '') AS text FROM documents)),
l AS (SELECT r, i, total, regexp_replace(trim(ls[i], ' '), '[^ ]*[0-9][^ ]*', '<*>', 'g') m FROM k, unnest(range(1, len(ls) + 1)) u(i)),
n AS (SELECT r, i, total, m, {{'n': len(string_split(m, ' ')), 'h': array_to_string(string_split(m, ' ')[1:{LEADING}], ' ')}} leaf FROM l WHERE m <> ''),
busy AS (SELECT leaf FROM n GROUP BY leaf HAVING count(DISTINCT r) >= {MIN_DOCUMENTS}),
h AS (SELECT n.* FROM n JOIN busy USING (leaf)),
e AS (SELECT DISTINCT leaf, m FROM h),
t AS (SELECT leaf, m, i pos, string_split(m, ' ')[i] tok FROM e, unnest(range(1, len(string_split(m, ' ')) + 1)) u(i)),
c AS (SELECT leaf, pos, tok, count(*) c, max(o.m) m FROM t JOIN (SELECT leaf, count(*) m FROM e GROUP BY leaf) o USING (leaf) GROUP BY leaf, pos, tok),
g AS (SELECT t.leaf, t.m, string_agg(CASE WHEN c.c * 100 >= c.m * {SHARE_PERCENT} AND c.m > 1 THEN tok ELSE '<*>' END, ' ' ORDER BY pos) g,
  count(*) FILTER (tok <> '<*>' AND c.c * 100 >= c.m * {SHARE_PERCENT} AND c.m > 1) fixed, count(*) n FROM t JOIN c USING (leaf, pos, tok) GROUP BY t.leaf, t.m),
p AS (SELECT leaf, m, CASE WHEN fixed * 100 >= n * {FIXED_PERCENT} THEN g ELSE m END g FROM g),
o AS (SELECT h.r, h.i, h.total, length(m) size, {{'l': leaf, 'g': p.g}} q FROM h JOIN p USING (leaf, m)
  WHERE len(regexp_extract_all(' ' || replace(p.g, ' ', '  ') || ' ', ' <\*> ')) * 2 <= len(string_split(p.g, ' '))),
often AS (SELECT q FROM o GROUP BY q HAVING count(DISTINCT r) >= {MIN_DOCUMENTS}),
f AS (SELECT o.* FROM o JOIN often USING (q)),
own AS (SELECT r FROM f GROUP BY r HAVING sum(size) * 100 <= max(total) * {OWN_PERCENT}),
rec AS (SELECT q FROM f JOIN own USING (r) GROUP BY q HAVING count(DISTINCT r) >= {MIN_DOCUMENTS}),
z AS (SELECT r, i FROM f JOIN rec USING (q)),
y AS (SELECT k.r, k.text, string_agg(ls[u.i], chr(10) ORDER BY u.i) FILTER (z.i IS NULL) kept, count(z.i) n
  FROM k, unnest(range(1, len(ls) + 1)) u(i) LEFT JOIN z ON z.r = k.r AND z.i = u.i GROUP BY k.r, k.text)
SELECT documents.doc_id, CAST(n AS BIGINT) n_lines_dropped, sha256(coalesce(kept, '')) kept_sha256
FROM documents JOIN y ON coalesce(documents.text, '') = y.text
"""
