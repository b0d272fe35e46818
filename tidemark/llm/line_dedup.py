"""Operator 5, line dedup: explode normalised lines, hash, count distinct documents per hash, drop, reassemble.

A line's normal form is lower case with runs of ASCII white space as one space and none at the ends. Lines are
divided at ``\\n``. Documents with one and the same text count as one document, so that a page copied whole isn't taken
for boilerplate. Lines without visible characters are never counted or dropped.

Plan: one shuffle of (line hash, text key) for the counts, an inner join of the lines with the few over the threshold,
and one join of the documents with the positions that go from those that lose a line. Blank lines and texts without
lines have no part in these. Hashes, never lines, are shuffled; the text itself moves once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import content_key, written

MAX_DOCS = 10


def normal_line(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(line, r"[\t\n\x0B\f\r\x1C-\x20]+", " ")))


def _lines(docs: DataFrame, text: str) -> DataFrame:
    """(k, pos, h): text key, position and hash of each line; h is null for a blank line."""

    def one(line: Column) -> Column:
        normal = normal_line(line)
        return F.when(normal != "", F.xxhash64(normal))

    # the key has a projection of its own, below the explosion, so that a text is hashed once and not once for each line
    keyed = docs.select(content_key(F.col(text)).alias("k"), F.transform(F.split(F.col(text), "\n"), one).alias("hs"))
    return keyed.select("k", F.posexplode("hs").alias("pos", "h"))


def line_dedup(docs: DataFrame, text: str = "text", max_docs: int = MAX_DOCS) -> DataFrame:
    """``docs`` with every line removed that stands in more than ``max_docs`` distinct documents.

    All rows and columns stay, in any order; only ``text`` changes. A document that loses all its lines has an empty
    text. A null text stays null, an empty one empty; repeated rows are treated alike; a line that stands in just
    ``max_docs`` documents stays; texts of any length and number of lines are read whole; an empty table gives an empty
    table; columns of any name pass through, as rows travel in one struct.
    """
    if max_docs < 1:
        raise ValueError("max_docs must be at least 1")
    bare = docs.select(F.col(text).alias("t")).where("t IS NOT NULL")
    lines = written(_lines(bare, "t").where("h IS NOT NULL"), "lines")  # read twice, normalised and hashed once
    hot = lines.groupBy("h").agg(F.count_distinct("k").alias("n")).where(F.col("n") > max_docs).select("h")
    gone = lines.join(hot, "h").groupBy("k").agg(F.sort_array(F.collect_set("pos")).alias("at"))
    # true at each position that goes, up to the last of them; every text's flags in time linear in its lines
    before = F.concat(F.array(F.lit(-1)), F.slice("at", F.lit(1), F.size("at") - 1))
    flags = F.flatten(F.zip_with("at", before, lambda p, q: F.concat(F.array_repeat(F.lit(False), p - q - 1), F.array(F.lit(True)))))
    masks = gone.select("k", flags.alias("mask"))
    none = F.struct(F.monotonically_increasing_id().alias("x"), F.lit(0).alias("m"), F.lit(-1).alias("n"))  # spread, and equal to no text's key
    rows = docs.select(F.struct("*").alias("r"), F.when(F.col(text) != "", content_key(F.col(text))).otherwise(none).alias("k"))
    left = F.array_join(F.filter(F.split(F.col("r")[text], "\n"), lambda x, i: ~F.coalesce(F.get("mask", i), F.lit(False))), "\n")
    joined = rows.join(masks, "k", "left")
    new = F.when(F.col("mask").isNull(), F.col("r")[text]).otherwise(left)
    return joined.select(*[new.alias(c) if c == text else F.col("r")[c].alias(c) for c in docs.columns])


SQL = """
WITH d AS (SELECT doc_id, lang, source, text FROM documents),
u AS (SELECT DISTINCT text FROM d WHERE text IS NOT NULL),
lines AS (
  SELECT text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM u),
normal AS (
  SELECT text, pos, line, lower(trim(regexp_replace(line, '[\\x{9}-\\x{d}\\x{1c}-\\x{20}]+', ' ', 'g'))) AS n FROM lines),
hot AS (SELECT n FROM normal WHERE n <> '' GROUP BY n HAVING count(DISTINCT text) > 10),
kept AS (
  SELECT text, string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE n NOT IN (SELECT n FROM hot)) AS new
  FROM normal GROUP BY text)
SELECT d.doc_id, d.lang, d.source, CASE WHEN d.text IS NOT NULL THEN coalesce(kept.new, '') END AS text,
  CAST(length(CASE WHEN d.text IS NOT NULL THEN coalesce(kept.new, '') END) AS BIGINT) AS n_chars
FROM d LEFT JOIN kept ON d.text = kept.text
"""
