"""Line dedup (operator 7), DataFrame functions only: overlapping windows of three lines are hashed, repeated windows are
found over all texts, and the lines of every later occurrence go.

Lines are what stands between newlines; lines without a word are no part of a window and always stay. A window is three
consecutive lines that have words. The first occurrence, by doc_id, then by the text's own hash, then by place, stays whole.
A null id comes before all others. A null text counts as empty. Rows that share doc_id and text are one document to the rule and get the same result. Texts of
fewer than three lines with words have no window and stay as they are. Extra columns of the input are not looked at."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oscine.llm import common as C

LINES = 3


def _windows(lines: F.Column, size: int) -> F.Column:
    """For each window: the places of its lines and two keys, both made from the lines' hashes of 64 bits and their lengths."""

    def one(i: F.Column) -> F.Column:
        own = [F.element_at(lines, (i + k).cast("int")) for k in range(size)]
        return F.struct(
            F.array([x["i"] for x in own]).alias("at"),
            F.xxhash64(*[x["h"] for x in own]).alias("h1"), F.xxhash64(F.lit("second"), *[x["h"] for x in reversed(own)], *[x["n"] for x in own]).alias("h2"),
        )

    return F.transform(F.sequence(F.lit(1), F.size(lines) - (size - 1)), one)


def line_dedup(docs: DataFrame, size: int = LINES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of the input: doc_id, n_lines, n_removed, kept_text."""
    # a null id comes first; the join below needs it as a value
    identity = {"known": F.col(doc_id).isNotNull(), "id": F.coalesce(F.col(doc_id), F.lit(0))}
    text = F.coalesce(F.col(text), F.lit(""))
    texts = docs.select(F.col(doc_id).alias("doc_id"), *[v.alias(k) for k, v in identity.items()], F.xxhash64(text).alias("own"), F.split(text, "\n", -1).alias("split"))
    lines = F.filter(F.transform("split", lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda s: s["x"].rlike(C.WORD_PATTERN))
    hashed = F.transform(lines, lambda s: F.struct(s["i"].alias("i"), F.xxhash64(s["x"]).alias("h"), F.length(s["x"]).alias("n")))
    windows = (
        texts.select("known", "id", "own", hashed.alias("lines")).where(F.size("lines") >= size)
        .select("known", "id", "own", F.explode(_windows(F.col("lines"), size)).alias("w"))
        .select("known", "id", "own", "w.at", "w.h1", "w.h2")
    )
    windows = C.materialize(windows, "line-windows")
    place = F.struct("known", "id", "own", "at")
    repeated = windows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = windows.join(repeated, ["h1", "h2"]).where(place > F.col("first"))
    covered = later.groupBy("known", "id", "own").agg(F.array_distinct(F.flatten(F.collect_set("at"))).alias("gone"))
    # the lines are split before the join, so that each kept one is looked up once
    stay = F.array_except(F.sequence(F.lit(0), F.size("split") - 1), "gone")
    kept = F.transform(stay, lambda i: F.element_at("split", i + 1))
    return texts.join(covered, ["known", "id", "own"], "left").select(
        "doc_id",
        F.size("split").cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
        F.concat_ws("\n", F.when(F.col("gone").isNull(), F.col("split")).otherwise(kept)).alias("kept_text"),
    )


#: Lines are split and windows compared as texts, not by hash.
ORACLE = r"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
lines AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS x, unnest(range(len(string_split(text, chr(10))))) AS i FROM texts),
wordy AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM lines WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
windows AS (SELECT a.doc_id, a.k, a.i AS i1, b.i AS i2, c.i AS i3, a.x AS x1, b.x AS x2, c.x AS x3
  FROM wordy a JOIN wordy b ON b.doc_id = a.doc_id AND b.k = a.k + 1 JOIN wordy c ON c.doc_id = a.doc_id AND c.k = a.k + 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY x1, x2, x3 ORDER BY doc_id, k) AS r FROM windows),
gone AS (SELECT DISTINCT doc_id, unnest([i1, i2, i3]) AS i FROM ranked WHERE r > 1),
kept AS (SELECT l.doc_id, string_agg(l.x, chr(10) ORDER BY l.i) AS kept_text, count(*) AS n FROM lines l ANTI JOIN gone g ON g.doc_id = l.doc_id AND g.i = l.i GROUP BY 1),
total AS (SELECT doc_id, count(*) AS n FROM lines GROUP BY 1)
SELECT t.doc_id, t.n AS n_lines, t.n - coalesce(k.n, 0) AS n_removed, md5(coalesce(k.kept_text, '')) AS kept_md5
FROM total t LEFT JOIN kept k USING (doc_id)
"""
