"""Exact duplicates of whole texts; frequent digests are split off and never shuffled row by row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleanworks.llm.common import WHITE_RUN, stored

#: Counters of the frequent-item summary: a digest held by more than about rows / 2,000 documents is surely among them.
COUNTERS = 4096
#: Digests that may be broadcast; 4,096 rows of 48 bytes are less than 200 kB whatever the input.
WINNERS = 4096


def normalised(text: Column) -> Column:
    """Text with each run of white space made one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE_RUN, " ")


def frequent_digests(digests: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """Digests found by a Misra-Gries summary (built into SQL as ``approx_top_k``), with exact count and smallest id.

    The summary has a fixed number of counters, is built per partition and merged. What it names is then verified by
    an exact count over all rows: only true counts of two and more are winners.
    """
    summary = digests.agg(F.expr(f"approx_top_k(hex(digest), {min(WINNERS, counters)}, {counters})").alias("top"))
    named = summary.select(F.explode("top").alias("t")).select(F.unhex("t.item").alias("digest")).limit(WINNERS)
    return (digests.join(F.broadcast(named), "digest", "left_semi")
            .groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
            .where("group_size > 1").limit(WINNERS))


def exact_duplicates(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """Per document the row that stays for its text.

    Input: ``doc_id`` and ``text``; other columns are ignored. Returns doc_id, keep_id (smallest id with an equal
    normalised text), group_size, kept, text_sha256. A null text equals the empty one. Rows with a null id are kept in
    the result and count in their group; they never stay before a row with an id. Repeated rows count each; an id
    that occurs twice with one text is kept on each of its rows (a table of documents has unique ids).
    Rows of frequent texts are answered on the map side from the broadcast winners. All other groups are small (at
    most about rows / 2,000), so the ordinary shuffle of (digest, doc_id) has no hot key.
    """
    digests = stored(docs.select("doc_id", F.unhex(F.sha2(normalised(F.col("text")), 256)).alias("digest")), "digests")
    winners = stored(frequent_digests(digests, counters).coalesce(1), "winners")
    hot = digests.join(F.broadcast(winners), "digest").select("doc_id", "digest", "keep_id", "group_size")
    same = Window.partitionBy("digest")
    rest = (digests.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
            .select("doc_id", "digest", F.min("doc_id").over(same).alias("keep_id"), F.count("*").over(same).alias("group_size")))
    return hot.unionByName(rest).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


SQL = """
    WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
    g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
    SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""
