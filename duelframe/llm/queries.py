"""Registered queries of the llm operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from duelframe.llm import leaks, names, ranking, softlogic, spans, tokenizer
from duelframe.runtime import checkpoint, read_table


def _registry(spark: SparkSession, folder: str) -> DataFrame:
    """Full names and their rows: the contests' fighters and the bets' blue side, which is spelled as those."""
    contests, bets = read_table(spark, folder, "combined_data"), read_table(spark, folder, "betting_cumulative_profit")
    sides = [names.spellings(contests, "red_fighter_name"), names.spellings(contests, "blue_fighter_name"), names.spellings(bets, "blue_fighter_name")]
    return sides[0].unionByName(sides[1]).unionByName(sides[2]).groupBy("name").agg(F.sum("n").alias("n"))


def _typed(spark: SparkSession, folder: str) -> DataFrame:
    profiles, bets = read_table(spark, folder, "entities_raw"), read_table(spark, folder, "betting_cumulative_profit")
    both = names.spellings(profiles, "fighter_name").unionByName(names.spellings(bets, "red_fighter_name"))
    return both.groupBy("name").agg(F.sum("n").alias("n"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return names.spelling_pairs(names.link_spellings(_typed(spark, folder), _registry(spark, folder)))


def p4_groups(spark: SparkSession, folder: str) -> DataFrame:
    """One row per spelling with its group and the number of other spellings it is linked to."""
    linked = names.link_spellings(_typed(spark, folder), _registry(spark, folder))
    sizes = linked.groupBy("entity").agg((F.count("*") - 1).alias("n_links"))
    return linked.join(sizes, "entity").select("name", F.col("entity").alias("group_id"), F.col("display").alias("person"), "n_links")


#: Fewest decided bets of a fighter in p2_found, and how many fighters it names.
LEAST_BETS, STRONGEST = 20, 6


def p2_ranking(spark: SparkSession, folder: str) -> DataFrame:
    """One row per fighter with decided bets: record, strength, standard error and position."""
    bets = read_table(spark, folder, "betting_cumulative_profit").select("bet_id", "red_fighter_name", "blue_fighter_name", "fight_outcome").distinct()
    typed = names.spellings(bets, "red_fighter_name").unionByName(names.spellings(bets, "blue_fighter_name")).groupBy("name").agg(F.sum("n").alias("n"))
    linked = names.link_spellings(typed, _registry(spark, folder))
    red, blue = (linked.select(F.col("name").alias(f"{side}_fighter_name"), F.struct("entity", "display").alias(side)) for side in ("red", "blue"))
    rows = bets.withColumn("won", F.lower(F.trim("fight_outcome"))).where(F.col("won").isin("red_win", "blue_win"))
    sides = rows.join(red, "red_fighter_name").join(blue, "blue_fighter_name")
    first = F.col("won") == "red_win"
    decided = sides.select(F.when(first, F.col("red")).otherwise(F.col("blue")).alias("winner"), F.when(first, F.col("blue")).otherwise(F.col("red")).alias("loser"))
    ranked = ranking.rank_items(decided)
    return ranked.select(F.col("item.display").alias("fighter_name"), F.col("item.entity").alias("fighter_key"), "n_won", "n_lost", "strength", "std_error", "position")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    ranked = p2_ranking(spark, folder).where(F.col("n_won") + F.col("n_lost") >= LEAST_BETS)
    return ranked.orderBy("position").limit(STRONGEST).select("fighter_name")


def p6_links(spark: SparkSession, folder: str) -> DataFrame:
    day = F.unix_date(F.col("event_date").cast("date"))
    bets = read_table(spark, folder, "betting_cumulative_profit").select("bet_id", day.alias("day"), F.col("red_fighter_name").alias("red"), F.col("blue_fighter_name").alias("blue"), F.lower("selected_side").alias("side"), softlogic.decimal_odds(F.col("selected_decimal_odds")).alias("odds")).distinct()
    quotes = read_table(spark, folder, "quotes_raw").select("quote_id", day.alias("day"), F.col("fighter_1").alias("first"), F.col("fighter_2").alias("second"), softlogic.decimal_odds(F.col("fighter_1_odds")).alias("odds_1"), softlogic.decimal_odds(F.col("fighter_2_odds")).alias("odds_2")).distinct()
    bets, quotes = checkpoint(bets), checkpoint(quotes)  # each is read several times
    written = [names.spellings(bets, "red"), names.spellings(bets, "blue"), names.spellings(quotes, "first"), names.spellings(quotes, "second")]
    typed = written[0].unionByName(written[1]).unionByName(written[2]).unionByName(written[3]).groupBy("name").agg(F.sum("n").alias("n"))
    people = names.possible_people(typed, _registry(spark, folder))
    return softlogic.link(bets, quotes, people)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return p6_links(spark, folder).select("bet_id", "quote_id")


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokenizer.encode_corpus(read_table(spark, folder, "documents"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.find_leaks(read_table(spark, folder, "documents"), read_table(spark, folder, "eval_items")).select("doc_id", "item_id")


def p8_leaks(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.find_leaks(read_table(spark, folder, "documents"), read_table(spark, folder, "eval_items"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return spans.shared_span_pairs(read_table(spark, folder, "documents"))


def p9_shared(spark: SparkSession, folder: str) -> DataFrame:
    return spans.shared_share(read_table(spark, folder, "documents"))


def p9_fuzzy(spark: SparkSession, folder: str) -> DataFrame:
    return spans.fuzzy_passages(read_table(spark, folder, "documents"))


QUERIES = {"p2_found": p2_found, "p2_ranking": p2_ranking, "p4_found": p4_found, "p4_groups": p4_groups, "p6_found": p6_found, "p6_links": p6_links, "p7_ids": p7_ids, "p8_found": p8_found, "p8_leaks": p8_leaks, "p9_found": p9_found, "p9_shared": p9_shared, "p9_fuzzy": p9_fuzzy}

_WORDS = r"regexp_extract_all(lower(strip_accents(text)), '[\p{L}\p{N}]+') AS w"
_GRAMS = "unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k:k + 11], ' '))) AS g"
P8_SQL = f"""
WITH d AS (SELECT DISTINCT doc_id, {_WORDS} FROM documents WHERE text IS NOT NULL), i AS (SELECT DISTINCT item_id, {_WORDS} FROM eval_items WHERE text IS NOT NULL),
dg AS (SELECT doc_id, {_GRAMS} FROM d WHERE len(w) >= 12), ig AS (SELECT item_id, {_GRAMS} FROM i WHERE len(w) >= 12)
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)
"""
P9_SQL = """
WITH d AS (SELECT DISTINCT doc_id, text FROM documents WHERE length(text) >= 300),
g AS (SELECT doc_id, unnest(list_transform(range(1, length(text) - 298), lambda k: hash(substr(text, k, 300)))) AS h FROM d),
s AS (SELECT DISTINCT doc_id, h FROM g), m AS (SELECT h FROM s GROUP BY h HAVING count(*) > 1), k AS (SELECT s.* FROM s SEMI JOIN m USING (h))
SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM k a JOIN k b ON a.h = b.h AND a.doc_id < b.doc_id
"""
P9_SHARED_SQL = """
WITH d AS (SELECT DISTINCT doc_id, text, length(text) AS n FROM documents WHERE length(text) >= 300), t AS (SELECT doc_id, n, min(doc_id) OVER (PARTITION BY text) AS tid, count(*) OVER (PARTITION BY text) - 1 AS n_copies FROM d),
g AS (SELECT doc_id, unnest(range(1, n - 298)) AS k, unnest(list_transform(range(1, n - 298), lambda k: hash(substr(text, k, 300)))) AS h FROM d),
s AS (SELECT DISTINCT doc_id, h FROM g), m AS (SELECT h FROM s GROUP BY h HAVING count(*) > 1), w AS (SELECT doc_id, k, lead(k) OVER (PARTITION BY doc_id ORDER BY k) AS following FROM g SEMI JOIN m USING (h)),
c AS (SELECT doc_id, sum(least(300, coalesce(following - k, 300)))::BIGINT AS shared_chars FROM w GROUP BY doc_id),
o AS (SELECT DISTINCT x.doc_id, y.h FROM s y SEMI JOIN m USING (h) JOIN t x ON x.doc_id = y.doc_id),
p AS (SELECT a.doc_id, count(DISTINCT tb.tid) AS n_texts FROM o a JOIN o b ON a.h = b.h AND a.doc_id <> b.doc_id JOIN t ta ON ta.doc_id = a.doc_id JOIN t tb ON tb.doc_id = b.doc_id AND tb.tid <> ta.tid GROUP BY a.doc_id)
SELECT c.doc_id, n AS n_chars, shared_chars, shared_chars / n AS shared_share, coalesce(n_texts, 0) AS n_texts, n_copies FROM c JOIN t USING (doc_id) LEFT JOIN p USING (doc_id)
"""
ORACLES = {"p8_found": P8_SQL, "p9_found": P9_SQL, "p9_shared": P9_SHARED_SQL}
