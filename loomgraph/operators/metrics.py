"""Evaluation of rankings and of multiple-choice answers, and where misses come from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.functions.text import terms


def ranking_metrics(ranking: DataFrame, gold: DataFrame) -> DataFrame:
    """ranking(q, id, rank from 1), gold(q, id): recall@20, recall@100, hit@1, hit@5 and reciprocal rank per query.

    A query without gold is left out, one without ranking has zeros.
    """
    g = gold.select("q", "id").distinct().join(ranking.select("q", "id", "rank"), ["q", "id"], "left")
    share = lambda n: F.round(F.count_if(F.col("rank") <= n) / F.count(F.lit(1)), 6)
    hit = lambda n: F.coalesce(F.min("rank") <= n, F.lit(False)).cast("double")
    return g.groupBy("q").agg(share(20).alias("recall_20"), share(100).alias("recall_100"), hit(1).alias("hit_1"), hit(5).alias("hit_5"), F.round(F.coalesce(1 / F.min("rank"), F.lit(0.0)), 6).alias("mrr"))


def summary(per_query: DataFrame) -> DataFrame:
    names = ["recall_20", "recall_100", "hit_1", "hit_5", "mrr"]
    return per_query.agg(F.count(F.lit(1)).alias("queries"), *[F.round(F.avg(n), 6).alias(n) for n in names])


def gold_ranks(ranking: DataFrame, gold: DataFrame) -> DataFrame:
    """(q, id, rank, score) of each retrieved gold."""
    return gold.select("q", "id").distinct().join(ranking.select("q", "id", "rank", "score"), ["q", "id"])


def miss_kind(r20: Column, r100: Column) -> Column:
    """RANKING if all gold is within 100, MIXED if more than within 20, GENERATION otherwise; null without a miss."""
    return F.when(r20 >= 1, None).when(r100 >= 0.999, "RANKING").when(r100 > r20 + 1e-9, "MIXED").otherwise("GENERATION")


def attribution(gold: DataFrame, retrieved: DataFrame, nodes: DataFrame, reached: DataFrame) -> DataFrame:
    """gold(q, id): NOT_INGESTED (no node), RANKING (retrieved), ORPHANED (no path from the seeds) or UNREACHABLE (a path, not retrieved).

    ``retrieved`` and ``reached`` are (q, id); ``nodes`` has id.
    """
    flag = lambda df, name, keys: df.select(*keys).distinct().withColumn(name, F.lit(True))
    j = gold.select("q", "id").distinct().join(flag(nodes, "node", ["id"]), "id", "left").join(flag(retrieved, "got", ["q", "id"]), ["q", "id"], "left").join(flag(reached, "near", ["q", "id"]), ["q", "id"], "left")
    return j.select("q", "id", F.when(F.col("node").isNull(), "NOT_INGESTED").when(F.col("got"), "RANKING").when(F.col("near"), "UNREACHABLE").otherwise("ORPHANED").alias("bucket"))


def overlap_answers(items: DataFrame) -> DataFrame:
    """items(q, context, choices, answer_idx): the stub answerer's choice, the one with most terms in the context.

    The first wins a tie; an empty context answers nothing, which is wrong. Gives q, chosen, correct.
    """
    ctx = terms(F.coalesce(F.col("context"), F.lit("")))
    score = F.transform("choices", lambda c: F.size(F.array_intersect(F.array_distinct(terms(F.coalesce(c, F.lit("")))), F.col("ctx"))))
    s = items.withColumn("ctx", ctx).withColumn("s", score)
    chosen = F.when((F.size("ctx") > 0) & (F.size("s") > 0), F.array_position("s", F.array_max("s")).cast("int") - 1)
    return s.select("q", chosen.alias("chosen"), F.coalesce(chosen == F.col("answer_idx"), F.lit(False)).alias("correct"))


def adjusted_accuracy(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows(correct, closedbook): open-book rate, closed-book rate and their difference per group."""
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("items"), F.round(F.avg(F.col("correct").cast("int")), 6).alias("open"), F.round(F.avg(F.col("closedbook").cast("int")), 6).alias("closed"), F.round(F.avg(F.col("correct").cast("int") - F.col("closedbook").cast("int")), 6).alias("adjusted")
    )


def all_in_context(rows: DataFrame) -> DataFrame:
    """rows(q, context, needles): whether every needle stands in the context, whatever the case; no needles never hit."""
    hit = F.forall("needles", lambda n: F.lower("context").contains(F.lower(n))) & (F.size("needles") > 0)
    return rows.select("q", F.coalesce(hit, F.lit(False)).alias("hit"))


def reflection(ranking: DataFrame, gold: DataFrame, most: int = 5) -> DataFrame:
    """What to look at in each query that misses gold within 20: (q, missed, wrong, ranks), up to ``most`` of each.

    ``missed`` are gold ids beyond 20 or not retrieved, by id; ``wrong`` the first retrieved ids that are no gold, by rank; ``ranks``
    the places of retrieved gold.
    """
    g = gold.select("q", "id").distinct().withColumn("gold", F.lit(True))
    j = g.join(ranking.select("q", "id", "rank"), ["q", "id"], "full")
    late = F.col("gold") & (F.coalesce("rank", F.lit(10**9)) > 20)
    bad = F.col("gold").isNull() & (F.col("rank") <= 20)
    few = lambda c: F.slice(F.sort_array(F.collect_list(c)), 1, most)
    per = j.groupBy("q").agg(few(F.when(late, F.col("id"))).alias("missed"), few(F.when(bad, F.struct("rank", "id"))).alias("w"), few(F.when(F.col("gold"), F.col("rank"))).alias("ranks"))
    return per.where("size(missed) > 0").select("q", "missed", F.transform("w", lambda x: x["id"]).alias("wrong"), "ranks")


def worst_first(per: DataFrame, n: int, wins: int = 3) -> DataFrame:
    """per(q, recall_20, hit_1, mrr): (kind, place, q), ``n`` failures to look at, half and half, and some successes.

    Missed (recall below 1) by recall and reciprocal rank, n less half; misranked (found, but not first) by reciprocal rank, half of n;
    ``wins`` of the rest by q. Ties go by q.
    """
    kind = F.when(F.col("recall_20") < 1, "missed").when(F.col("hit_1") < 1, "misranked").otherwise("won")
    first = F.when(F.col("kind") == "missed", F.col("recall_20")).otherwise(F.lit(0.0))
    then = F.when(F.col("kind") == "won", F.lit(0.0)).otherwise(F.col("mrr"))
    most = F.when(F.col("kind") == "missed", n - n // 2).when(F.col("kind") == "misranked", n // 2).otherwise(wins)
    w = Window.partitionBy("kind").orderBy("a", "b", "q")
    rows = per.withColumn("kind", kind).withColumns({"a": first, "b": then}).withColumn("place", F.row_number().over(w))
    return rows.where("place <= " + str(max(n, wins))).where(F.col("place") <= most).select("kind", "place", "q")


def checked_predictions(rows: DataFrame) -> DataFrame:
    """rows(q, id, score), as text: (q, id, score, error); an id must be a whole number, a score a finite number."""
    i, x = F.col("id").try_cast("bigint"), F.col("score").try_cast("double")
    bad = F.when(i.isNull(), "id").when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), "score")
    return rows.select("q", i.alias("id"), x.alias("score"), bad.alias("error"))


def reattached(asked: DataFrame, results: DataFrame) -> DataFrame:
    """asked(q, text), results(text, ...), one row per text: every question with its text's result; ``error`` where there is none."""
    return asked.join(results.withColumn("_got", F.lit(True)), "text", "left").withColumn("error", F.col("_got").isNull()).drop("_got")
