"""Match printed vendor and category texts to reference records."""

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from billweave import fixed
from billweave.functions.best_names import best_pairs
from billweave.functions.names import (
    normal_form,
    rounded_score,
    similarity,
    weighed_once,
    word_block_keys,
    words_of,
)
from billweave.functions.text import is_blank, trim_all
from billweave.operators.joins import left_join_sparse, lookup
from billweave.operators.reference import account_leaf
from billweave.session import cut_lineage

# A pair without one similar word pair scores 0.45 * Jaro-Winkler and has to reach
# 0.44995. Unequal texts differ by at least one letter or one swap, so their
# Jaro-Winkler is at most 1 - 0.2 / length: out of reach up to this length.
LONGEST_BLOCKED_NAME = 1700


def vendor_options(reference: DataFrame) -> DataFrame:
    return reference.filter((F.col("entity_kind") == "vendor") & F.col("active")).select(
        "realm_id", F.col("entity_id").alias("option_id"), F.col("name").alias("option_name"), F.col("name").alias("match_text")
    )


def category_options(reference: DataFrame) -> DataFrame:
    """Expense accounts, compared by their leaf and shown by their full path."""
    expense = F.col("account_type").isin(*fixed.EXPENSE_ACCOUNT_TYPES)
    return reference.filter((F.col("entity_kind") == "account") & F.col("active") & expense).select(
        "realm_id",
        F.col("entity_id").alias("option_id"),
        F.col("name").alias("option_name"),
        account_leaf(F.col("name")).alias("match_text"),
    )


def _normalised(df: DataFrame, text: str) -> DataFrame:
    """Adds ``norm``; folding runs on distinct texts only."""
    forms = df.select(text).distinct().withColumn("norm", normal_form(F.col(text)))
    return df.join(forms, text)


def similar_words(left: DataFrame, right: DataFrame) -> DataFrame:
    """(word, similar, weight): pairs of the two vocabularies with Jaro-Winkler of at least 0.88.

    Distinct words meet only on shared blocking keys, which lose no pair; exact
    scores are then taken on distinct word pairs.
    """
    a = left.select("word", F.explode(word_block_keys("word")).alias("_key"))
    b = right.select(F.col("word").alias("similar"), F.explode(word_block_keys("word")).alias("_key"))
    pairs = a.join(b, "_key").select("word", "similar").distinct()
    weighed = pairs.withColumn("weight", weighed_once(F.col("word"), F.col("similar")))
    return weighed.filter(F.col("weight") >= fixed.TOKEN_MATCH_FLOOR)


def near_words(names: DataFrame, soft: DataFrame) -> DataFrame:
    """realm_id, query_norm, near: for each name the option words near one of its own, with their weights."""
    pairs = names.select("realm_id", "query_norm", F.explode("q_words").alias("word")).join(soft, "word")
    return pairs.groupBy("realm_id", "query_norm").agg(F.collect_list(F.struct("word", "similar", "weight")).alias("near"))


def _with_words(names: DataFrame, side: str) -> DataFrame:
    return names.filter(F.col("norm") != "").select(
        "realm_id", F.col("norm").alias(f"{side}_norm"), words_of(F.col("norm")).alias(f"{side[0]}_words")
    )


_MEET = ["realm_id", "_block", "_part"]
_BLOCK_NAMES, _PART_NAMES = 32_768, 2_048


def _dealt(df: DataFrame, *by: str) -> DataFrame:
    """Short rows that mean long work, in a number of partitions of their own: their bytes alone would make them one task."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), *by)


def candidate_pairs(q: DataFrame, o: DataFrame, near: DataFrame) -> DataFrame:
    """(realm_id, query_norm, option_norm, score): of the pairs of distinct normal forms with a similar word those that can be in an answer.

    Parts of the queries meet blocks of the options. Of each query a block's best options stay, and all that equal the last of
    them, so an answer of ``MAX_CANDIDATES`` loses none; which pairs are scored at all follows from bounds (``best_names``).
    """
    spark = q.sparkSession
    parts = max(8 * spark.sparkContext.defaultParallelism, -(-q.count() // _PART_NAMES))
    blocks = max(1, -(-o.count() // _BLOCK_NAMES))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    of = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    asked = q.join(near, ["realm_id", "query_norm"]).withColumn("_part", of("query_norm", parts)).withColumn("_block", every(blocks))
    offered = o.withColumn("_block", of("option_norm", blocks)).withColumn("_part", every(parts))
    realm = o.schema["realm_id"].dataType.simpleString()

    def meet(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        found = best_pairs(left, right, fixed.MAX_CANDIDATES) if left.num_rows and right.num_rows else ([], [], [])
        columns = [pa.array([key[0].as_py()] * len(found[0]), key[0].type), pa.array(found[0], pa.string()), pa.array(found[1], pa.string()), pa.array(found[2], pa.float64())]
        return pa.table(columns, names=["realm_id", "query_norm", "option_norm", "score"])

    groups = [_dealt(side, *_MEET).groupBy(*_MEET) for side in (asked, offered.filter(F.col("realm_id").isNotNull()))]
    return groups[0].cogroup(groups[1]).applyInArrow(meet, f"realm_id {realm}, query_norm string, option_norm string, score double")


def _long_pairs(q: DataFrame, o: DataFrame, near: DataFrame) -> DataFrame:
    """Pairs of very long names without a similar word, which may match by letters alone.

    They then need Jaro above 0.9998, so their lengths differ by less than
    0.0556 percent: names meet in neighbouring buckets of the length's logarithm.
    """
    def bucket(c):
        return F.floor(F.log(F.length(c).cast("double")) * 1800)

    near_buckets = F.array(*[bucket("query_norm") + d for d in (-1, 0, 1)])
    asked = q.filter(F.length("query_norm") > LONGEST_BLOCKED_NAME - 2).withColumn("_bucket", F.explode(near_buckets))
    offered = o.filter(F.length("option_norm") > LONGEST_BLOCKED_NAME - 2).withColumn("_bucket", bucket("option_norm"))
    pairs = asked.join(offered, ["realm_id", "_bucket"]).join(near, ["realm_id", "query_norm"], "left")
    apart = F.coalesce(~F.exists("near", lambda p: F.array_contains(F.col("o_words"), p["similar"])), F.lit(True))
    return pairs.filter(apart).select("realm_id", "query_norm", "option_norm")


def scored_pairs(queries: DataFrame, options: DataFrame) -> DataFrame:
    """(realm_id, query_norm, option_norm, score) at or above the candidate floor; of each query those that can be among its best."""
    q, o = _with_words(queries, "query"), _with_words(options, "option")
    soft = similar_words(q.select(F.explode("q_words").alias("word")).distinct(), o.select(F.explode("o_words").alias("word")).distinct())
    near = near_words(q, soft)
    by_letters = _long_pairs(q, o, near).withColumn(
        "score", rounded_score(similarity(F.col("query_norm"), F.col("option_norm"), F.lit(0.0), fixed.CANDIDATE_FLOOR - 1e-4))
    )
    pairs = candidate_pairs(q, o, near).unionByName(by_letters)
    empties = queries.filter(F.col("norm") == "").select("realm_id", F.col("norm").alias("query_norm")).join(
        options.filter(F.col("norm") == "").select("realm_id", F.col("norm").alias("option_norm")), "realm_id"
    )
    return (
        pairs.filter(F.col("score") >= fixed.CANDIDATE_FLOOR)
        .select("realm_id", "query_norm", "option_norm", "score")
        .unionByName(empties.withColumn("score", F.lit(1.0)))
    )


def rank_candidates(queries: DataFrame, options: DataFrame) -> DataFrame:
    """Top five options per distinct query text: realm_id, query, candidate_rank, option_id, option_name, score.

    ``queries``: realm_id, query. ``options``: realm_id, option_id, option_name, match_text.
    Everything runs on distinct normal forms; each map task keeps five per query
    before the shuffle.
    """
    # both lists are read several times below: compute them once
    asked = cut_lineage(_normalised(queries.filter(~is_blank(F.col("query"))).select("realm_id", "query").distinct(), "query"))
    offered = cut_lineage(_normalised(options, "match_text"))
    pairs = scored_pairs(asked.select("realm_id", "norm").distinct(), offered.select("realm_id", "norm").distinct())
    # of options with one normal form at most five can appear in any answer
    same_form = Window.partitionBy("realm_id", "norm").orderBy("option_name", "option_id")
    leading = offered.withColumn("_n", F.row_number().over(same_form)).filter(F.col("_n") <= fixed.MAX_CANDIDATES)
    named = pairs.join(
        leading.select("realm_id", F.col("norm").alias("option_norm"), "option_id", "option_name"), ["realm_id", "option_norm"]
    )
    order = Window.partitionBy("realm_id", "query_norm").orderBy(F.desc("score"), "option_name", "option_id")
    top = named.withColumn("candidate_rank", F.row_number().over(order)).filter(
        F.col("candidate_rank") <= fixed.MAX_CANDIDATES
    )
    return asked.withColumnRenamed("norm", "query_norm").join(top, ["realm_id", "query_norm"]).select(
        "realm_id", "query", "candidate_rank", "option_id", "option_name", "score"
    )


def tier(best: Column, runner_up: Column) -> Column:
    """auto needs a near-perfect score and a clear margin; too low a best score selects nothing."""
    clear = runner_up.isNull() | (best - runner_up >= fixed.AUTO_MARGIN)
    return (
        F.when(best.isNull() | (best < fixed.SUGGEST_FLOOR), "none")
        .when((best >= fixed.AUTO_SCORE) & clear, "auto")
        .otherwise("suggested")
    )


def match_texts(queries: DataFrame, options: DataFrame) -> DataFrame:
    """realm_id, query, selected_id, selected_name, confidence, candidates (at most five structs)."""
    ranked = rank_candidates(queries, options)
    grouped = ranked.groupBy("realm_id", "query").agg(
        F.array_sort(F.collect_list(F.struct("candidate_rank", "option_id", "option_name", "score"))).alias("_c")
    )
    best, second = F.get("_c", F.lit(0)), F.get("_c", F.lit(1))
    level = tier(best["score"], second["score"])
    return grouped.select(
        "realm_id",
        "query",
        F.when(level != "none", best["option_id"]).alias("selected_id"),
        F.when(level != "none", best["option_name"]).alias("selected_name"),
        level.alias("confidence"),
        F.transform(
            "_c", lambda c: F.struct(c["option_id"].alias("id"), c["option_name"].alias("name"), c["score"].alias("score"))
        ).alias("candidates"),
    )


def match_batch(hashes: DataFrame, parsed: DataFrame, reference: DataFrame) -> DataFrame:
    """Vendor and category match per distinct document.

    ``hashes``: realm_id, file_hash. A document without a current parse gets two
    empty answers. When a realm offers neither vendors nor categories the answer
    is the error ``reference-empty``.
    """
    current = parsed.filter(F.col("schema_version") == fixed.PARSE_SCHEMA_VERSION)
    # documents and records are read for each of the two answers: compute them once
    docs = cut_lineage(
        hashes.select("realm_id", "file_hash").distinct().join(
            current.select("file_hash", "vendor", "suggested_category"), "file_hash", "left"
        )
    )
    reference = cut_lineage(reference.select("realm_id", "entity_kind", "entity_id", "name", "active", "account_type"))
    answers = docs
    for text, options, prefix in (
        ("vendor", vendor_options(reference), "vendor"),
        ("suggested_category", category_options(reference), "category"),
    ):
        matched = match_texts(docs.select("realm_id", F.col(text).alias("query")), options)
        columns = ["selected_id", "selected_name", "confidence", "candidates"]
        matched = matched.select("realm_id", F.col("query").alias(text), *[F.col(c).alias(f"{prefix}_{c}") for c in columns])
        answers = left_join_sparse(answers, matched, text, ["realm_id"]).withColumn(
            f"{prefix}_confidence", F.coalesce(f"{prefix}_confidence", F.lit("none"))
        )
    offered = (
        vendor_options(reference).select("realm_id").unionByName(category_options(reference).select("realm_id")).distinct()
    )
    return (
        lookup(answers, offered.withColumn("_offered", F.lit(True)), "realm_id")
        .withColumn("error", F.when(F.col("_offered").isNull(), "reference-empty"))
        .drop("_offered", "vendor", "suggested_category")
    )


def vendors_to_create(rows: DataFrame) -> DataFrame:
    """Rows without a vendor, with the printed name to start a new record from."""
    return rows.filter(F.col("vendor_id").isNull() | (F.col("vendor_id") == "")).select(
        "file_hash", trim_all(F.coalesce("printed_vendor", F.lit(""))).alias("display_name")
    )
