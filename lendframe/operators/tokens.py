"""Token ids: a vocabulary fitted over a corpus, and fixed-length id windows.

Ids are numbered by falling count, ties by token; ``PAD`` fills a short
window and ``UNKNOWN`` stands for a token the vocabulary lacks.  Counts combine
before their shuffle, the numbering is range-partitioned, and nothing goes
through the driver.

Looking ids up: the ``FREQUENT`` most common tokens (a table of fixed size) are
broadcast, so no row of a hot token is ever shuffled by token; the others, each
at most a ``FREQUENT``-th of all tokens, meet the rest of the vocabulary in a shuffle join.
Tokens carry their position, so a row's ids come back in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendframe.operators.rank import with_global_index

PAD = 0
UNKNOWN = 1
RESERVED = 2
#: Tokens whose ids are looked up by broadcast.
FREQUENT = 4096


def fit_vocabulary(rows: DataFrame, token_cols, min_count: int = 1, max_size: int | None = None,
                   num_partitions: int | None = None) -> DataFrame:
    """(token_id, token, n) over the token arrays of all rows, ids from
    ``RESERVED`` on.  ``min_count`` and ``max_size`` leave out rare tokens (they
    become ``UNKNOWN``).  Null arrays and null tokens count for nothing."""
    each = rows.select(F.explode(F.concat(*[F.coalesce(F.col(c), F.array().cast("array<string>")) for c in token_cols])).alias("token"))
    counted = each.where(F.col("token").isNotNull()).groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)
    ranked = with_global_index(counted, [F.col("n").desc(), F.col("token")], "_idx", num_partitions)
    out = ranked.select((F.col("_idx") + RESERVED).alias("token_id"), "token", "n")
    return out.where(F.col("token_id") < RESERVED + max_size) if max_size is not None else out


def token_ids(rows: DataFrame, key_cols, token_col: str, vocabulary: DataFrame, max_len: int,
              frequent: int = FREQUENT) -> DataFrame:
    """(*key_cols, input_ids, attention_mask): the ids of the first ``max_len``
    tokens, padded to ``max_len``, and 1 for a token, 0 for padding.

    ``key_cols`` name a row; rows that share a key must not occur.  A null or empty array
    is all padding; a null token is ``UNKNOWN``."""
    keys = list(key_cols)
    each = rows.select(*keys, F.posexplode_outer(F.slice(F.col(token_col), 1, max_len)).alias("_pos", "_token"))
    words = vocabulary.select(F.col("token").alias("_token"), F.col("token_id").alias("_id"))
    # at most ``frequent`` rows
    common = F.broadcast(words.where(F.col("_id") < RESERVED + frequent))
    rare = words.where(F.col("_id") >= RESERVED + frequent)
    near = each.join(common, "_token", "left")
    known = near.where(F.col("_id").isNotNull())
    other = near.where(F.col("_id").isNull() & F.col("_token").isNotNull()).drop("_id").join(rare, "_token", "left")
    without = near.where(F.col("_token").isNull())
    found = known.unionByName(other).unionByName(without)
    placed = F.when(F.col("_pos").isNotNull(), F.struct("_pos", F.coalesce("_id", F.lit(UNKNOWN)).cast("bigint").alias("_id")))
    ids = found.groupBy(*keys).agg(F.sort_array(F.collect_list(placed)).alias("_placed"))
    n = F.size("_placed")
    return ids.select(
        *keys,
        F.concat(F.transform("_placed", lambda p: p["_id"]), F.array_repeat(F.lit(PAD).cast("bigint"), F.lit(max_len) - n)).alias("input_ids"),
        F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.lit(max_len) - n)).alias("attention_mask"))
