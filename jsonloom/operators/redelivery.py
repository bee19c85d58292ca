"""Messages delivered at least once: exactly one row of each comes out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jsonloom.session import stage

HOT_KEYS = 256  # at most this many keys are spread; the broadcast list is never longer
SALTS = 32


def quoted(name: str) -> str:
    """A column's name as an expression, also with dots and quotes in it."""
    return "`" + name.replace("`", "``") + "`"


def spare_names(df: DataFrame, *names: str) -> list[str]:
    """Names that don't clash with a column of ``df``."""
    have = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in have:
            n = "_" + n
        have.add(n.lower())
        out.append(n)
    return out


def keep_one_delivery(
    messages: DataFrame,
    key: Column,
    order: Sequence[Column],
    *,
    stored: DataFrame | None = None,
    count_as: str = "deliveries",
    key_as: str = "message_key",
) -> DataFrame:
    """One row per message, with ``key_as`` (its identifier) and ``count_as`` (how often it came).

    Identifiers are split by their aggregated frequency: rows whose identifier occurs once pass
    straight through, only repeated groups are ranked, and both results are united. A row without
    identifier is a message of its own.

    messages, stored: new deliveries, and those already stored (same columns, and ``count_as`` if they have it); a
        stored copy wins over a new one and its count is added, so running batch after batch gives the same rows as
        running once. (``merge_batch`` does that without moving the stored rows.)
    order: what ranks the copies of one message, ascending, NULL first; the first in order stays. Ties fall
        to a hash of the whole row, so that equal copies are the only ones that can be exchanged for each
        other. Rank and hash are computed in the scan's stage: columns that aren't asked for in the result
        aren't exchanged.

    Scale: the frequency is counted with map-side combining. The rank is taken within each map task
    before the exchange (group limit), so a hot identifier sends one row a task. For the join of rows
    and frequencies the at most HOT_KEYS most frequent identifiers are spread over SALTS salts.

    Edge cases: empty input gives no rows; NULL in any column is allowed; columns of any name are
    kept, and the two added ones must be new (ValueError otherwise)."""
    for name in (count_as, key_as):
        if name.lower() in {c.lower() for c in messages.columns}:
            raise ValueError(f"the input already has a column {name}")
    k, age, salt, tie, n, rank, hot_key, spread_by, came, copies = spare_names(messages, "k_", "age_", "salt_", "tie_", "n_", "rank_", "hot_", "spread_", "came_", "copies_")
    columns = [F.col(quoted(c)) for c in messages.columns]
    plain = [F.col(quoted(c)) for c, t in messages.dtypes if "map<" not in t and "variant" not in t]
    ranks = spare_names(messages, *[f"place{i}_" for i in range(len(order))])
    places = [c.alias(r) for c, r in zip(order, ranks, strict=True)]

    def marked(df: DataFrame, old: int, times: Column) -> DataFrame:
        return df.select(*columns, key.alias(k), F.lit(old).alias(age), times.cast("bigint").alias(came), *places, (F.xxhash64(*plain) if plain else F.lit(0)).alias(tie))

    rows = marked(messages, 1, F.lit(1))
    if stored is not None:
        counted_before = count_as.lower() in {c.lower() for c in stored.columns}
        rows = rows.unionByName(marked(stored, 0, F.coalesce(F.col(quoted(count_as)), F.lit(1)) if counted_before else F.lit(1)))
    keyed = rows.where(F.col(k).isNotNull())
    if stored is None:  # every row came once: one column, so that a filter on the count also picks the branch
        copies, counts = n, keyed.groupBy(k).agg(F.count(F.lit(1)).alias(n))
    else:
        counts = keyed.groupBy(k).agg(F.count(F.lit(1)).alias(copies), F.sum(came).alias(n))
    hot = F.broadcast(
        counts.where(F.col(copies) > 1000).orderBy(F.desc(copies), k).limit(HOT_KEYS).select(F.col(k).alias(hot_key), F.lit(SALTS).alias(spread_by))
    )

    def salted(df: DataFrame, pick: Column) -> DataFrame:
        joined = df.join(hot, F.col(k) == F.col(hot_key), "left")
        return joined.withColumn(salt, pick).drop(hot_key, spread_by)

    spread = F.coalesce(F.col(spread_by), F.lit(1))
    left = salted(keyed, F.pmod(F.xxhash64(F.monotonically_increasing_id()), spread))
    right = salted(counts, F.explode(F.sequence(F.lit(0).cast("bigint"), (spread - 1).cast("bigint"))))
    counted = left.join(right, [k, salt])
    single = counted.where(F.col(copies) == 1)
    window = Window.partitionBy(k).orderBy(age, *ranks, tie)
    repeated = counted.where(F.col(copies) > 1).withColumn(rank, F.row_number().over(window)).where(F.col(rank) == 1)
    out = [*columns, F.col(k).alias(key_as), F.col(n).alias(count_as)]
    loose = rows.where(F.col(k).isNull()).withColumn(n, F.col(came))
    return single.select(*out).unionAll(repeated.select(*out)).unionAll(loose.select(*out))


def merge_batch(
    new: DataFrame, stored: DataFrame, key: Column, order: Sequence[Column], *, count_as: str = "deliveries", key_as: str = "message_key"
) -> tuple[DataFrame, DataFrame]:
    """(fresh, repeats) of a batch of deliveries against what is stored, a result of this or of ``keep_one_delivery``.

    fresh: the batch's messages that aren't stored yet, one row each with their count; they are to be appended.
    repeats: (``key_as``, ``count_as``) of those that are, to be added to their counts. Stored rows neither change nor
    move: of them only the identifiers are read, and joined with the batch's (broadcast where Spark finds
    one side small, as a batch usually is)."""
    kept = stage(keep_one_delivery(new, key, order, count_as=count_as, key_as=key_as), "batch")
    ids = kept.where(F.col(key_as).isNotNull()).select(key_as)
    known = stage(stored.where(F.col(key_as).isNotNull()).select(key_as).join(ids, key_as, "left_semi").distinct(), "known")
    return kept.join(known, key_as, "left_anti").select(*[F.col(quoted(c)) for c in kept.columns]), kept.join(known, key_as, "left_semi").select(key_as, count_as)


def with_repeats(stored: DataFrame, fresh: DataFrame, repeats: DataFrame, *, count_as: str = "deliveries", key_as: str = "message_key") -> DataFrame:
    """The stored messages with the counts of later batches added, and the fresh ones: what one run over all would give, but
    that a stored copy stays. ``repeats`` may be those of many batches."""
    (more,) = spare_names(stored, "more_")
    added = repeats.groupBy(key_as).agg(F.sum(count_as).alias(more))
    counted = stored.join(added, key_as, "left").withColumn(count_as, F.col(quoted(count_as)) + F.coalesce(more, F.lit(0))).drop(more)
    return counted.select(*[F.col(quoted(c)) for c in fresh.columns]).unionAll(fresh)
