"""Changes to stored tables, each as a function from the old rows and the input to the new rows.

There is no in-place update: a result replaces the table (`sources.tables.swap` writes it beside the old one and renames).
Joins are on keys that tables are partitioned by, anti-joins stand for deletes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import sentiment_from_rating

KEY = ("project_id", "environment", "source", "external_id")


def last_wins(rows: DataFrame, keys: Sequence[str], ordinal: str = "ordinal") -> DataFrame:
    """One row for each key, the last; it also takes the last one's place."""
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), ordinal).alias("_r")).select(*keys, "_r.*").select(*rows.columns)


def newest_wins(rows: DataFrame, keys: Sequence[str], *order: Column | str) -> DataFrame:
    """One row for each key, the largest by `order` (compared one after the other)."""
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("_r")).select(*keys, "_r.*").select(*rows.columns)


def classify(existing: DataFrame, incoming: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Incoming rows with what an upsert does to them: insert, update, or touch (text unchanged), and whether to index again.

    An update whose rating went away while there was one is indexed again, since the sentiment came from it.
    """
    old = existing.select(*keys, F.col("text").alias("_old_text"), F.col("rating").alias("_old_rating"), F.lit(True).alias("_known"))
    joined = incoming.join(old, list(keys), "left")
    action = F.when(F.col("_known").isNull(), "insert").when(~F.col("text").eqNullSafe(F.col("_old_text")), "update").otherwise("touch")
    lost = F.col("rating").isNull() & F.col("_old_rating").isNotNull()
    return joined.withColumn("action", action).withColumn("reindex", (F.col("action") != "touch") | lost).drop("_old_text", "_old_rating", "_known")


#: Parts into which the inserts of a project are dealt, by their ordinal, to be numbered.
CAP_PARTS = 64


def capped(classified: DataFrame, room: DataFrame, policy: str = "truncate", ordinal: str = "ordinal") -> DataFrame:
    """Inserts beyond the room of their project marked `over`: the first in input order stay, or with `reject` none does.

    `room` has project_id and room; updates need none.  Inserts are numbered within ranges of their project's ordinals, and
    the counts of the ranges say how many come before, so a project of any size is no single task.
    """
    rows = classified.join(room, "project_id", "left")
    insert = F.col("action") == "insert"
    if policy == "reject":
        full = classified.filter(insert).groupBy("project_id").agg(F.count(F.lit(1)).alias("n")).join(room, "project_id").filter("n > room").select("project_id", F.lit(True).alias("_full"))
        return rows.join(full, "project_id", "left").withColumn("over", F.coalesce("_full", F.lit(False))).drop("_full", "room")
    bounds = classified.filter(insert).groupBy("project_id").agg(F.min(ordinal).alias("_first"), F.max(ordinal).alias("_last"))
    width = (F.col("_last") - F.col("_first") + 1) / CAP_PARTS
    dealt = rows.join(bounds, "project_id", "left").withColumn("_part", F.when(insert, F.floor((F.col(ordinal) - F.col("_first")) / width)).otherwise(F.pmod(F.xxhash64(ordinal), F.lit(CAP_PARTS)))).drop("_first", "_last")
    counts = dealt.filter(insert).groupBy("project_id", "_part").count()
    before = counts.select("project_id", "_part", (F.sum("count").over(Window.partitionBy("project_id").orderBy("_part")) - F.col("count")).alias("_before"))
    own = F.row_number().over(Window.partitionBy("project_id", "_part", insert).orderBy(ordinal))
    numbered = dealt.withColumn("_own", own).join(before, ["project_id", "_part"], "left")
    over = insert & (F.col("_before") + F.col("_own") > F.col("room"))
    return numbered.withColumn("over", F.coalesce(over, F.lit(False))).drop("room", "_part", "_own", "_before")


def upsert(existing: DataFrame, incoming: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """The table after the upsert: incoming values win, columns that only the table has are kept or null.

    A rating present gives the sentiment; a rating that went away clears it; otherwise the stored sentiment stays.
    """
    shared = [c for c in incoming.columns if c not in keys and c in existing.columns]
    new = incoming.select(*keys, *[F.col(c).alias(f"n_{c}") for c in shared], F.lit(True).alias("_new"))
    joined = existing.withColumn("_old", F.lit(True)).join(new, list(keys), "full_outer")
    out = []
    for c in existing.columns:
        if c in keys:
            out.append(F.col(c))
        elif c == "sentiment" and "rating" in shared:
            derived = F.when(F.col("n_rating").isNotNull(), sentiment_from_rating(F.col("n_rating"))).when(F.col("rating").isNotNull(), F.lit(None)).otherwise(F.col("sentiment"))
            out.append(F.when(F.col("_new"), derived).otherwise(F.col("sentiment")).alias(c))
        elif c in shared:
            out.append(F.when(F.col("_new"), F.col(f"n_{c}")).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return joined.select(*out)


def replace_children(existing: DataFrame, fresh: DataFrame, parent: str = "review_id", parents: DataFrame | None = None) -> DataFrame:
    """All children of `parents` (those that `fresh` has, if not given) are replaced by those in `fresh`.

    Give the parents where some may have no children any more, else these keep their old ones.
    """
    gone = (fresh if parents is None else parents).select(F.col(parent).cast(existing.schema[parent].dataType)).distinct()
    return existing.join(gone, parent, "left_anti").unionByName(fresh, allowMissingColumns=True)


def bulk_set(existing: DataFrame, values: DataFrame, key: str, column: str) -> DataFrame:
    """A column taken from `values` (key, column) where they have it."""
    v = values.select(key, F.col(column).alias("_v"), F.lit(True).alias("_has"))
    return existing.join(v, key, "left").withColumn(column, F.when(F.col("_has"), F.col("_v")).otherwise(F.col(column))).drop("_v", "_has")


def mark_complete(reviews: DataFrame, chunks: DataFrame, now_s: int) -> DataFrame:
    """indexed_s set where it was null and no excerpt of the review waits for its vector; attempts start anew."""
    pending = chunks.filter(F.col("embedding").isNull()).select(F.col("review_id").alias("id")).distinct().withColumn("_p", F.lit(True))
    joined = reviews.join(pending, "id", "left")
    done = F.col("_p").isNull()
    return joined.withColumns({"indexed_s": F.when(F.col("indexed_s").isNull() & done, now_s).otherwise(F.col("indexed_s")), "index_attempts": F.when(done, 0).otherwise(F.col("index_attempts"))}).drop("_p")


def add_counts(existing: DataFrame, deltas: DataFrame, keys: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """Counters with what came in added: insert or add."""
    both = existing.select(*keys, *sums).unionByName(deltas.select(*keys, *sums))
    return both.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])


def insert_ignore(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The incoming rows that are new, each key once (the first by ordinal)."""
    once = incoming.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("ordinal"))).filter("_n = 1").drop("_n")
    return once.join(existing.select(*keys), list(keys), "left_anti")


def fill_null(existing: DataFrame, values: DataFrame, key: str, column: str) -> DataFrame:
    """A column filled from `values` only where it is null."""
    v = values.select(key, F.col(column).alias("_v"))
    return existing.join(v, key, "left").withColumn(column, F.coalesce(column, "_v")).drop("_v")


def set_hidden(reviews: DataFrame, wanted: Column, hidden: bool) -> DataFrame:
    """Rows with `changed`: only those whose visibility differs from what is wanted are touched."""
    changed = wanted & (F.col("hidden") != F.lit(hidden))
    return reviews.withColumn("changed", F.coalesce(changed, F.lit(False))).withColumn("hidden", F.when(F.col("changed"), F.lit(hidden)).otherwise(F.col("hidden")))


def delete_with_counter(rows: DataFrame, doomed: DataFrame, counters: DataFrame, key: str = "id", owner: str = "project_id") -> tuple[DataFrame, DataFrame]:
    """The rows that stay, and the owners' counters lowered by what went, never below zero."""
    gone = rows.join(doomed.select(key), key, "left_semi").groupBy(owner).count()
    lowered = counters.join(gone, owner, "left").withColumn("review_count", F.greatest(F.lit(0), F.col("review_count") - F.coalesce("count", F.lit(0)))).drop("count")
    return rows.join(doomed.select(key), key, "left_anti"), lowered


def missing_from_export(stored: DataFrame, export: DataFrame, as_of_s: int) -> DataFrame:
    """Stored rows as old as the export or older that it doesn't have (`suffix`); undated ones stay."""
    return stored.filter(F.col("occurred_s") <= as_of_s).join(export.select("suffix"), "suffix", "left_anti")


def reconcile(stored: DataFrame, found: DataFrame, key: str = "name") -> DataFrame:
    """Every name with keep, remove or add."""
    a, b = stored.select(key).distinct().withColumn("_a", F.lit(True)), found.select(key).distinct().withColumn("_b", F.lit(True))
    return a.join(b, key, "full_outer").select(key, F.when(F.col("_a") & F.col("_b"), "keep").when(F.col("_a"), "remove").otherwise("add").alias("verdict"))


def purge(accounts: DataFrame, projects: DataFrame, reviews: DataFrame, cutoff_s: int, limit: int) -> DataFrame:
    """For the accounts due (deleted before the cutoff, oldest first): how many projects and reviews go with them."""
    due = accounts.filter(F.col("deleted_s") < cutoff_s).orderBy("deleted_s", "id").limit(limit).select(F.col("id").alias("account_id"))
    p = projects.join(due, "account_id", "left_semi")
    r = reviews.groupBy("project_id").count()
    per = p.join(r, p.id == r.project_id, "left").groupBy("account_id").agg(F.count(F.lit(1)).alias("projects"), F.sum(F.coalesce("count", F.lit(0))).alias("reviews"))
    return due.join(per, "account_id", "left").select("account_id", F.coalesce("projects", F.lit(0)).alias("projects"), F.coalesce("reviews", F.lit(0)).alias("reviews"))


def cascade(doomed: DataFrame, *levels: tuple[DataFrame, str, str]) -> list[DataFrame]:
    """What stays of each level (table, its parent column, its own key) when the parents in `doomed` (id) go."""
    out, gone = [], doomed.select("id")
    for table, parent, key in levels:
        mine = table.join(gone.select(F.col("id").alias(parent)), parent, "left_semi")
        out.append(table.join(gone.select(F.col("id").alias(parent)), parent, "left_anti"))
        gone = mine.select(F.col(key).alias("id"))
    return out


def reindex_mark(reviews: DataFrame, wanted: Column) -> DataFrame:
    return reviews.withColumns({"indexed_s": F.when(wanted, F.lit(None)).otherwise(F.col("indexed_s")), "index_attempts": F.when(wanted, 0).otherwise(F.col("index_attempts"))})


def dead_letters(reviews: DataFrame, failed: DataFrame, most: int = 5) -> DataFrame:
    """Attempts of failed messages' reviews raised to the most, so no sweep takes them up again."""
    f = failed.select(F.col("review_id").alias("id")).distinct().withColumn("_f", F.lit(True))
    return reviews.join(f, "id", "left").withColumn("index_attempts", F.when(F.col("_f"), F.greatest("index_attempts", F.lit(most))).otherwise(F.col("index_attempts"))).drop("_f")


def change_plan(accounts: DataFrame, projects: DataFrame, account_id, plan: str, badge: bool) -> tuple[DataFrame, DataFrame]:
    """The account's plan, and the badge of all its projects with it."""
    a = accounts.withColumn("plan", F.when(F.col("id") == account_id, plan).otherwise(F.col("plan")))
    p = projects.withColumn("show_badge", F.when(F.col("account_id") == account_id, badge).otherwise(F.col("show_badge")))
    return a, p
