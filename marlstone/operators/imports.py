"""Imports, accounts, projects and locations: what arrives against what is stored."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import plan_limit


def account_upsert(accounts: DataFrame, incoming: DataFrame) -> DataFrame:
    """Accounts by their organisation: the last name that came in holds, a deletion is undone, a creator once known stays.

    `incoming` has org, name, creator and ordinal.
    """
    last = incoming.groupBy("org").agg(F.max_by(F.struct("name", "creator"), "ordinal").alias("n"))
    both = accounts.join(last, "org", "full_outer")
    came = F.col("n").isNotNull()
    return both.select("org", F.coalesce("n.name", "name").alias("name"), F.when(~came, F.col("deleted_s")).alias("deleted_s"), F.coalesce("creator", "n.creator").alias("creator"))


def supersede_bootstrap(reviews: DataFrame, prefix: str = "places/") -> tuple[DataFrame, DataFrame]:
    """What stays when the full history of a source has come, and how many preliminary reviews each project loses."""
    preliminary = (F.col("source") == "google") & F.startswith("external_id", F.lit(prefix))
    return reviews.filter(~F.coalesce(preliminary, F.lit(False))), reviews.filter(preliminary).groupBy("project_id", "environment").agg(F.count(F.lit(1)).alias("removed"))


def stale_bootstrap(stored: DataFrame, returned: DataFrame, prefix: str) -> DataFrame:
    """Stored preliminary reviews of one place (by the prefix of their ids) that it returns no more."""
    return stored.filter(F.startswith("external_id", F.lit(prefix))).join(returned.select("external_id"), "external_id", "left_anti")


def create_projects(wanted: DataFrame, accounts: DataFrame) -> DataFrame:
    """Each wanted project (id, account_id, ordinal) with a verdict: created while its account's plan has room.

    Accounts have few projects, so they are numbered within the account.
    """
    n = F.row_number().over(Window.partitionBy("account_id").orderBy("ordinal"))
    told = wanted.withColumn("_n", n).join(accounts.select("account_id", "plan", F.col("projects").alias("_have")), "account_id", "left")
    room = plan_limit(F.col("plan"), "projects")
    return told.withColumn("verdict", F.when(F.col("_n") + F.coalesce("_have", F.lit(0)) <= room, "created").otherwise("over quota")).drop("_n", "_have")


#: Fields of a project that decide what may be shown.
POLICY = ("min_rating", "similarity_floor", "category")


def update_projects(projects: DataFrame, changes: DataFrame) -> DataFrame:
    """Projects with the fields that `changes` gives (null: as it was), and whether the publication policy changed with them."""
    given = [c for c in changes.columns if c != "id" and c in projects.columns]
    joined = projects.join(changes.select("id", *[F.col(c).alias(f"n_{c}") for c in given]), "id", "left")
    differs = [F.coalesce(F.col(f"n_{c}") != F.col(c), F.lit(False)) for c in given if c in POLICY]
    changed = F.lit(False)
    for x in differs:
        changed = changed | x
    new = [F.coalesce(f"n_{c}", c).alias(c) if c in given else F.col(c) for c in projects.columns]
    return joined.select(*new, changed.alias("policy_changed"))


def in_location_order(reviews: DataFrame, location: str, written: str, name: str) -> DataFrame:
    """Reviews with their place within their location: by when they were written, then by name."""
    return reviews.withColumn("place", F.row_number().over(Window.partitionBy(location).orderBy(F.col(written).asc_nulls_first(), name)))


def newest_update_first(reviews: DataFrame) -> DataFrame:
    """A location's reviews as a connector returns them: newest update first, then newest, then by name."""
    return reviews.orderBy(F.col("update_ms").desc(), F.col("create_ms").desc(), "name")


def reindex_counts(reviews: DataFrame, *keys: str) -> DataFrame:
    """How many reviews there are, and of these indexed and pending ones."""
    done = F.col("indexed_s").isNotNull()
    return reviews.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), F.count_if(done).alias("indexed"), F.count_if(~done).alias("pending"))


def select_locations(found: DataFrame, wanted: DataFrame, titles: DataFrame) -> DataFrame:
    """Locations found (id, verified): enabled where verified and wanted, with their listing names where known."""
    picked = wanted.select("id", F.lit(True).alias("_w")).distinct()
    return found.join(picked, "id", "left").join(titles.select("id", "title"), "id", "left").select("id", (F.col("verified") & F.coalesce("_w", F.lit(False))).alias("enabled"), "title")


def set_origins(projects: DataFrame, wanted: DataFrame, most: int = 20) -> DataFrame:
    """Projects with the origins that `wanted` (id, account_id, origins) gives them, where the account is theirs; others stay as they are.

    Origins are put into their usual form, each once, in the order given; what is no web address drops out, and a list over `most` is
    refused as a whole (`refused`)."""
    from ..functions.scalar import origin

    new = F.array_distinct(F.filter(F.transform("origins", lambda o: origin(o)), lambda o: o.isNotNull()))
    asked = wanted.select("id", "account_id", new.alias("_new"))
    told = projects.join(asked, ["id", "account_id"], "left")
    refused = F.coalesce(F.size("_new") > most, F.lit(False))
    return told.withColumn("allowed_origins", F.when(F.col("_new").isNotNull() & ~refused, F.col("_new")).otherwise(F.col("allowed_origins"))).withColumn("refused", refused).drop("_new")


def delete_projects(projects: DataFrame, wanted: DataFrame, **children: DataFrame) -> tuple[DataFrame, dict[str, DataFrame], DataFrame]:
    """What stays of projects and of tables with a project_id when projects (id, account_id) are deleted, and for each deleted
    one how many rows of each table went with it.  One that belongs to another account, or isn't there, is left alone."""
    gone = projects.join(wanted.select("id", "account_id"), ["id", "account_id"], "left_semi").select("id")
    kept = {n: t.join(gone, t["project_id"] == gone["id"], "left_anti") for n, t in children.items()}
    counts = gone
    for n, t in children.items():
        counts = counts.join(t.groupBy(F.col("project_id").alias("id")).agg(F.count(F.lit(1)).alias(n)), "id", "left").withColumn(n, F.coalesce(n, F.lit(0)))
    return projects.join(gone, "id", "left_anti"), kept, counts


def usage_of_projects(projects: DataFrame, usage: DataFrame, month) -> DataFrame:
    """Every project of `projects` with its queries and cache hits of a month, none where it had none."""
    own = usage.filter(F.col("month") == month).groupBy(F.col("project_id").alias("id")).agg(F.sum("queries").alias("queries"), F.sum("cache_hits").alias("cache_hits"))
    zero = F.lit(0).cast("bigint")
    return projects.join(own, "id", "left").withColumns({c: F.coalesce(c, zero) for c in ("queries", "cache_hits")})


def newest(rows: DataFrame, owner: str, made: str, ident: str, most: int) -> DataFrame:
    """The newest rows of each owner, `place` from 1: newest first, then by id.  The cut is made before rows of one owner meet."""
    w = Window.partitionBy(owner).orderBy(F.col(made).desc_nulls_last(), ident)
    return rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most)
