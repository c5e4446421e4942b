"""Table maintenance: upserts, snapshots, versions. Each takes and gives whole tables; a sink writes them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert_pages(existing: DataFrame, incoming: DataFrame, key: tuple[str, ...] = ("source_id", "slug"), hash_col: str = "content_hash", sticky: tuple[str, ...] = ()) -> DataFrame:
    """existing with incoming put over it by key, and `change`: insert, update, skip (equal hash) or keep. Sticky columns keep the old value where the new one is null."""
    cols = [c for c in existing.columns if c not in key]
    old, new = existing.select(*key, F.struct(*cols).alias("o")), incoming.select(*key, F.struct(*cols).alias("n"))
    both = old.join(new, list(key), "full_outer")
    change = F.when(F.col("n").isNull(), "keep").when(F.col("o").isNull(), "insert").when(F.col(f"o.{hash_col}").eqNullSafe(F.col(f"n.{hash_col}")), "skip").otherwise("update")
    both = both.withColumn("change", change)
    take_new = F.col("change").isin("insert", "update")
    value = lambda c: F.when(take_new, F.coalesce(f"n.{c}", f"o.{c}") if c in sticky else F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    return both.select(*key, *[value(c).alias(c) for c in cols], "change")


def diff_snapshots(old: DataFrame, new: DataFrame, key: str = "slug", hash_col: str = "content_hash") -> DataFrame:
    """(key, change, old_key): added, modified, deleted, or renamed, a hash that left one key and came to another. Of several such keys the least pair up."""
    o, n = old.select(F.col(key).alias("ok"), F.col(hash_col).alias("oh")), new.select(F.col(key).alias("nk"), F.col(hash_col).alias("nh"))
    both = o.join(n, F.col("ok") == F.col("nk"), "full_outer")
    nth = lambda k, h: F.row_number().over(Window.partitionBy(h).orderBy(k))
    gone = both.where(F.col("nk").isNull()).select("ok", "oh").withColumn("r", nth("ok", "oh"))
    come = both.where(F.col("ok").isNull()).select("nk", "nh").withColumn("r", nth("nk", "nh"))
    moved = gone.join(come, (F.col("oh") == F.col("nh")) & (gone["r"] == come["r"]), "full_outer")
    change = F.when(F.col("ok").isNull(), "added").when(F.col("nk").isNull(), "deleted").otherwise("renamed")
    changed = both.where(F.col("ok").isNotNull() & F.col("nk").isNotNull() & ~F.col("oh").eqNullSafe(F.col("nh")))
    return moved.select(F.coalesce("nk", "ok").alias(key), change.alias("change"), F.when(F.col("nk").isNotNull(), F.col("ok")).alias("old_key")).unionByName(
        changed.select(F.col("nk").alias(key), F.lit("modified").alias("change"), F.lit(None).cast("string").alias("old_key"))
    )


def soft_delete(pages: DataFrame, which, now) -> DataFrame:
    """Sets deleted_at where `which` holds and it is not set."""
    return pages.withColumn("deleted_at", F.when(F.col("deleted_at").isNull() & which, now).otherwise(F.col("deleted_at")))


def restore(pages: DataFrame, which) -> DataFrame:
    return pages.withColumn("deleted_at", F.when(which, F.lit(None)).otherwise(F.col("deleted_at")))


def purge(pages: DataFrame, older_than_hours: int, now) -> DataFrame:
    """Without what was deleted longer ago."""
    return pages.where(F.col("deleted_at").isNull() | (F.col("deleted_at") > now - F.make_dt_interval(hours=F.lit(older_than_hours))))


def snapshot_versions(before: DataFrame, after: DataFrame, key: str, body: str, at) -> DataFrame:
    """(key, body, snapshot_at): the bodies that a change replaced."""
    a = after.select(F.col(key).alias("_k"), F.col(body).alias("_b"))
    return before.join(a, F.col(key) == F.col("_k")).where(~F.col(body).eqNullSafe(F.col("_b"))).select(key, body, at.alias("snapshot_at"))


def revert_to(versions: DataFrame, key: str, back: int = 1, order: str = "snapshot_at") -> DataFrame:
    """The version that lies `back` snapshots before now, for each key that has one."""
    return versions.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where(F.col("_n") == back).drop("_n")


def replace_chunks(existing: DataFrame, new: DataFrame) -> DataFrame:
    """The new chunks of each page; an embedding stays where the text of (page_id, chunk_index) is the same."""
    old = existing.select("page_id", "chunk_index", F.col("chunk_text").alias("_t"), F.col("embedding").alias("_e"))
    out = new.drop("embedding").join(old, ["page_id", "chunk_index"], "left")
    return out.withColumn("embedding", F.when(F.col("_t") == F.col("chunk_text"), F.col("_e"))).drop("_t", "_e")


def append_links(existing: DataFrame, incoming: DataFrame, pages: DataFrame) -> DataFrame:
    """incoming (from_slug, to_slug, link_type) as new rows (from_page_id, to_page_id, link_type): slugs resolved, repeats and known links left out."""
    ids = pages.select("slug", "page_id")
    out = (
        incoming.join(ids.select(F.col("slug").alias("from_slug"), F.col("page_id").alias("from_page_id")), "from_slug")
        .join(ids.select(F.col("slug").alias("to_slug"), F.col("page_id").alias("to_page_id")), "to_slug")
        .select("from_page_id", "to_page_id", "link_type")
        .dropDuplicates()
    )
    return out.join(existing.select(*out.columns), out.columns, "left_anti")


def list_pages(pages: DataFrame, kind: str | None = None, updated_after: str | None = None, slug_prefix: str | None = None, sources: list[str] | None = None, tags: DataFrame | None = None, include_deleted: bool = False, sort: str = "updated_desc", limit: int = 20, offset: int = 0) -> DataFrame:
    """A page of the listing. Sorts: updated_desc, updated_asc, slug, title; ties by slug."""
    out = pages if include_deleted else pages.where(~F.col("deleted"))
    if kind:
        out = out.where(F.col("type") == kind)
    if updated_after:
        out = out.where(F.col("updated_on") > F.lit(updated_after).cast("date"))
    if slug_prefix:
        out = out.where(F.col("slug").startswith(slug_prefix))
    if sources:
        out = out.where(F.col("source_id").isin(sources))
    if tags is not None:
        out = out.join(tags, "page_id", "left_semi")
    order = {"updated_desc": F.desc("updated_on"), "updated_asc": F.asc("updated_on"), "slug": F.asc("slug"), "title": F.asc("title")}[sort]
    return out.orderBy(order, "slug").offset(offset).limit(limit)
