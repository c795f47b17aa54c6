"""Access control: one predicate for filters before scoring and for checks at the exit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def split(acl: Column) -> dict[str, Column]:
    """The filterable columns of an acl struct; without a tenant it is unset, and so closed to all."""
    tenant = F.coalesce(acl["tenant"], F.lit(""))
    return {
        "acl_tenant": tenant,
        "acl_allow": F.coalesce(acl["allow"], F.array().cast("array<string>")),
        "acl_visibility": F.coalesce(acl["visibility"], F.lit("restricted")),
        "acl_unset": acl.isNull() | F.coalesce(acl["unset"], F.lit(False)) | (tenant == ""),
    }


def admits(tenant: Column, principals: Column, acl_tenant: Column, acl_allow: Column, acl_visibility: Column, acl_unset: Column) -> Column:
    """Set, of the user's tenant, and public or allowed to one of the user's principals. An empty tenant never matches; null lists hold nobody."""
    allowed = F.coalesce(F.arrays_overlap(acl_allow, principals), F.lit(False))
    return F.coalesce(~acl_unset & (acl_tenant != "") & (acl_tenant == tenant) & (allowed | (acl_visibility == "public")), F.lit(False))


def visible(df: DataFrame, tenant: str, principals: list[str], doc_ids: list | None = None, doc_type: str | None = None, kind: str | None = None) -> DataFrame:
    """Rows that the user may see; further filters only narrow, and an empty doc_ids list is none."""
    groups = F.array(*[F.lit(p) for p in principals]).cast("array<string>")
    out = df.filter((~F.col("acl_unset")) & (F.col("acl_tenant") == tenant)).filter(admits(F.lit(tenant), groups, *[F.col(c) for c in ("acl_tenant", "acl_allow", "acl_visibility", "acl_unset")]))
    if doc_ids:
        out = out.filter(F.col("doc_id").isin(doc_ids))
    if doc_type is not None:
        out = out.filter(F.col("doc_type") == doc_type)
    return out if kind is None else out.filter(F.col("kind") == kind)


def strictest(pairs: DataFrame) -> DataFrame:
    """doc_id, idx, chunk_no, acl columns -> of each element the least open acl: restricted before public, unset before set, then fewer principals; of equals the later chunk."""
    open_ = F.struct((F.col("acl_visibility") == "public").cast("int").alias("p"), (~F.col("acl_unset")).cast("int").alias("s"), F.size("acl_allow").alias("n"), (-F.col("chunk_no")).alias("c"))
    own = F.struct("acl_tenant", "acl_allow", "acl_visibility", "acl_unset")
    return pairs.groupBy("doc_id", "idx").agg(F.min_by(own, open_).alias("acl")).select("doc_id", "idx", "acl.*")
