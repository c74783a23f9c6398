"""Access control as a filter inside the plan, below every ranking, limit and corpus statistic."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Identity:
    """Who asks. It's bound into plans as literals; a query's author can't supply it as a column."""

    username: str
    tenant_id: str
    acl_groups: tuple[str, ...] = ()
    level: str = "user"
    permissions: frozenset[str] = field(default_factory=frozenset)

    @property
    def is_creator(self) -> bool:
        return self.level == "creator"

    @property
    def is_admin(self) -> bool:
        return self.level in ("creator", "admin")


def groups_literal(groups: tuple[str, ...]) -> Column:
    """An array of strings also where it's empty, so that no group means no overlap."""
    return F.array(*map(F.lit, groups)).cast("array<string>")


def visible(identity: Identity, tenant: str = "tenant_id", groups: str = "acl_groups") -> Column:
    """Tenant equality and a shared group; rows without groups are visible to nobody."""
    return (F.col(tenant) == F.lit(identity.tenant_id)) & F.coalesce(F.arrays_overlap(groups, groups_literal(identity.acl_groups)), F.lit(False))


class SecureChunks:
    """The only way to chunks: every frame that leaves it is filtered for its identity first."""

    def __init__(self, chunks: DataFrame, identity: Identity) -> None:
        self.__chunks, self.identity = chunks, identity

    def frame(self) -> DataFrame:
        return self.__chunks.where(visible(self.identity))


def tenant_scope(df: DataFrame, identity: Identity, tenant: str = "tenant_id") -> DataFrame:
    """A listing: creators see all, others their tenant."""
    return df if identity.is_creator else df.where(F.col(tenant) == identity.tenant_id)


def in_scope(df: DataFrame, identity: Identity, key: str, value: object) -> DataFrame:
    """One row by key; a row of another tenant looks like none."""
    return tenant_scope(df, identity).where(F.col(key) == F.lit(value))


def may(identity: Identity, permission: str) -> bool:
    """Creators may all, others need the permission."""
    return identity.is_creator or permission in identity.permissions


def job_visible(identity: Identity) -> Column:
    """Jobs, whatever their outcome, are visible to their tenant and to creators."""
    return F.lit(identity.is_creator) | (F.col("tenant_id") == identity.tenant_id)


def leaks(hits: DataFrame, allowed: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Hits that the identity may not see; it must be empty, and mustn't be for an unfiltered control."""
    return hits.join(allowed.select(key), key, "left_anti")


_RANKING = {"GlobalLimit", "LocalLimit", "Sort", "Window", "Offset", "Tail", "WindowGroupLimit"}


def _paths(node, above: list[str]) -> list[list[str]]:
    """What stands on each way from the root of a plan to a leaf: R for a ranking, F for the group filter."""
    kind = node.nodeName()
    mark = ["R"] if kind in _RANKING else ["F"] if kind == "Filter" and "arrays_overlap" in node.simpleStringWithNodeId() + node.expressions().toString() else []
    children = node.children()
    held = [children.apply(i) for i in range(children.size())]
    return [path for child in held for path in _paths(child, above + mark)] if held else [above + mark]


def filter_below_ranking(df: DataFrame) -> bool:
    """Whether the optimised plan filters by group, and below every limit, sort and window over what it filters."""
    guarded = [path for path in _paths(df._jdf.queryExecution().optimizedPlan(), []) if "F" in path]
    return bool(guarded) and all("R" not in path[max(i for i, m in enumerate(path) if m == "F") :] for path in guarded)


def granted(permission: str, level: str = "level", permissions: str = "permissions", *, panel: bool = False) -> Column:
    """may() over rows of users: creators always, then, where a panel asks for it, admins only, then by permission."""
    creator, admin = F.col(level) == "creator", F.col(level).isin("creator", "admin")
    held = F.coalesce(F.array_contains(permissions, permission), F.lit(False))
    return creator | ((admin if panel else F.lit(True)) & held)


def may_panel(level: str = "level") -> Column:
    """Whether a user's level opens the admin panel."""
    return F.coalesce(F.col(level).isin("creator", "admin"), F.lit(False))


def one_row(df: DataFrame, what: str) -> DataFrame:
    """df, which must have a row: none raises not found when it is read."""
    n = df.agg(F.count(F.lit(1)).alias("__n"), F.first(F.struct("*"), ignorenulls=False).alias("__row"))
    found = F.when(F.col("__n") > 0, F.lit(True)).otherwise(F.raise_error(F.lit(f"{what} not found")).cast("boolean"))
    return n.where(found).select("__row.*")
