"""Users, roles, permissions: effective permissions, grants, guards on requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .access import Identity, may, tenant_scope


def effective_permissions(users: DataFrame, user_roles: DataFrame, role_permissions: DataFrame, permissions: DataFrame) -> DataFrame:
    """user_id, permissions (sorted, each once) of every user, also of those without a role."""
    held = user_roles.join(role_permissions, "role_id").join(permissions.select("permission_id", "name"), "permission_id").groupBy("user_id").agg(F.sort_array(F.collect_set("name")).alias("permissions"))
    return users.select("user_id").join(held, "user_id", "left").withColumn("permissions", F.coalesce("permissions", F.array().cast("array<string>")))


def not_held(wanted: DataFrame, held: DataFrame, keys: list[str]) -> DataFrame:
    """Roles or permissions that aren't held yet."""
    return wanted.join(held, keys, "left_anti")


def missing_grants(requested: Column, actor: Identity) -> Column:
    """Permissions or groups that the actor hasn't and so can't grant; creators may grant all."""
    none = F.array().cast("array<string>")
    return none if actor.is_creator else F.array_except(requested, F.array(*map(F.lit, sorted(actor.permissions))).cast("array<string>"))


def missing_groups(requested: Column, actor: Identity) -> Column:
    none = F.array().cast("array<string>")
    return none if actor.is_creator else F.array_except(requested, F.array(*map(F.lit, actor.acl_groups)).cast("array<string>"))


def permission_groups(permissions: DataFrame) -> DataFrame:
    """resource, names: permissions by what stands before the first dot."""
    resource = F.when(F.instr("name", ".") > 0, F.substring_index("name", ".", 1)).otherwise("other")
    return permissions.groupBy(resource.alias("resource")).agg(F.sort_array(F.collect_list("name")).alias("names"))


def creators(users: DataFrame) -> DataFrame:
    return users.agg(F.count_if(F.col("level") == "creator").alias("creators"))


def judged_requests(requests: DataFrame, users: DataFrame, actor: Identity) -> DataFrame:
    """requests (action, target_id, level, tenant_id, acl_groups) with allowed and deny_reason, the first that holds."""
    targets = users.select(F.col("user_id").alias("target_id"), F.col("username").alias("target_name"), F.col("level").alias("target_level"), F.col("tenant_id").alias("target_tenant"))
    held = requests.join(targets, "target_id", "left")
    held = held.join(F.broadcast(creators(users)))  # one row
    c, me = F.col, actor
    changes = c("action").isin("update", "delete")
    loses = (c("target_level") == "creator") & ((c("action") == "delete") | (c("level").isNotNull() & (c("level") != "creator")))
    reason = (
        F.when(~F.lit(me.is_admin), "not_an_admin")
        .when(changes & (c("target_name").isNull() | (~F.lit(me.is_creator) & (c("target_tenant") != me.tenant_id))), "not_found")
        .when(c("level").isNotNull() & (c("level") != F.coalesce("target_level", F.lit("user"))) & ~F.lit(me.is_creator), "level_change")
        .when(c("tenant_id").isNotNull() & (c("tenant_id") != me.tenant_id) & ~F.lit(me.is_creator), "tenant_scope")
        .when(F.size(missing_groups(F.coalesce("acl_groups", F.array().cast("array<string>")), me)) > 0, "acl_scope")
        .when((c("action") == "delete") & (c("target_name") == me.username), "self_deletion")
        .when(loses & (c("target_name") == me.username), "self_demotion")
        .when(loses & (c("creators") <= 1), "last_creator")
    )
    return held.withColumn("deny_reason", reason).withColumn("allowed", c("deny_reason").isNull()).drop("target_name", "target_level", "target_tenant", "creators")


def _granting(actor: Identity) -> Column:
    """Whether the actor may grant the permissions of a row (names)."""
    return F.size(missing_grants(F.col("names"), actor)) == 0


def _of_role(role_permissions: DataFrame, permissions: DataFrame) -> DataFrame:
    return role_permissions.join(permissions.select("permission_id", "name"), "permission_id").groupBy("role_id").agg(F.sort_array(F.collect_set("name")).alias("names"))


def judged_assignments(requests: DataFrame, users: DataFrame, roles: DataFrame, role_permissions: DataFrame, permissions: DataFrame, actor: Identity) -> DataFrame:
    """requests (request_id, action: assign or unassign, user_id, role_id) with status.

    The actor needs users.write; a user of another tenant or a role that isn't there is not found; a role
    is assigned only by one who has all of its permissions, and taken away by any.
    """
    none = F.array().cast("array<string>")
    held = requests.join(tenant_scope(users, actor).select("user_id", F.lit(True).alias("__user")), "user_id", "left").join(roles.select("role_id", F.lit(True).alias("__role")), "role_id", "left")
    held = held.join(_of_role(role_permissions, permissions), "role_id", "left").withColumn("names", F.coalesce("names", none))
    status = F.when(F.lit(not may(actor, "users.write")), "forbidden").when(F.col("__user").isNull() | F.col("__role").isNull(), "not_found").when((F.col("action") == "assign") & ~_granting(actor), "ungrantable").otherwise("ok")
    return held.withColumn("status", status).drop("__user", "__role", "names")


def judged_attachments(requests: DataFrame, roles: DataFrame, permissions: DataFrame, actor: Identity) -> DataFrame:
    """requests (request_id, action: attach or detach, role_id, permission_id) with status; who attaches a permission must have it."""
    named = permissions.select("permission_id", F.array("name").alias("names"))
    held = requests.join(roles.select("role_id", F.lit(True).alias("__role")), "role_id", "left").join(named, "permission_id", "left")
    missing = F.col("__role").isNull() | F.col("names").isNull()
    status = F.when(F.lit(not may(actor, "roles.write")), "forbidden").when(missing, "not_found").when((F.col("action") == "attach") & ~_granting(actor), "ungrantable").otherwise("ok")
    return held.withColumn("status", status).drop("__role", "names")


def applied(links: DataFrame, judged: DataFrame, keys: list[str], *, adds: str) -> DataFrame:
    """links (keys) after the good requests, of which the last one of each link holds; doing a thing twice changes nothing."""
    last = judged.where("status = 'ok'").groupBy(*keys).agg(F.max_by("action", "request_id").alias("action"))
    kept = links.select(*keys).join(last.where(F.col("action") != adds), keys, "left_anti")
    return kept.union(last.where(F.col("action") == adds).select(*keys)).distinct()


def created(existing: DataFrame, requests: DataFrame, actor: Identity, permission: str, *, grants: Column | None = None) -> DataFrame:
    """requests (request_id, name) for roles or permissions with status: a name that is taken, also by an earlier request, conflicts."""
    first = F.row_number().over(Window.partitionBy("name").orderBy("request_id")) == 1
    held = requests.withColumn("__first", first).join(existing.select("name", F.lit(True).alias("__taken")).distinct(), "name", "left")
    able = F.lit(True) if grants is None else F.size(missing_grants(grants, actor)) == 0
    status = F.when(F.lit(not may(actor, permission)), "forbidden").when(F.col("__taken").isNotNull() | ~F.col("__first"), "conflict").when(~able, "ungrantable").otherwise("created")
    return held.withColumn("status", status).drop("__first", "__taken")


def deleted(rows: DataFrame, links: list[DataFrame], gone: DataFrame, key: str) -> list[DataFrame]:
    """rows and all links without those of gone (key): who held a role is detached from it."""
    return [df.join(gone.select(key), key, "left_anti") for df in (rows, *links)]


# The standard permissions and roles, and who gets a role when its row is first made.
STANDARD_PERMISSIONS = ("users.read", "users.write", "users.delete", "roles.read", "roles.write", "permissions.read", "permissions.write", "documents.upload", "audit.read")
STANDARD_ROLES = {
    "User Manager": ("users.read", "users.write"),
    "User Admin": ("users.read", "users.write", "users.delete"),
    "Read Only": ("users.read", "roles.read", "permissions.read"),
    "Role Manager": ("roles.read", "roles.write"),
    "Auditor": ("audit.read",),
    "Document Manager": ("documents.upload",),
}
FIRST_GRANTS = {"Document Manager": ("sara",)}


def standard_seed(spark: SparkSession, permissions: DataFrame, roles: DataFrame, grants: DataFrame, users: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """permissions (name), roles (name), role permissions (role, permission) to add, and grants (username, role) with those of new roles.

    What is there already stays as it is: a permission that was taken from a role isn't given back, and
    grants are made only as a role is first made.
    """
    standard = spark.createDataFrame([(p,) for p in STANDARD_PERMISSIONS], "name string")
    named = spark.createDataFrame([(r,) for r in STANDARD_ROLES], "name string")
    new = not_held(named, roles.select("name"), ["name"])
    given = spark.createDataFrame([(r, p) for r, ps in STANDARD_ROLES.items() for p in ps], "role string, permission string")
    firsts = spark.createDataFrame([(u, r) for r, us in FIRST_GRANTS.items() for u in us], "username string, role string")
    of_new = lambda df: df.join(new.withColumnRenamed("name", "role"), "role", "left_semi")
    more = of_new(firsts).join(users.select("username"), "username", "left_semi")
    return seeded(permissions.select("name"), standard, "name"), seeded(roles.select("name"), named, "name"), of_new(given), grants.select("username", "role").unionByName(more.select("username", "role")).distinct()


def seeded(existing: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """existing and those of wanted whose key isn't there; a second time changes nothing."""
    return existing.unionByName(wanted.join(existing.select(key), key, "left_anti").select(existing.columns))
