"""Accounts: password hashes, signed tokens, signup, login, and who an identity is now."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
import os
import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import rbac

#: Rounds of the password hash; a hash tells its own, so this may grow.
ROUNDS = 200_000
TOKEN_MINUTES = 60


def hash_password(plain: str, *, rounds: int = ROUNDS, salt: bytes | None = None) -> str:
    salt = os.urandom(16) if salt is None else salt
    return f"pbkdf2-sha256${rounds}${salt.hex()}${hashlib.pbkdf2_hmac('sha256', plain.encode(), salt, rounds).hex()}"


def verify_password(plain: str, hashed: str) -> bool:
    """Whether a password has a hash; a hash that is none matches nothing."""
    try:
        kind, rounds, salt, _ = hashed.split("$")
        return kind == "pbkdf2-sha256" and hmac.compare_digest(hash_password(plain, rounds=int(rounds), salt=bytes.fromhex(salt)), hashed)
    except (ValueError, AttributeError):
        return False


def _code(raw: bytes) -> str:
    return base64.urlsafe_b64encode(raw).rstrip(b"=").decode()


def _signature(body: str, secret: str) -> str:
    return _code(hmac.new(secret.encode(), body.encode(), hashlib.sha256).digest())


def encode_token(claims: dict, secret: str, *, minutes: int = TOKEN_MINUTES, now: float | None = None) -> str:
    """A signed token (HS256) of claims, which expires."""
    held = claims | {"exp": int((time.time() if now is None else now) + 60 * minutes)}
    body = ".".join(_code(json.dumps(x, separators=(",", ":")).encode()) for x in ({"alg": "HS256", "typ": "JWT"}, held))
    return f"{body}.{_signature(body, secret)}"


def decode_token(token: str, secret: str, *, now: float | None = None) -> dict | None:
    """The claims; None for a token that is forged, expired or malformed."""
    try:
        body, _, signature = token.rpartition(".")
        head, claims = (json.loads(base64.urlsafe_b64decode(x + "=" * (-len(x) % 4))) for x in body.split("."))
        good = head["alg"] == "HS256" and hmac.compare_digest(_signature(body, secret), signature)
        return claims if good and claims["exp"] > (time.time() if now is None else now) else None
    except (ValueError, KeyError, TypeError, AttributeError):
        return None


@F.pandas_udf(T.StringType())
def _hashed(plain: pd.Series) -> pd.Series:
    return plain.map(lambda p: None if p is None else hash_password(p))


@F.pandas_udf(T.BooleanType())
def _verified(plain: pd.Series, hashed: pd.Series) -> pd.Series:
    return pd.Series([p is not None and verify_password(p, h) for p, h in zip(plain, hashed)])


def tokens(secret: str, claims: Column, *, minutes: int = TOKEN_MINUTES) -> Column:
    """Tokens of claims, given as JSON."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda c: None if c is None else encode_token(json.loads(c), secret, minutes=minutes))

    return run(claims)


def signed_up(requests: DataFrame, users: DataFrame, *, tenant: str, order: str = "request_id") -> DataFrame:
    """requests (request_id, username, email, password, and whatever else) with status, and the account of those that are created.

    Level, tenant and groups are never taken from a request: user, the default tenant, none. A name that
    is taken, by a user or by an earlier request, conflicts.
    """
    first = F.row_number().over(Window.partitionBy("username").orderBy(order)) == 1
    held = requests.select(order, "username", "email", "password").withColumn("__first", first)
    held = held.join(users.select("username", F.lit(True).alias("__taken")), "username", "left")
    status = F.when(F.coalesce(F.trim("username"), F.lit("")) == "", "invalid").when(F.col("__taken") | ~F.col("__first"), "conflict").otherwise("created")
    held = held.withColumn("status", F.coalesce(status, F.lit("created")))
    made = F.col("status") == "created"
    return held.select(
        order, "username", "status", F.when(made, F.col("email")).alias("email"), F.when(made, "user").alias("level"), F.when(made, tenant).alias("tenant_id"), F.when(made, F.array().cast("array<string>")).alias("acl_groups"),
        _hashed(F.when(made, F.col("password"))).alias("password_hash"),
    )


def claims_of(users: DataFrame, user_roles: DataFrame, role_permissions: DataFrame, permissions: DataFrame) -> DataFrame:
    """user_id, username and claims (JSON) as they are now: name, level, tenant, groups, effective permissions."""
    held = users.join(rbac.effective_permissions(users, user_roles, role_permissions, permissions), "user_id")
    return held.select("user_id", "username", F.to_json(F.struct(F.col("username").alias("sub"), "level", "tenant_id", "acl_groups", "permissions")).alias("claims"))


def logged_in(attempts: DataFrame, users: DataFrame, claims: DataFrame) -> DataFrame:
    """attempts (username, password) with status and, where the password is right, claims; an unknown name looks like a wrong password."""
    held = attempts.join(users.select("username", "password_hash"), "username", "left").join(claims.select("username", "claims"), "username", "left")
    right = F.coalesce(_verified("password", F.coalesce("password_hash", F.lit(""))), F.lit(False))
    held = held.withColumn("status", F.when(right, "ok").otherwise("unauthorized"))
    return held.withColumn("claims", F.when(F.col("status") == "ok", F.col("claims"))).drop("password", "password_hash")


def current(sessions: DataFrame, users: DataFrame, user_roles: DataFrame, roles: DataFrame, role_permissions: DataFrame, permissions: DataFrame) -> DataFrame:
    """sessions (username of a valid token) with what the tables say now: level, tenant, groups, roles, permissions; status tells of users that are gone."""
    named = user_roles.join(roles.select("role_id", F.col("name").alias("role")), "role_id").groupBy("user_id").agg(F.sort_array(F.collect_set("role")).alias("roles"))
    held = users.join(rbac.effective_permissions(users, user_roles, role_permissions, permissions), "user_id").join(named, "user_id", "left")
    held = held.select("username", "level", "tenant_id", "acl_groups", F.coalesce("roles", F.array().cast("array<string>")).alias("roles"), "permissions")
    return sessions.join(held, "username", "left").withColumn("status", F.when(F.col("level").isNull(), "unauthorized").otherwise("ok"))
