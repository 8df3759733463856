"""Which rows a caller may see, as one predicate."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def alive(now: Column, prefix: str = "") -> Column:
    """Not expired and not invalid at the time; an open end never passes."""
    ends = (F.col(f"{prefix}{c}") for c in ("expires_at", "invalid_at"))
    return reduce(lambda a, b: a & b, (c.isNull() | (c > now) for c in ends))


def not_expired(now: Column, prefix: str = "") -> Column:
    c = F.col(f"{prefix}expires_at")
    return c.isNull() | (c > now)


def visible(now: Column, agent=None, user=None, task=None, shared: bool = False, prefix: str = "") -> Column:
    """The caller's own rows, those shared with the user or the task, and with neither, all shared rows.

    agent, user and task are values or columns; None leaves that part of the scope open.
    """
    def own(name: str, value) -> Column:
        return F.col(f"{prefix}{name}") == (value if isinstance(value, Column) else F.lit(value))

    is_shared = F.col(f"{prefix}shared")
    may: list[Column] = []
    if agent is not None and user is not None:
        may.append(own("agent_id", agent) & own("user_id", user))
    elif agent is not None:
        may.append(own("agent_id", agent))
    elif user is not None:
        may.append(own("user_id", user))
    if shared and user is not None:
        may.append(own("user_id", user) & is_shared)
    if task is not None:
        may.append(own("task_id", task) & is_shared)
    if shared and user is None and task is None:
        may.append(is_shared)
    return alive(now, prefix) & reduce(lambda a, b: a | b, may) if may else alive(now, prefix)


def visible_fact(now: Column, agent=None, user=None, task=None, shared: bool = False) -> Column:
    """For facts joined to their memory, whose columns carry the prefix m_: the parent is visible and the fact active."""
    return visible(now, agent, user, task, shared, "m_") & F.col("active_until").isNull()


#: The columns in which a query may say who asks (null or missing: open) and a row whose it is.
QUERY = ("query_agent", "query_user", "query_task", "query_shared")
ROW = ("agent_id", "user_id", "task_id", "shared")


def asks(queries: DataFrame) -> list[str]:
    """The scope columns that the queries have."""
    return [c for c in QUERY if c in queries.columns]


def in_scope(given: list[str]) -> Column:
    """Whether a query's scope columns, of those given, let it see a row: as visible(), with a scope by row."""
    agent, user, task = (F.col(c) if c in given else F.lit(None) for c in QUERY[:3])
    shared = F.coalesce(F.col("query_shared"), F.lit(False)) if "query_shared" in given else F.lit(False)
    a, u, t = (F.coalesce(x == F.col(c), F.lit(False)) for x, c in zip((agent, user, task), ROW[:3], strict=True))
    own = F.when(agent.isNotNull() & user.isNotNull(), a & u).when(agent.isNotNull(), a).when(user.isNotNull(), u).otherwise(False)
    lent = F.coalesce(F.col("shared"), F.lit(False)) & ((shared & u) | t | (shared & user.isNull() & task.isNull()))
    free = agent.isNull() & user.isNull() & task.isNull() & ~shared
    return own | lent | free


def mask(scope: dict[str, np.ndarray], rows: dict[str, np.ndarray]) -> np.ndarray:
    """in_scope for every row with every query. scope: by query, objects with None where open; rows: likewise."""
    given = {c: np.array([x is not None for x in scope[c]]) for c in QUERY[:3]}
    a, u, t = (np.equal(rows[r][:, None], scope[q][None, :]).astype(bool) & given[q] for q, r in zip(QUERY[:3], ROW[:3], strict=True))
    ha, hu, ht = (given[c] for c in QUERY[:3])
    flag = scope["query_shared"].astype(bool)
    lent = rows["shared"].astype(bool)[:, None] & ((flag & u) | t | (flag & ~hu & ~ht))
    return np.where(ha & hu, a & u, np.where(ha, a, u)) | lent | ~(ha | hu | ht | flag)
