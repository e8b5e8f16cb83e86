"""Fine event types and argument roles mapped to the general ones."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventloom.functions import lexicons as lx
from eventloom.functions.text import any_of, strip


def _exact(raw: Column, table: dict[str, list[str]]) -> Column:
    return reduce(lambda c, kv: c.when(raw.isin(kv[1]), kv[0]), table.items(), F.when(F.lit(False), ""))


def _by_rule(raw: Column, rules: list[tuple[str, list[str]]]) -> Column:
    return reduce(lambda c, kv: c.when(any_of(raw, kv[1]), kv[0]), rules, F.when(F.lit(False), ""))


def _raw(value: Column) -> Column:
    return strip(F.coalesce(value, F.lit("")))


def event_type(value: Column, table: dict | None = None, rules: list | None = None, default: str = lx.DEFAULT_EVENT_TYPE) -> Column:
    """Exact table first, then the first rule with a keyword in the type, then the default."""
    raw = _raw(value)
    return F.coalesce(_exact(raw, table or lx.FINE_TYPES), _by_rule(raw, rules or lx.TYPE_RULES), F.lit(default))


def role(value: Column, table: dict | None = None, rules: list | None = None) -> Column:
    """Exact table, rules, then the role itself; an empty role is an object."""
    raw = _raw(value)
    return F.coalesce(_exact(raw, table or lx.FINE_ROLES), _by_rule(raw, rules or lx.ROLE_RULES), F.when(raw == "", "object").otherwise(raw))


def type_covered(value: Column) -> Column:
    raw = _raw(value)
    return F.coalesce(_exact(raw, lx.FINE_TYPES), _by_rule(raw, lx.TYPE_RULES)).isNotNull()


def role_covered(value: Column) -> Column:
    raw = _raw(value)
    return F.coalesce(_exact(raw, lx.FINE_ROLES), _by_rule(raw, lx.ROLE_RULES)).isNotNull()


def first_value(arguments: Column, role: str) -> Column:
    """The value of the first argument with that role, or null."""
    return F.try_element_at(F.filter(arguments, lambda a: a["role"] == role), F.lit(1))["value"]
