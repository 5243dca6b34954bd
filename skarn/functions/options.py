"""Options in groups (``group:name``), for dicts and for tables."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def split_options(options: Mapping[str, Any], groups: Iterable[str], merge: bool = False) -> Any:
    """Options routed to their groups: ({group: {name: value}}, the rest), or with ``merge`` one dict in which the
    rest goes to every group. Later options replace earlier ones; an unknown group's option keeps its whole key."""
    routed: dict[str, dict[str, Any]] = {g: {} for g in groups}
    rest: dict[str, Any] = {}
    for key, value in options.items():
        group, colon, name = key.partition(":")
        if colon and group in routed:
            routed[group][name] = value
        elif merge:
            for own in routed.values():
                own[key] = value
        else:
            rest[key] = value
    return routed if merge else (routed, rest)


def option_group(key: Column, groups: Iterable[str]) -> Column:
    """The group of a key, null for the rest."""
    head = F.split(key, ":", 2)[0]
    return F.when(key.contains(":") & head.isin(*groups), head)


def option_name(key: Column, groups: Iterable[str]) -> Column:
    """The key without its group, if it has a known one."""
    return F.when(option_group(key, groups).isNotNull(), F.get(F.split(key, ":", 2), F.lit(1))).otherwise(key)
