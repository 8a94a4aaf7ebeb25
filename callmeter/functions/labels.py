"""Small labelling expressions: consumers, slices, prefix files, model and project names."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# fixed values: consumer categories, in the order reports list them
CATEGORIES = ("subagents", "reviews", "tool_turns", "user_turns")
# fixed values: task families
FAMILIES = ("question", "refactor", "review", "measure")
# fixed values: files that build the start of a prompt
PREFIX_FILES = ("CLAUDE.md", "CLAUDE.local.md", ".mcp.json", "settings.json", "settings.local.json")
PREFIX_DIR = "/.claude/"
# fixed values: cache lifetimes in seconds
TTL_SECONDS = {"5m": 300, "1h": 3600}
MIN_CACHEABLE = 4096


def category(trigger: Column, family: Column, reread: Column) -> Column:
    return (
        F.when(trigger == "subagent", "subagents")
        .when(F.coalesce(family == "review", F.lit(False)) | F.coalesce(reread, F.lit(False)), "reviews")
        .when(trigger == "tool_call", "tool_turns")
        .otherwise("user_turns")
    )


def ladder(value: Column, steps: list[tuple[float, str]], above: str) -> Column:
    """Label of the first step whose upper bound (inclusive) holds the value; null stays null."""
    out = F.when(value.isNull(), F.lit(None).cast("string"))
    for bound, label in steps:
        out = out.when(value <= bound, label)
    return out.otherwise(above)


def rank_slice(rank: Column) -> Column:
    return ladder(rank, [(1, "1st"), (3, "2-3"), (10, "4-10"), (30, "11-30")], "31+")


def shell_slice(n: Column) -> Column:
    return ladder(n, [(0, "0"), (2, "1-2"), (5, "3-5")], "6+")


def is_prefix_file(path: Column) -> Column:
    p = F.regexp_replace(path, r"\\", "/")
    return F.element_at(F.split(p, "/"), -1).isin(*PREFIX_FILES) | F.concat(F.lit("/"), p).contains(PREFIX_DIR)


def normal_model(name: Column) -> Column:
    """A model without its trailing [..] qualifier; used for comparisons only."""
    return F.regexp_replace(F.trim(name), r"\[[^\]]*\]$", "")


def project_name(cwd: Column) -> Column:
    """Last folder of a working directory written by either kind of system."""
    windows = cwd.contains("\\") | cwd.rlike(r"^[A-Za-z]:")
    last = F.when(windows, F.regexp_extract(cwd, r"([^\\/:]+)[\\/]*$", 1)).otherwise(
        F.regexp_extract(cwd, r"([^/]+)/*$", 1))
    return F.when(last == "", cwd).otherwise(last)


def version_key(version: Column) -> Column:
    """Comparable form of a dotted version; parts that are not numbers count as 0."""
    return F.transform(F.split(version, r"\."), lambda p: F.coalesce(p.try_cast("int"), F.lit(0)))


def newer_than(version: Column, verified: str) -> Column:
    return version_key(version) > version_key(F.lit(verified))


def pseudonym(name: Column, length: int = 8) -> Column:
    return F.substring(F.sha2(name.cast("string"), 256), 1, length)


def ttl_of_write(cache_write: Column, cache_write_1h: Column) -> Column:
    """Lifetime in seconds set by a call that wrote cache; null for a call that wrote none."""
    return F.when(cache_write > 0, F.when(cache_write_1h > 0, F.lit(TTL_SECONDS["1h"]))
                  .otherwise(F.lit(TTL_SECONDS["5m"])).cast("bigint"))
