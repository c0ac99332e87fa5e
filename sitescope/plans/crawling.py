"""What a crawl of every project may do: hosts, limits and the settings that exceed them, for all projects at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import host, port, www_twin

# The limits of an organisation that sets none.
CAPS = {"max_pages": 500, "max_depth": 10, "concurrency": 5}


def crawl_hosts(root_url: Column, extra: Column) -> Column:
    """The hosts that belong to a crawl, in order: the root's, further ones, and the root's with or without ``www.``."""
    own = host(root_url)
    more = F.coalesce(extra, F.array().cast("array<string>"))
    return F.array_sort(F.array_compact(F.array_distinct(F.concat(F.array(own, www_twin(own)), more))))


def search_hosts(root_url: Column) -> Column:
    """The hosts whose search figures belong to a project: with and without ``www.``."""
    bare = F.regexp_replace(host(root_url), "^www[.]", "")
    return F.array_sort(F.array(bare, F.concat(F.lit("www."), bare)))


def _caps(projects: DataFrame) -> dict[str, Column]:
    return {k: F.coalesce(F.col(f"org_{k}"), F.lit(v)) for k, v in CAPS.items()}


def crawl_config(projects: DataFrame) -> DataFrame:
    """Adds hosts, extra_ports, and max_pages, max_depth and concurrency cut to what organisation and plan allow.

    ``projects`` have root_url, extra_hosts, the settings, ``org_`` limits (null: CAPS) and plan_pages (null or 0: no limit).
    """
    caps = _caps(projects)
    plan = F.coalesce(F.nullif(F.col("plan_pages"), F.lit(0)), caps["max_pages"])
    usual = port(F.col("root_url")).isin(80, 443)
    cut = {k: F.least(F.col(k), cap) for k, cap in caps.items()}
    cut["max_pages"] = F.least(cut["max_pages"], plan)
    ports = F.when(usual, F.array().cast("array<int>")).otherwise(F.array(port(F.col("root_url"))))
    return projects.withColumns({"hosts": crawl_hosts(F.col("root_url"), F.col("extra_hosts")), "extra_ports": ports, **cut})


def over_caps(projects: DataFrame, key: str) -> DataFrame:
    """(key, setting, value, limit): the settings that are above their organisation's limit."""
    rows = [F.struct(F.lit(k).alias("setting"), F.col(k).alias("value"), cap.alias("limit")) for k, cap in _caps(projects).items()]
    return projects.select(key, F.inline(F.array(*rows))).where("value > `limit`")
