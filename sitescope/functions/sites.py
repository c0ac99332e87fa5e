"""Addresses of sites: root URLs that users enter, and whether an address is public."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

from .urls import normalise

# Names that are never public.
LOCAL = ("localhost", "local", "internal", "intranet", "lan", "home", "test", "invalid", "example")


def public_ip(address: str | None) -> bool:
    import ipaddress

    try:
        ip = ipaddress.ip_address((address or "").strip("[]"))
    except ValueError:
        return False
    inner = getattr(ip, "ipv4_mapped", None) or ip
    return inner.is_global and not inner.is_multicast


def site_root(raw: str | None) -> str | None:
    """The root URL of a site as entered (https where no scheme is given), or None for local names and private addresses."""
    import re

    text = (raw or "").strip()
    url = normalise(text if re.match(r"(?i)[a-z][a-z0-9+.-]*://", text) else f"https://{text}")
    if not url:
        return None
    root = "/".join(url.split("/", 3)[:3]) + "/"
    name = root.split("//", 1)[1].rstrip("/")
    host = re.sub(r":\d+$", "", name) if not name.startswith("[") or "]:" in name else name
    numeric = host.startswith("[") or re.fullmatch(r"[0-9.]+", host)
    if numeric:
        return root if public_ip(host) else None
    return None if "." not in host or host.rsplit(".", 1)[1] in LOCAL else root


@F.pandas_udf(BooleanType())
def is_public_ip(address: pd.Series) -> pd.Series:
    return pd.Series([public_ip(a) for a in address])


@F.pandas_udf(StringType())
def normalise_site(raw: pd.Series) -> pd.Series:
    return pd.Series([site_root(r) for r in raw])


@F.pandas_udf(BooleanType())
def all_public(addresses: pd.Series) -> pd.Series:
    """Whether a name has addresses and every one of them is public."""
    return pd.Series([a is not None and len(a) > 0 and all(public_ip(x) for x in a) for a in addresses])


def ipv4_first(addresses: Column) -> Column:
    """IPv4 addresses before IPv6 ones, each in their order."""
    six = lambda a: F.contains(a, F.lit(":"))
    return F.concat(F.filter(addresses, lambda a: ~six(a)), F.filter(addresses, six))
