"""URL functions: exact normalisation in Arrow batches, and the parts of normalised URLs as expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

MAX_URL = 2048
# Schemes that are no pages.
SKIPPED = ("javascript:", "mailto:", "tel:", "data:", "ftp:", "file:", "sms:")


def normalise(raw: str | None, base: str | None = None) -> str | None:
    """The canonical absolute http(s) URL, or None where a link cannot be crawled.

    Scheme and host in lower case (IDNA), no default port, no fragment, dot segments resolved; the query stays.
    """
    from urllib.parse import urljoin, urlsplit, urlunsplit

    text = (raw or "").strip()
    low = text.lower()
    if not text or low.startswith(SKIPPED) or low in ("http:", "https:") or text.endswith("://"):
        return None
    try:
        parts = urlsplit(urljoin(base, text) if base else text)
        port, name = parts.port, (parts.hostname or "").strip().rstrip(".").lower()
        if parts.scheme not in ("http", "https") or not name or parts.username or parts.password:
            return None
        host = f"[{name}]" if ":" in name else name.encode("idna").decode("ascii")
    except (ValueError, UnicodeError):
        return None
    if port is not None and port != {"http": 80, "https": 443}[parts.scheme]:
        host += f":{port}"
    path = parts.path or "/"
    if "/." in path:
        path = urlsplit(urljoin(f"{parts.scheme}://{host}/", path)).path
    url = urlunsplit((parts.scheme, host, path, parts.query, ""))
    return url if len(url) <= MAX_URL else None


@F.pandas_udf(StringType())
def normalise_url(raw: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([normalise(r, b) for r, b in zip(raw, base, strict=True)])


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)", 1))


def path(url: Column) -> Column:
    """The path, ``/`` where it is empty."""
    own = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(own == "", F.lit("/")).otherwise(own)


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def port(url: Column) -> Column:
    own = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/:?#]+:(\d+)", 1)
    return F.when(own != "", own.cast("int")).when(scheme(url) == "https", 443).otherwise(80)


def path_with_query(url: Column) -> Column:
    return F.concat(path(url), F.when(query(url) != "", F.concat(F.lit("?"), query(url))).otherwise(""))


def www_twin(name: Column) -> Column:
    """The same site's other name, with or without ``www.``; null for addresses and names without a dot."""
    plain = F.contains(name, F.lit(".")) & ~name.rlike(r"^[0-9.]+$") & ~F.contains(name, F.lit(":"))
    return F.when(plain & F.startswith(name, F.lit("www.")), F.substr(name, F.lit(5))).when(plain, F.concat(F.lit("www."), name))


def variant_key(url: Column) -> Column:
    """Equal for addresses that differ in case, port, query or a slash at the end."""
    low = F.regexp_replace(F.lower(path(url)), "/+$", "")
    return F.concat(scheme(url), F.lit("://"), host(url), F.when(low == "", "/").otherwise(low))


def group_subject(*parts: Column) -> Column:
    return F.left(F.sha2(F.concat_ws("\x1f", *parts), 256), F.lit(16))


def glob_regex(pattern: str) -> str:
    """A shell pattern as an anchored regular expression; ``*`` also crosses slashes, case counts."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif end > 0:
            inner = pattern[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[")
            out += "[" + ("^" + inner[1:] if inner[0] == "!" else inner) + "]"
            i = end
        else:
            out += c if c.isalnum() or c in "_/" else "\\" + c
        i += 1
    return f"(?s)^{out}$"


def matches_any(value: Column, patterns: list[str] | tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for p in patterns:
        hit = hit | value.rlike(glob_regex(p))
    return hit


def problems(url: Column, limit: int = 115) -> Column:
    """What makes a URL hard to read or share, in a fixed order."""
    raw = path(url)
    plain = F.coalesce(F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))), raw)
    # The texts of the evidence, which stored findings are compared by.
    found = [
        F.when(F.length(url) > limit, F.concat(F.lit(f"longer than {limit} characters ("), F.length(url).cast("string"), F.lit(")"))),
        F.when(plain != F.lower(plain), F.lit("contains upper-case letters")),
        F.when(F.contains(plain, F.lit("_")), F.lit("uses underscores instead of hyphens")),
        F.when(F.contains(plain, F.lit(" ")), F.lit("contains spaces")),
        F.when(F.contains(raw, F.lit("//")), F.lit("contains repeated slashes")),
        F.when(F.size(F.split(query(url), "&")) > 3, F.lit("has more than three query parameters")),
    ]
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def under(url: Column, source: Column) -> Column:
    """Whether an https URL lies on or below a source: same host and port, path at a segment boundary."""
    base = F.regexp_replace(path(source), "/+$", "")
    same = (scheme(url) == "https") & (host(url) == host(source)) & (port(url) == port(source))
    return same & ((path(url) == base) | F.startswith(path(url), F.concat(base, F.lit("/"))))


def slug(name: Column) -> Column:
    return F.left(F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), F.lit("-")), F.lit(60))
