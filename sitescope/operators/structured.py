"""Checks of structured data: required and recommended properties of schema.org types."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame

from ..plans.batches import map_rows

# Organisation types, and (required, recommended) properties by type.
ORGANISATIONS = (
    "Organization", "EducationalOrganization", "CollegeOrUniversity", "School", "HighSchool", "MiddleSchool",
    "ElementarySchool", "Preschool", "Corporation", "NGO", "GovernmentOrganization", "LocalBusiness",
)
REQUIREMENTS = {
    **{t: (("name",), ("url", "logo", "address", "contactPoint", "sameAs")) for t in ORGANISATIONS},
    "WebSite": (("name", "url"), ()),
    "BreadcrumbList": (("itemListElement",), ()),
    "Course": (("name", "description"), ("provider",)),
    "Event": (("name", "startDate", "location"), ("endDate", "description", "eventStatus", "image", "organizer")),
    "FAQPage": (("mainEntity",), ()),
    **{t: (("headline",), ("datePublished", "author", "image")) for t in ("Article", "NewsArticle", "BlogPosting")},
    "Person": (("name",), ("jobTitle", "affiliation")),
}
CHECK = "format string, types array<string>, valid boolean, errors array<string>, warnings array<string>"


def nodes(data) -> list[dict]:
    """Every object with an @type, at any depth."""
    if isinstance(data, list):
        return [n for x in data for n in nodes(x)]
    if not isinstance(data, dict):
        return []
    return ([data] if "@type" in data else []) + [n for x in data.values() for n in nodes(x)]


def node_types(node: dict) -> list[str]:
    own = node.get("@type")
    return [t.rsplit("/", 1)[-1] for t in (own if isinstance(own, list) else [own]) if isinstance(t, str)]


def check(structured: dict | None) -> list[dict]:
    """One result for each JSON-LD block, and one for all microdata. The messages are fixed values of stored evidence."""
    out = []
    for b in (structured or {}).get("json_ld") or []:
        types, errors, warnings = list(b["types"] or []), [], []
        if not b["valid"]:
            types, errors = [], [b["error"] or "Invalid JSON"]
        elif b["data"] is None:
            warnings.append(b["error"] or "Block too large to check properties")
        else:
            found = nodes(json.loads(b["data"]))
            if not found:
                errors.append("No @type found, so search engines cannot interpret this block")
            for node in found:
                for t in node_types(node):
                    needed, better = REQUIREMENTS.get(t, ((), ()))
                    absent = lambda p, n=node: n.get(p) in (None, "", [], {})
                    errors += [f"{t} is missing required property '{p}'" for p in needed if absent(p)]
                    warnings += [f"{t} could add recommended property '{p}'" for p in better if absent(p)]
        out.append({"format": "json_ld", "types": types, "valid": not errors, "errors": errors, "warnings": warnings})
    micro = (structured or {}).get("microdata") or {}
    if micro.get("count"):
        out.append({"format": "microdata", "types": [t.rsplit("/", 1)[-1] for t in micro["types"]], "valid": True, "errors": [], "warnings": ["Microdata properties are detected but not checked"]})
    return out


def check_pages(pages: DataFrame) -> DataFrame:
    """(crawl_job_id where there is one, url, format, types, valid, errors, warnings) of pages with the struct structured_data."""
    keys = [f for f in pages.schema if f.name in ("crawl_job_id", "url")]
    names = [f.name for f in keys]
    own = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keys)
    return map_rows(pages.select(*names, "structured_data"), lambda r: [{k: r[k] for k in names} | c for c in check(r["structured_data"])], f"{own}, {CHECK}")
