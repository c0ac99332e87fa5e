"""HTML pages as rows: all facts in Arrow batches, and the simple ones as expressions."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import host, normalise
from ..plans.batches import arrow_schema, sliced

# Limits of what is kept of a page, elements whose text is no content, and what is said of a block.
MAX_TEXT, MAX_IMAGES, MAX_LINKS, MAX_ANCHOR, MAX_JSON_LD, MAX_ADDRESS = 50_000, 500, 2_000, 300, 50_000, 2_048
MAX_CLEAN, MAX_TITLE, MAX_ABOUT, MAX_ROBOTS, MAX_LANG = 500, 1_000, 2_000, 300, 35
SILENT = ("script", "style", "noscript", "template", "svg", "iframe")
INVALID_JSON, LARGE_BLOCK = "Invalid JSON at line {line}: {text}", "Block larger than 50 KB; content not stored"
# Fixed values of HTML: elements without content, those of a head, those that format text, those whose content is no markup.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr", "param")
IN_HEAD = ("html", "head", "base", "basefont", "bgsound", "link", "meta", "title", "noscript", "noframes", "style", "script", "template")
FORMATTING = ("a", "b", "big", "code", "em", "font", "i", "nobr", "s", "small", "strike", "strong", "tt", "u")
RAW = ("iframe", "noembed", "noframes", "xmp", "textarea", "title")
#: A link to a page that exists only behind the number sign, as the source has it.
HASH_ROUTE = r"""(?i)href\s*=\s*["']#!?/[^"'\s]"""
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")

FACTS = """
title string, title_count int, meta_description string, meta_description_count int, meta_robots string,
canonical_url string, canonical_count int, lang string, hreflang array<struct<hreflang: string, href: string>>,
headings array<struct<level: int, text: string>>, h1_count int,
images array<struct<src: string, alt: string, has_alt: boolean>>, image_count int, images_missing_alt int,
links array<struct<url: string, anchor_text: string, nofollow: boolean>>,
structured_data struct<json_ld: array<struct<valid: boolean, error: string, types: array<string>, data: string>>,
    microdata: struct<count: int, types: array<string>>>,
text string, word_count int, content_hash string, hash_route_links int
"""


def _clean(text: str | None, limit: int = MAX_CLEAN) -> str:
    return re.sub(r"\s+", " ", text or "").strip()[:limit]


def json_types(node) -> list[str]:
    """Every @type at any depth."""
    if isinstance(node, list):
        return [t for x in node for t in json_types(x)]
    if not isinstance(node, dict):
        return []
    own = node.get("@type")
    here = [own] if isinstance(own, str) else [t for t in own if isinstance(t, str)] if isinstance(own, list) else []
    return here + [t for x in node.values() for t in json_types(x)]


class _Page(HTMLParser):
    """Collects facts in one pass, with as much of the tree as they need: the open elements, and whether the body has begun.

    A body begins with its tag, with a tag that no head holds, or with text outside the head's elements. Text of the body is
    that of its text nodes, each apart. What a template holds is not in the page.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.titles: list[list[str]] = []
        self.meta: dict[str, list[str]] = {}
        self.canonicals: list[str] = []
        self.hreflang: list[tuple[str, str]] = []
        self.headings: list[tuple[int, list[str]]] = []
        self.images: list[tuple[str, str | None, bool]] = []
        self.links: list[dict] = []
        self.blocks: list[list[str]] = []
        self.text: list[str] = []
        self.micro, self.micro_types = 0, set()
        self.lang = self.base = None
        self._body = False
        self._open: list[str] = []
        self._node: list[str] = []
        self._sinks: dict[str, list[str]] = {}  # title, script and heading that are open
        self._anchor: dict | None = None

    def _flush(self) -> None:
        text = "".join(self._node)
        self._node = []
        if not text:
            return
        for sink in self._sinks.values():
            sink.append(text)
        if self._anchor is not None:
            self._anchor["text"].append(text)
        if self._body and not any(t in SILENT for t in self._open):
            self.text.append(text)

    def _close(self, tag: str) -> None:
        self._sinks.pop("heading" if tag in HEADINGS else tag, None)
        if tag == "a":
            self._anchor = None

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and "svg" in self._open:
            self.handle_endtag(tag)

    def handle_starttag(self, tag, attrs):
        if self._open and self._open[-1] in RAW:
            return
        self._flush()
        if "template" in self._open:
            self._open += [tag] * (tag not in VOID)
            return
        if tag not in IN_HEAD:
            self._body = True
        a = dict(reversed(attrs))  # the first of repeated attributes
        self._facts(tag, a)
        if tag in HEADINGS and self._open and self._open[-1] in HEADINGS:
            self._open.pop()
        if tag == "a":
            self._anchor = None
            if "a" in self._open:
                self._open.remove("a")
            if a.get("href") is not None or "href" in a:
                self._anchor = {"href": a["href"] or "", "text": [], "image": None, "nofollow": "nofollow" in (a.get("rel") or "").lower().split()}
                self.links.append(self._anchor)
        elif tag in HEADINGS:
            self._sinks["heading"] = found = []
            self.headings.append((int(tag[1]), found))
        elif tag == "title" and not self._body and set(self._open) <= {"html", "head"}:
            self._sinks["title"] = found = []
            self.titles.append(found)
        elif tag == "script" and (a.get("type") or "").split(";")[0].strip().lower() == "application/ld+json":
            self._sinks["script"] = found = []
            self.blocks.append(found)
        if tag not in VOID:
            self._open.append(tag)

    def _facts(self, tag: str, a: dict) -> None:
        if "itemscope" in a:
            self.micro += 1
            self.micro_types.update((a.get("itemtype") or "").split())
        if tag == "html":
            self.lang = self.lang or a.get("lang")
        elif tag == "base" and "href" in a and self.base is None:
            self.base = a["href"] or ""
        elif tag == "meta" and "name" in a:
            self.meta.setdefault((a["name"] or "").strip().lower(), []).append(a.get("content") or "")
        elif tag == "link" and "rel" in a and "href" in a:
            rel = (a["rel"] or "").lower().split()
            if "canonical" in rel:
                self.canonicals.append(a["href"] or "")
            elif "alternate" in rel and a.get("hreflang"):
                self.hreflang.append((a["hreflang"], a["href"] or ""))
        elif tag == "img":
            self.images.append((a.get("src") or "", a.get("alt"), "alt" in a))
            if self._anchor is not None and "alt" in a and self._anchor["image"] is None:
                self._anchor["image"] = a["alt"] or ""

    def handle_endtag(self, tag):
        if self._open and self._open[-1] in RAW and tag != self._open[-1]:
            return
        if tag in HEADINGS:
            tag = next((t for t in reversed(self._open) if t in HEADINGS), tag)
        if tag not in self._open:
            return
        self._flush()
        at = len(self._open) - 1 - self._open[::-1].index(tag)
        gone = [tag] if tag in FORMATTING else self._open[at:]
        del self._open[at : at + len(gone)]
        for t in gone:
            self._close(t)

    def handle_comment(self, data):
        self._flush()

    def handle_data(self, data):
        if "template" in self._open:
            return
        if not self._body and data.strip() and set(self._open) <= {"html", "head"}:
            self._body = True
        self._node.append(data)

    def close(self):
        super().close()
        self._flush()


def _block(raw: str) -> dict:
    try:
        data = json.loads(raw)
    except json.JSONDecodeError as e:
        return {"valid": False, "error": INVALID_JSON.format(line=e.lineno, text=e.msg), "types": [], "data": None}
    small = len(raw) <= MAX_JSON_LD
    return {"valid": True, "error": None if small else LARGE_BLOCK, "types": sorted(set(json_types(data))), "data": raw if small else None}


def page_facts(html: str | None, url: str | None) -> dict:
    """The facts of one page. Addresses are resolved against the base address and normalised; where that fails links are left
    out, and canonical addresses, alternates and sources of images stay as written. A null page has no facts, as an empty one."""
    import hashlib

    p = _Page()
    p.feed(re.sub(r"<[a-zA-Z/!?][^>]*\Z", "", html or ""))  # a tag that the end cuts off is none
    p.close()
    base = (normalise(p.base, url) if p.base is not None else None) or url
    address = lambda raw: normalise(raw, base) or raw.strip()
    text = re.sub(r"\s+", " ", " ".join(p.text)).strip()
    links: dict[tuple[str, bool], str] = {}
    for x in p.links:
        to = normalise(x["href"], base)
        if to is not None and len(links) < MAX_LINKS:
            links.setdefault((to, x["nofollow"]), _clean("".join(x["text"]), MAX_ANCHOR) or _clean(x["image"], MAX_ANCHOR))
    about = [_clean(x, MAX_ABOUT) for x in p.meta.get("description", [])]
    return {
        "title": _clean("".join(p.titles[0]), MAX_TITLE) if p.titles else None,
        "title_count": len(p.titles),
        "meta_description": about[0] if about else None,
        "meta_description_count": len(about),
        "meta_robots": ", ".join(_clean(x, MAX_ROBOTS) for x in p.meta.get("robots", [])) or None,
        "canonical_url": address(p.canonicals[0])[:MAX_ADDRESS] if p.canonicals else None,
        "canonical_count": len(p.canonicals),
        "lang": _clean(p.lang, MAX_LANG) if p.lang else None,
        "hreflang": [{"hreflang": _clean(x, MAX_LANG), "href": address(to)} for x, to in p.hreflang],
        "headings": [{"level": n, "text": _clean("".join(t))} for n, t in p.headings],
        "h1_count": sum(n == 1 for n, _ in p.headings),
        "images": [{"src": address(src)[:MAX_ADDRESS], "alt": _clean(alt) if has else None, "has_alt": has} for src, alt, has in p.images[:MAX_IMAGES]],
        "image_count": len(p.images),
        "images_missing_alt": sum(not has for _, _, has in p.images),
        "links": [{"url": to, "anchor_text": anchor, "nofollow": nofollow} for (to, nofollow), anchor in links.items()],
        "structured_data": {"json_ld": [_block("".join(b)) for b in p.blocks], "microdata": {"count": p.micro, "types": sorted(p.micro_types)}},
        "text": text[:MAX_TEXT],
        "word_count": len(re.findall(r"\w+", text)),
        "content_hash": hashlib.sha256(text.lower().encode()).hexdigest() if text else None,
        "hash_route_links": len(re.findall(HASH_ROUTE, html or "")),
    }


def parse_pages(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Every column of ``pages`` but the HTML, with the facts of each page."""
    kept = [f for f in pages.schema if f.name != html]
    names, types = [f.name for f in kept], arrow_schema(FACTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            facts = pa.RecordBatch.from_pylist([page_facts(h, u) for h, u in zip(b.column(html).to_pylist(), b.column(url).to_pylist(), strict=True)], schema=types)
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], *facts.columns], names=[*names, *types.names])

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return pages.mapInArrow(run, f"{own}, {FACTS}")


# --- the same in expressions, for pages of plain structure --------------------------------------------------------------


def tag_text(html: Column, tag: str) -> Column:
    found = F.regexp_extract(html, rf"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1)
    return F.trim(F.regexp_replace(F.regexp_replace(found, "(?s)<[^>]*>", " "), r"\s+", " "))


def tag_count(html: Column, tag: str) -> Column:
    return F.regexp_count(html, F.lit(rf"(?i)<{tag}[\s>]"))


def language(html: Column) -> Column:
    return F.regexp_extract(html, r"""(?i)<html[^>]*\slang="([^"]*)\"""", 1)


def hrefs(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r"""(?i)<a[^>]*\shref="([^"]*)\""""), F.lit(1))


def visible_text(html: Column) -> Column:
    body = F.regexp_replace(html, r"(?is)<(script|style|noscript|template|svg|head)[\s>].*?</(script|style|noscript|template|svg|head)>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(body, "(?s)<[^>]*>", " "), r"\s+", " "))


def robots_directives(value: Column) -> Column:
    parts = F.transform(F.split(F.lower(F.coalesce(value, F.lit(""))), ","), lambda x: F.trim(F.regexp_replace(x, "^[^:]*:", "")))
    return F.array_distinct(F.filter(parts, lambda x: x != ""))


def is_noindex(value: Column) -> Column:
    return F.arrays_overlap(robots_directives(value), F.array(F.lit("noindex"), F.lit("none")))


def hash_route_links(html: Column) -> Column:
    return F.regexp_count(html, F.lit(HASH_ROUTE))


def split_links(pages: DataFrame, allowed_hosts: list[str]) -> DataFrame:
    """Adds internal_links_count and external_links_count, by the links' hosts."""
    inside = F.filter("links", lambda x: host(x["url"]).isin(allowed_hosts))
    return pages.withColumn("internal_links_count", F.size(inside)).withColumn("external_links_count", F.size("links") - F.size(inside))
