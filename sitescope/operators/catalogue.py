"""The rule catalogue: identity and metadata of the fifty audit rules."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession


class Rule(NamedTuple):
    id: str
    category: str
    severity: str
    confidence: str
    effort: str
    auto_fix: bool
    title: str
    advice: str


def _rules() -> list[Rule]:
    t, o, c, l, s = "technical", "on_page", "content", "internal_linking", "structured_data"  # noqa: E741
    return [
        Rule("tech.http_client_error", t, "high", "high", "low", False, "Page answers with a client error", "Restore the page, redirect it, or remove links to it."),
        Rule("tech.http_server_error", t, "high", "high", "low", False, "Page answers with a server error", "Find the cause in the server's logs and fix it."),
        Rule("tech.fetch_failed", t, "medium", "medium", "low", False, "Page could not be fetched", "Check that the address answers in time and with a sound certificate."),
        Rule("tech.http_not_https", t, "high", "high", "low", False, "Pages are served without encryption", "Serve every page over https and redirect http there."),
        Rule("tech.redirect_chain", t, "medium", "high", "low", False, "Address redirects more than once", "Redirect straight to the last address."),
        Rule("tech.internal_link_to_redirect", t, "low", "high", "low", False, "Internal links point to a redirect", "Link to the final address."),
        Rule("tech.broken_internal_links", t, "medium", "high", "low", False, "Page links to broken pages", "Correct or remove these links."),
        Rule("tech.sitemap_missing", t, "medium", "high", "low", False, "No usable sitemap", "Publish a sitemap and name it in robots.txt."),
        Rule("tech.sitemap_errors", t, "medium", "high", "low", False, "Some sitemaps cannot be read", "Repair the sitemaps that fail."),
        Rule("tech.sitemap_bad_urls", t, "medium", "high", "low", False, "Sitemap lists pages that should not be indexed", "List only canonical pages that answer with 200."),
        Rule("tech.robots_unreachable", t, "critical", "high", "low", False, "robots.txt cannot be reached", "Make robots.txt answer, as crawlers stay away until it does."),
        Rule("tech.robots_missing", t, "informational", "high", "low", False, "There is no robots.txt", "Consider one that names the sitemap."),
        Rule("tech.blocked_by_robots", t, "low", "medium", "low", False, "Page is blocked by robots.txt", "Allow the page if it should be found."),
        Rule("tech.unexpected_noindex", t, "high", "medium", "low", False, "Page asks not to be indexed", "Remove noindex if the page should be found."),
        Rule("tech.canonical_multiple", t, "high", "high", "low", False, "Page has several canonical addresses", "Keep exactly one."),
        Rule("tech.canonical_target_problem", t, "high", "high", "low", False, "Canonical address has a problem", "Point it to a page that answers with 200 and may be indexed."),
        Rule("tech.duplicate_url_variants", t, "medium", "high", "low", False, "One page under several addresses", "Choose one address and redirect the others."),
        Rule("tech.slow_response", t, "medium", "medium", "medium", False, "Page answers slowly", "Look at caching and slow work on the server."),
        Rule("tech.deep_important_page", t, "medium", "high", "medium", False, "Important page is deep in the site", "Link to it nearer to the home page."),
        Rule("onpage.title_missing", o, "high", "high", "low", True, "Page has no title", "Write a title that names the page's subject."),
        Rule("onpage.title_multiple", o, "medium", "high", "low", False, "Page has several titles", "Keep one title."),
        Rule("onpage.title_length", o, "low", "high", "low", True, "Title is too short or too long", "Bring the title within the usual length."),
        Rule("onpage.title_duplicate", o, "medium", "high", "low", True, "Pages share a title", "Give each page a title of its own."),
        Rule("onpage.meta_description_missing", o, "medium", "high", "low", True, "Page has no meta description", "Write a short summary of the page."),
        Rule("onpage.meta_description_multiple", o, "low", "high", "low", False, "Page has several meta descriptions", "Keep one."),
        Rule("onpage.meta_description_length", o, "low", "high", "low", True, "Meta description is too short or too long", "Bring it within the usual length."),
        Rule("onpage.meta_description_duplicate", o, "low", "high", "low", True, "Pages share a meta description", "Write one for each page."),
        Rule("onpage.h1_missing", o, "medium", "high", "low", False, "Page has no main heading", "Add one h1."),
        Rule("onpage.h1_multiple", o, "low", "high", "low", False, "Page has several main headings", "Keep one h1 and lower the others."),
        Rule("onpage.heading_hierarchy", o, "low", "high", "low", False, "Headings skip levels", "Let each heading be at most one level below the last."),
        Rule("onpage.canonical_missing", o, "low", "high", "low", True, "Page names no canonical address", "Add its own address as canonical."),
        Rule("onpage.url_structure", o, "low", "medium", "high", False, "Address is hard to read or share", "Prefer short lower-case paths with hyphens."),
        Rule("onpage.image_alt_missing", o, "low", "high", "low", False, "Images without alternative text", "Describe informative images; leave decorative ones empty."),
        Rule("onpage.lang_missing", o, "low", "high", "low", True, "Page names no language", "Set the lang attribute."),
        Rule("content.thin", c, "low", "medium", "medium", False, "Page has little text", "Add what visitors need, or merge the page."),
        Rule("content.duplicate", c, "medium", "high", "low", False, "Pages have the same text", "Keep one, or make them differ."),
        Rule("content.near_duplicate", c, "low", "medium", "medium", False, "Pages have nearly the same text", "Merge them or work out the difference."),
        Rule("content.topic_overlap", c, "low", "low", "medium", False, "Pages are about the same topic", "Decide which page answers which question."),
        Rule("content.weak_structure", c, "low", "high", "low", False, "Long page with few subheadings", "Divide the text by headings."),
        Rule("content.missing_sections", c, "low", "medium", "medium", False, "Expected sections are not there", "Add the missing sections if visitors need them."),
        Rule("content.review_dated_reference", c, "informational", "low", "low", False, "Title or heading names a past year", "Check that the page is up to date."),
        Rule("links.orphan", l, "medium", "high", "medium", False, "Page is in the sitemap but not linked", "Link to it from a fitting page."),
        Rule("links.important_few_inlinks", l, "medium", "high", "medium", False, "Important page has few links to it", "Link to it from related pages."),
        Rule("links.no_internal_outlinks", l, "low", "high", "low", False, "Page links to no other page", "Add links to related pages."),
        Rule("links.excessive", l, "low", "medium", "medium", False, "Page has very many links", "Keep the links that help visitors."),
        Rule("links.nofollow_internal", l, "low", "high", "low", False, "Internal links with nofollow", "Remove nofollow from links within the site."),
        Rule("schema.invalid", s, "high", "high", "low", False, "Structured data has errors", "Correct the listed errors."),
        Rule("schema.recommended_properties", s, "informational", "medium", "low", False, "Structured data could say more", "Add recommended properties with verified values."),
        Rule("schema.home_organisation_missing", s, "low", "high", "low", False, "Home page does not describe the organisation", "Add an Organization block."),
        Rule("schema.content_type_opportunity", s, "informational", "medium", "medium", False, "Pages could use structured data of their type", "Add the suggested type."),
    ]


RULES = {r.id: r for r in _rules()}
ORDER = {r: k for k, r in enumerate(RULES)}


def catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(RULES.values()), "id string, category string, default_severity string, confidence string, effort string, auto_fix_eligible boolean, title string, recommendation string")
