"""Questions and answers of the assistant: topics, numbers, claims, terms, facts that need a source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_TOPICS = 3

# Topics with the pattern that finds them and the rules they are about.
TOPICS = (
    ("broken links and error pages", r"\bbroken\b|\b404\b|\b5\d\d\b|not found|dead links?|error pages?|pages? (that )?(return|give|show)s? errors?|server errors?|fail(ed|ing)? to load", ("tech.broken_internal_links", "tech.http_client_error", "tech.http_server_error", "tech.fetch_failed")),
    ("titles", r"\btitles?\b", ("onpage.title",)),
    ("meta descriptions", r"\bmeta\b|\bdescriptions?\b", ("onpage.meta_description",)),
    ("headings", r"\bh[1-6]\b|\bheadings?\b|\bheaders?\b", ("onpage.h1", "onpage.heading_hierarchy")),
    ("images and alt text", r"\bimages?\b|\balt\b|\bpictures?\b|\bphotos?\b", ("onpage.image_alt",)),
    ("redirects", r"\bredirect", ("tech.redirect_chain", "tech.internal_link_to_redirect")),
    ("canonical URLs and duplicate addresses", r"\bcanonical|duplicate (url|address)|url variants?", ("onpage.canonical", "tech.canonical", "tech.duplicate_url_variants")),
    ("indexing, robots.txt and sitemaps", r"\bindex|\bnoindex\b|\brobots\b|\bsitemaps?\b|\bcrawlab|\bblocked\b|\bhttps\b", ("tech.blocked_by_robots", "tech.unexpected_noindex", "tech.robots", "tech.sitemap", "tech.http_not_https")),
    ("page speed", r"\bslow\b|\bspeed\b|\bfast(er)?\b|load(ing)? times?|\bperformance\b|response times?", ("tech.slow_response",)),
    ("structured data", r"structured data|\bschema\b|rich (results?|snippets?)|json-?ld", ("schema.",)),
    ("internal links", r"internal links?|\borphan|\blinking\b|\binlinks?\b|\boutlinks?\b|\bnofollow\b|deep pages?", ("links.", "tech.deep_important_page")),
    ("content", r"\bcontent\b|\bthin\b|word counts?|\bduplicate (pages?|text|content)\b|\bcopy\b", ("content.",)),
    ("page language", r"\blang(uage)?\b", ("onpage.lang_missing",)),
    ("URL structure", r"url structure|\bslugs?\b|long urls?", ("onpage.url_structure",)),
)
# Data that there is none of.
UNAVAILABLE = (
    ("visitor numbers and traffic", r"\bvisit(s|ors?)\b|\btraffic\b|\bsessions?\b|page ?views?|\baudience\b"),
    ("search rankings and positions", r"\brank(s|ed|ing|ings)?\b|position (on|in) (google|search)"),
    ("competitors", r"\bcompetit(ors?|ion)\b|\brivals?\b|\b(against|than|versus|vs\.?|compared? (to|with)) (other|similar|rival|competing)\b|\bother (universit(y|ies)|institut(e|es|ions)|colleges?|schools?|websites?|sites)\b"),
    ("keywords and search volumes", r"\bkeywords?\b|search volumes?"),
    ("backlinks", r"\bbacklinks?\b|inbound links from other sites"),
    ("Google Search clicks and impressions", r"\bclicks?\b|\bimpressions?\b|\bctr\b|click-?through"),
    ("conversions and bounce rate", r"\bconversions?\b|bounce rate"),
)
# Words that admit missing data, and of questions about what to do first.
ADMITS = r"\b(not available|unavailable|no data|(does not|doesn't|do not|don't) (have|include|contain|provide|cover|hold|record)|do(es)? not track|not (tracked|measured|collected|provided|included|recorded)|no information|isn't available|cannot (tell|answer|say|determine)|not part of)\b"
FIRST = r"\bfirst\b|priorit|most important|next steps?|way forward|where (to|should (we|i)) start|\bfocus\b|\burgent\b|\bbiggest\b|main (problems?|issues?)|what should (we|i) (do|fix)|\bimprove\b"
# Claims that no evidence supports.
CLAIMS = (
    (r"\bguarantee", "promises a guaranteed outcome"),
    (r"\b(?:rank|ranking|position)\s*(?:#|no\.?|number)?\s*\d[\d.,]*", "states a ranking position"),
    (r"\b(?:first|top)\s+(?:page|result|spot|position)s?\s+(?:of|on|in)\s+(?:google|bing|search)", "promises a search position"),
    (r"\b(?:search|keyword)\s+volumes?\s+(?:of|is|are|was)\b", "states a search volume"),
    (r"\b\d[\d,.]*\s*%?\s+(?:more\s+)?(?:visits|visitors|searches|clicks|impressions|backlinks)\b", "states traffic or backlink figures"),
    (r"\btraffic\s+(?:will|would|should)\s+(?:increase|grow|double|rise)", "predicts traffic"),
)
# Facts and words that need a source.
FACTS = (
    r"(?:rs\.?|pkr|usd|\$|€|£)\s?\d[\d,.]*",
    r"\d[\d,.]*\s?(?:%|percent|per cent)",
    r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b",
    r"\b\d{4}-\d{2}-\d{2}\b",
    r"\b\d{1,2}(?:st|nd|rd|th)?\s+(?:jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*\b",
    r"\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*\s+\d{1,2}\b",
    r"\b(?:19|20)\d{2}\b",
    r"\bcgpa\b|\bgpa\b|\bmarks?\b",
)
#: What each begins with: looked at first, as alternatives and word borders are dear at every place of a text.
FACT_STARTS = ("[RrPpUu$€£]", r"\d", r"\d", r"\d", r"\d", "[JjFfMmAaSsOoNnDd]", "[12]", "[CcGgMm]")
FACT_WORDS = ("fee", "fees", "tuition", "eligibility", "eligible", "deadline", "last date", "admission requirement", "admission requirements", "entry requirement", "merit", "scholarship amount", "stipend", "refund", "accreditation", "accredited", "ranked")
FACT_WORD = r"(?=[AaDdEeFfLlMmRrSsſTt])(?iU)(?<!\w)(?:" + "|".join(FACT_WORDS) + r")(?!\w)"


def _hits(value: Column, pairs, limit: int | None = None) -> Column:
    found = F.filter(F.array(*[F.when(value.rlike("(?i)" + p), F.lit(n)) for n, p in pairs]), lambda x: x.isNotNull())
    return F.slice(found, 1, limit) if limit else found


def topics(question: Column) -> Column:
    """What a question is about, in a fixed order; at most three topics."""
    return _hits(question, [(n, p) for n, p, _ in TOPICS], MAX_TOPICS)


def missing_data(question: Column) -> Column:
    return _hits(question, UNAVAILABLE)


def about_priorities(question: Column) -> Column:
    return question.rlike("(?i)" + FIRST)


def page_named(question: Column) -> Column:
    """The first address or path in a question, without punctuation at its end; null if there is none."""
    found = F.regexp_extract(question, r"""https?://[^\s'"<>()]+|(?<![\w.])/[\w\-./%]*[\w\-/%]""", 0)
    return F.when(found != "", F.regexp_replace(found, "[.,;:!?]+$", ""))


# The sentence that opens such an answer, and the warning for a term; stored answers are compared by them.
NO_DATA, USES = "This platform has no data on ", "Uses '{bad}'; the approved term is '{good}'"


def admit(answer: Column, missing: Column, within: int = 250) -> Column:
    """Opens an answer with what there is no data on, unless its first part says so."""
    says = F.left(answer, F.lit(within)).rlike("(?i)" + ADMITS)
    return F.when((F.size(missing) == 0) | says, answer).otherwise(F.concat(F.lit(NO_DATA), F.array_join(missing, "; "), F.lit(". "), answer))


def plain_number(number: Column) -> Column:
    """Without grouping commas and zeros at the end of decimals."""
    value = F.replace(number, F.lit(","), F.lit(""))
    cut = F.regexp_replace(F.regexp_replace(value, "0+$", ""), r"\.$", "")
    return F.when(F.contains(value, F.lit(".")), F.when(cut == "", "0").otherwise(cut)).otherwise(value)


def numbers(value: Column) -> Column:
    """Distinct numbers of a text, sorted; identifiers and list markers do not count."""
    text = F.regexp_replace(F.coalesce(value, F.lit("")), r"(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b", " ")
    text = F.regexp_replace(text, r"(?m)^\s*\d{1,2}[.)]\s+", " ")
    found = F.regexp_extract_all(text, F.lit(r"(?<![\w.])\d+(?:[.,]\d+)*(?![\w])"), F.lit(0))
    return F.array_sort(F.array_distinct(F.transform(found, plain_number)))


def claims(answer: Column) -> Column:
    return _hits(answer, [(n, p) for p, n in CLAIMS])


def unsupported(answers: DataFrame, answer: str = "answer", evidence: str = "evidence") -> DataFrame:
    """Adds the numbers of an answer that its evidence does not have, and its claims."""
    return answers.withColumn("numbers", F.array_except(numbers(F.col(answer)), numbers(F.col(evidence)))).withColumn("claims", claims(F.col(answer)))


def whole_word(word: str) -> str:
    import re

    return r"(?iU)(?<!\w)" + re.sub(r"([.+*?^${}()|\[\]\\])", r"\\\1", word) + r"(?!\w)"


def terms_used(text: Column, terms: dict[str, str]) -> Column:
    """Warnings for terms to avoid, given with the term to use."""
    hits = [F.when(text.rlike(whole_word(bad)), F.lit(USES.format(bad=bad, good=good))) for bad, good in terms.items()]
    return F.filter(F.array(*hits), lambda x: x.isNotNull())


def facts(text: Column) -> Column:
    """Amounts, percentages, dates, years and grades in a text, lower-cased, distinct, sorted."""
    all_ = F.concat(*[F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"(?={start})(?i){p}"), F.lit(0)) for start, p in zip(FACT_STARTS, FACTS, strict=True)])
    return F.array_sort(F.array_distinct(F.transform(all_, lambda x: F.lower(F.trim(x)))))


def protected(original: Column, proposed: Column) -> Column:
    """What a draft adds, removes or mentions that needs a source before it is approved."""
    before, after = facts(original), facts(proposed)
    # no two of these words can overlap, so one pass finds each of them
    named = F.regexp_extract_all(F.coalesce(proposed, F.lit("")), F.lit(FACT_WORD), F.lit(0))
    words = F.array_sort(F.array_distinct(F.transform(named, lambda x: F.lower(F.translate(x, "ſıİ", "sii")))))
    return F.struct(F.array_except(after, before).alias("added"), F.array_except(before, after).alias("removed"), words.alias("mentions"))


def scored(answers: DataFrame) -> DataFrame:
    """Adds ``passed`` for cases (cited, top, expect_top, answer, expect_missing)."""
    top = ~F.col("expect_top") | F.arrays_overlap("cited", "top")
    admits = ~F.col("expect_missing") | F.col("answer").rlike("(?i)" + ADMITS)
    return answers.withColumn("passed", F.coalesce(top & admits, F.lit(False)))
