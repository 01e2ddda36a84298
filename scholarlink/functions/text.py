"""Addresses in text: undoing disguises, finding, filtering and quoting them; text of pages and documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as an address, as a role account, as a personal mail provider, as a file name.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
ROLES = "info|contact|contactus|inquir|enquir|sales|pr|press|ir|hr|recruit|career|office|admin|webmaster|help|support|biz|business|editor|editorial|journal|permissions|privacy|legal|marketing|service|services|customer|abuse|postmaster|noreply|no-reply|donotreply|example|test"
PROVIDERS = "gmail|naver|daum|hanmail|kakao|outlook|hotmail|yahoo|proton|qq|163|126|live|icloud|nate"
ASSETS = "png|jpg|jpeg|gif|svg|js|css|webp"
# Hosts that usually serve a document, publishers that often do not, words of pages made for robots.
OPEN_HOSTS = r"arxiv\.org|europepmc\.org|ncbi\.nlm\.nih\.gov|koreascience|\.ac\.kr|\.edu(/|$)|\.ac\.uk|\.ac\.jp|biorxiv|medrxiv|osti\.gov|hal\.science|zenodo|core\.ac\.uk|semanticscholar|openreview|aclanthology|thecvf|ieeexplore\.ieee\.org/(ielx|stampPDF)|dspace|repository|scholarworks|s-space|dcollection"
PUBLISHERS = r"mdpi\.com|wiley\.com|sciencedirect|elsevier|springer|nature\.com|tandfonline|acs\.org|sagepub|frontiersin|iop\.org|rsc\.org|pubs\.|cell\.com|jstage"
ROBOT_PAGE = "captcha|are you a robot|access denied|just a moment|enable javascript and cookies"
DEPARTMENT = "enquir|inquir|info|office|admin|contact|webmaster|support|general|dept|department"
# How names share a host in braces, where a link to an address stands, what of a page is no text.
BRACES = r"(?U)\{([^{}]{1,120})\}\s*@\s*([A-Za-z0-9.-]+\.[A-Za-z]{2,})"
MAILTO = r"(?i)href=[\"']mailto:([^\"'?]+)"
NO_TEXT, TAG = r"(?is)<script.*?</script>|<style.*?</style>", "<[^>]+>"
# Limits of what is read, in characters, and the width of quotes to each side.
PAGE_LIMIT, ROBOT_LIMIT, HEAD, QUOTE = 2_000_000, 20_000, 8_000, 70


def may_hold_address(text: Column) -> Column:
    """A cheap test that text without any address, plain or disguised, fails."""
    return text.contains("@") | text.rlike(r"(?U)\sAT\s") | text.contains("%40") | text.contains("&#64;") | text.rlike(r"(?i)[\[({]\s*at\s*[\])}]")


def deobfuscate(text: Column) -> Column:
    """Addresses written with [at], (dot), AT, DOT, %40 or character references, put back."""
    t = F.replace(F.replace(F.replace(text, F.lit("%40"), F.lit("@")), F.lit("&#64;"), F.lit("@")), F.lit("&#46;"), F.lit("."))
    for word, sign in (("at", "@"), ("dot", ".")):
        t = F.regexp_replace(t, rf"(?i)(?U)\s*[\[({{]\s*{word}\s*[\])}}]\s*", sign)
    t = F.regexp_replace(t, r"(?U)(?<=[A-Za-z0-9])\s+AT\s+(?=[A-Za-z0-9])", "@")
    return F.regexp_replace(t, r"(?U)(?<=[A-Za-z0-9])\s+DOT\s+(?=[A-Za-z]{2,})", ".")


def is_generic(local: Column) -> Column:
    """An account of a role rather than a person: its name begins with a role word."""
    return local.rlike(f"(?i)^({ROLES})")


def is_personal_mail(domain: Column) -> Column:
    """A domain with the name of a personal mail provider before a dot."""
    return F.concat(domain, F.lit(".")).rlike(rf"(?i)({PROVIDERS})\.")


def extract_emails(text: Column) -> Column:
    """Distinct addresses in order, lower case, without role accounts and names of files."""
    found = F.transform(F.regexp_extract_all(deobfuscate(text), F.lit(EMAIL), F.lit(0)), lambda e: F.lower(F.btrim(e, F.lit("."))))
    return F.array_distinct(F.filter(found, lambda e: ~is_generic(e) & ~e.rlike(rf"\.({ASSETS})$")))


def expand_braces(text: Column) -> Column:
    """Text with a line `a@host` added for every name in a group {a, b}@host."""
    names, hosts = F.regexp_extract_all(text, F.lit(BRACES), F.lit(1)), F.regexp_extract_all(text, F.lit(BRACES), F.lit(2))
    each = F.zip_with(names, hosts, lambda n, h: F.transform(F.filter(F.split(n, r"(?U)[,\s;]+"), lambda x: x != ""), lambda x: F.concat(x, F.lit("@"), h)))
    return F.array_join(F.concat(F.array(text), F.flatten(each)), "\n")


def mailto_targets(html: Column, whole: bool = True) -> Column:
    """Targets of mailto links; with `whole` those that are an address throughout, with disguises undone."""
    found = F.transform(F.regexp_extract_all(html, F.lit(MAILTO), F.lit(1)), F.lower if not whole else lambda x: F.lower(deobfuscate(x)))
    return F.array_distinct(F.filter(found, lambda x: x.rlike(f"^(?:{EMAIL})$")) if whole else found)


def strip_tags(html: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(html, NO_TEXT, " "), TAG, " ")


def page_text(html: Column) -> Column:
    """Text of a page: cut to its limit, without scripts, styles and tags, blanks collapsed, disguises undone."""
    return F.regexp_replace(deobfuscate(strip_tags(F.substring(html, 1, PAGE_LIMIT))), r"(?U)\s+", " ")


def page_emails(html: Column) -> Column:
    """Addresses of a page: link targets first, then those in its text."""
    return F.array_distinct(F.concat(mailto_targets(html), extract_emails(page_text(html))))


def plain_page_text(html: Column) -> Column:
    """Text of a person's or a domain's own page: as page_text(), but disguises stay."""
    return F.regexp_replace(strip_tags(F.substring(html, 1, PAGE_LIMIT)), r"(?U)\s+", " ")


def is_page(status: Column, content_type: Column) -> Column:
    return F.coalesce((status == 200) & F.lower(content_type).contains("html"), F.lit(False))


def home_page_emails(status: Column, content_type: Column, html: Column) -> Column:
    """Addresses of a person's own page: all link targets, unfiltered, then those in its text; none unless it was read as HTML."""
    found = F.array_distinct(F.concat(mailto_targets(F.substring(html, 1, PAGE_LIMIT), whole=False), extract_emails(plain_page_text(html))))
    return F.when(is_page(status, content_type), found).otherwise(F.array().cast("array<string>"))


def page_head(html: Column) -> Column:
    """The part of an own page's text that attribution and names are looked for in."""
    return F.substring(plain_page_text(html), 1, HEAD)


def is_department(local: Column) -> Column:
    """An account of an office or a department, as home pages show them: the words count anywhere."""
    return is_generic(local) | local.rlike(f"(?i)({DEPARTMENT})")


def is_robot_page(html: Column) -> Column:
    return F.substring(html, 1, ROBOT_LIMIT).rlike(f"(?i){ROBOT_PAGE}")


def snippet(text: Column, needle: Column, width: int = QUOTE) -> Column:
    """What stands around the first place of needle in text, in any case, without tags; empty if it isn't there."""
    at = F.instr(F.lower(text), F.lower(needle))
    start = F.greatest(at - width, F.lit(1))
    around = F.substring(text, start, F.length(needle) + width + at - start)
    return F.when(at == 0, "").otherwise(F.btrim(F.regexp_replace(F.regexp_replace(around, "<[^>]+>", " "), r"(?U)\s+", " ")))


def host_rank(url: Column) -> Column:
    """0 for hosts that usually serve documents, 2 for publishers, 1 for the rest."""
    return F.when(url.rlike(f"(?i){OPEN_HOSTS}"), 0).when(url.rlike(f"(?i){PUBLISHERS}"), 2).otherwise(1)


def outcome(status: Column, content_type: Column, size: Column, html: Column, emails: Column) -> Column:
    """How reading a document ended."""
    kind = F.lower(content_type)
    return (
        F.when(status != 200, F.concat(F.lit("http "), status.cast("string")))
        .when(kind.contains("html") & is_robot_page(html), "robot page")
        .when(kind.contains("html") & (F.size(emails) == 0), "not a pdf")
        .when(~kind.contains("html") & ~kind.contains("pdf"), "not a pdf")
        .when(~kind.contains("html") & (size > 12_000_000), "too large")
        .when(F.size(emails) > 0, "addresses")
        .otherwise("no address")
    )
