"""What a page's HTML tells in short: title, description, preview image, plain text. Plain expressions; the article is another matter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayfold.functions import urls

#: Tags of preview images in order; fixed values.
IMAGE_TAGS = (("property", "og:image:secure_url"), ("property", "og:image"), ("name", "twitter:image"), ("name", "twitter:image:src"))
#: References that are decoded in short texts.
REFERENCES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))
SNIPPET = 280


def unescape(c: Column) -> Column:
    for a, b in REFERENCES:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def title(html: Column) -> Column:
    """The title, one line; null if there is none."""
    return F.nullif(F.trim(F.regexp_replace(unescape(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), r"\s+", " ")), F.lit(""))


def meta(html: Column, attribute: str, name: str) -> Column:
    """The content of the first meta element of that name, its attributes in either order; null if it is empty or missing."""
    tag = F.regexp_extract(html, rf"(?is)(<meta\b[^>]*\b{attribute}\s*=\s*[\"']{name}[\"'][^>]*>)", 1)
    return F.nullif(F.trim(unescape(F.regexp_extract(tag, r"(?is)\bcontent\s*=\s*[\"']([^\"']*)[\"']", 1))), F.lit(""))


def absolute(link: Column, base: Column) -> Column:
    """A link of a page as an absolute URL; null unless it becomes http or https."""
    origin = F.concat(urls.scheme(base), F.lit("://"), F.regexp_extract(base, r"^[^:]+://([^/?#]*)", 1))
    folder = F.regexp_replace(urls.path(base), r"[^/]*$", "")
    made = (
        F.when(link.rlike(r"(?i)^https?://"), link)
        .when(F.startswith(link, F.lit("//")), F.concat(urls.scheme(base), F.lit(":"), link))
        .when(F.startswith(link, F.lit("/")), F.concat(origin, link))
        .when((link != "") & ~link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.concat(origin, folder, link))
    )
    return F.when(urls.host(base) != "", made)


def preview_image(html: Column, url: Column) -> Column:
    """The first preview image that the page names, else the one that follows from a video's URL."""
    named = F.coalesce(*[absolute(meta(html, a, n), url) for a, n in IMAGE_TAGS])
    video = F.when(urls.registrable_domain(urls.host(url)) == "youtube.com", F.nullif(F.regexp_extract(url, r"[?&]v=([\w-]{5,})", 1), F.lit("")))
    short = F.when(urls.host(url) == "youtu.be", F.nullif(F.regexp_extract(urls.path(url), r"^/([\w-]{5,})", 1), F.lit("")))
    return F.coalesce(named, F.concat(F.lit("https://i.ytimg.com/vi/"), F.coalesce(video, short), F.lit("/hqdefault.jpg")))


def plain_text(html: Column) -> Column:
    """All text without scripts, styles and tags, on one line."""
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style|noscript|template)\b.*?</\1\s*>", " "), r"(?s)<!--.*?-->|<[^>]*>", " ")
    return F.trim(F.regexp_replace(unescape(bare), r"\s+", " "))


def summary(html: Column) -> Column:
    """The description that the page gives, else the beginning of its text."""
    given = F.coalesce(meta(html, "name", "description"), meta(html, "property", "og:description"), F.nullif(plain_text(html), F.lit("")))
    return F.when(F.char_length(given) <= SNIPPET, given).otherwise(F.concat(F.rtrim(F.substring(given, 1, SNIPPET)), F.lit("…")))
