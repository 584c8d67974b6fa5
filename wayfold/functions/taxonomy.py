"""Page classification: overrides, then exact domains, host and path rules, and words of title and query."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayfold.functions import urls
from wayfold.functions.text import tokenize
from wayfold.functions.urls import Parts


@dataclass(frozen=True)
class Rule:
    """hosts match themselves and their subdomains; starts and contains look at the path; all that is given must hold."""

    name: str
    category: str
    page: str
    interaction: str
    pack: str = "global-core"
    hosts: Sequence[str] = ()
    starts: Sequence[str] = ()
    contains: Sequence[str] = ()
    segments: int = 0
    query_key: str = ""
    words: Sequence[str] = ()


def _searches(*domains: str) -> tuple[Rule, ...]:
    return tuple(Rule(f"{d.split('.')[0]}-search", "search", "search_results", "discover", hosts=(d,)) for d in domains)


#: Rules of all packs in order of evaluation; fixed values. Exact domains are compared with the registrable domain.
EXACT_RULES = (
    *_searches("baidu.com", "bing.com", "brave.com", "duckduckgo.com", "google.com", "sogou.com", "so.com", "yahoo.com", "yandex.ru"),
    Rule("bilibili-video", "video", "video_page", "watch", "cn-core", ("bilibili.com",)),
    Rule("zhihu-community", "community", "forum_thread", "discuss", "cn-core", ("zhihu.com",)),
    Rule("linkedin-social", "social", "profile", "manage", "us-core", ("linkedin.com",)),
    Rule("x-social", "social", "profile", "discuss", "us-core", ("x.com",)),
)
PATH_RULES = (
    Rule("github-issue", "developer", "issue", "resolve", hosts=("github.com", "gitlab.com"), contains=("/issues/",)),
    Rule("github-pull-request", "developer", "pull_request", "resolve", hosts=("github.com", "gitlab.com"), contains=("/pull/", "/merge_requests/")),
    Rule("github-repo", "developer", "repo", "resolve", hosts=("github.com", "gitlab.com"), segments=2),
    Rule("developer-docs", "docs", "docs_page", "learn", hosts=("developer.mozilla.org", "devdocs.io")),
    Rule("docs-path", "docs", "docs_page", "learn", starts=("/docs", "/doc", "/reference", "/api", "/guide", "/guides")),
    Rule("community-thread", "community", "forum_thread", "discuss", hosts=("reddit.com", "stackoverflow.com", "news.ycombinator.com"), contains=("/questions/", "/comments/", "/forum", "/discuss")),
    Rule("video-watch", "video", "video_page", "watch", hosts=("youtube.com", "youtu.be", "vimeo.com"), starts=("/watch",), query_key="v"),
    Rule("ai-chat", "ai", "dashboard", "manage", hosts=("chat.openai.com", "claude.ai", "gemini.google.com", "chat.deepseek.com")),
    Rule("taobao-product", "shopping", "product_page", "compare", "cn-core", ("taobao.com", "tmall.com", "jd.com"), ("/item", "/product", "/dp"), ("/item", "/product")),
    Rule("juejin-article", "developer", "article_page", "learn", "cn-core", ("juejin.cn", "csdn.net"), ("/post", "/article"), ("/article/",)),
    Rule("amazon-product", "shopping", "product_page", "compare", "us-core", ("amazon.com",), ("/dp", "/gp/product"), ("/dp/", "/gp/product/")),
    Rule("amazon-cart", "shopping", "dashboard", "transact", "us-core", ("amazon.com",), ("/cart", "/checkout"), ("/cart", "/checkout")),
    Rule("us-news-article", "news", "article_page", "learn", "us-core", ("nytimes.com", "wsj.com", "theverge.com", "cnn.com"), contains=("/article/", "/202", "/news/")),
)
WORD_RULES = (
    Rule("docs-lexicon", "docs", "docs_page", "learn", words=("docs", "documentation", "reference", "guide", "guides", "api", "文档", "文檔", "教程", "教學")),
    Rule("compare-lexicon", "shopping", "category_page", "compare", words=("compare", "comparison", "versus", "vs", "pricing", "plans", "价格", "價格", "比较", "比較", "对比", "對比")),
    Rule("forum-lexicon", "community", "forum_thread", "discuss", words=("forum", "discussion", "thread", "问答", "問答", "讨论", "討論")),
    Rule("article-lexicon", "news", "article_page", "learn", words=("article", "blog", "newsletter", "news", "analysis")),
    Rule("cn-docs-lexicon", "docs", "docs_page", "learn", "cn-core", words=("文档", "文檔", "教程", "指南", "开发", "開發")),
    Rule("us-shopping-lexicon", "shopping", "category_page", "compare", "us-core", words=("pricing", "plan", "plans", "checkout", "coupon", "deal")),
)
PACKS = ("global-core", "cn-core", "us-core", "tw-core", "jp-core", "kr-core", "eu-core", "ru-core", "international-common")
#: Confidence by source of the decision.
OVERRIDE, EXACT, BY_RULE, BY_WORD = 1.0, 0.95, 0.86, 0.62


@dataclass(frozen=True)
class Override:
    """A user's own decision for a registrable domain, a host or a URL prefix (target: domain, host or prefix)."""

    target: str
    value: str
    category: str
    page: str = "unknown"
    interaction: str = "unknown"
    engine: str | None = None
    display_name: str | None = None


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def under(host: Column, suffix: str) -> Column:
    return (host == suffix) | F.endswith(host, F.lit(f".{suffix}"))


def matches(rule: Rule, u: Parts) -> Column:
    """Whether a host and path rule holds; path and query keys are compared in lower case."""
    low, parts = F.lower(u.path), []
    if rule.hosts:
        parts.append(_any([under(u.host, h) for h in rule.hosts]))
    if rule.starts:
        parts.append(_any([F.startswith(low, F.lit(p)) for p in rule.starts]))
    if rule.contains:
        parts.append(_any([F.contains(low, F.lit(p)) for p in rule.contains]))
    if rule.segments:
        parts.append(F.size(F.filter(F.split(low, "/"), lambda s: s != "")) >= rule.segments)
    if rule.query_key:
        parts.append(F.exists(u.kept, lambda p: F.lower(p.key) == rule.query_key))
    return reduce(lambda a, b: a & b, parts)


def overridden(o: Override, u: Parts) -> Column:
    return {"domain": u.domain == o.value, "host": u.host == o.value, "prefix": F.startswith(u.url, F.lit(o.value))}[o.target]


def classify(url: Column | Parts, text: Column, overrides: Sequence[Override] = ()) -> Column:
    """struct(category, page, interaction, confidence, source, pack, rule): one CASE in order of precedence.

    text is the title and the query. Overrides come first, then all packs' exact domains, then all
    their host and path rules, then all their words, which match anywhere in the lower-cased text.
    """
    u, low = urls.parse(url), F.lower(F.coalesce(text, F.lit("")))

    def decided(category: str, page: str, interaction: str, confidence: float, source: str, pack: str | None, rule: str | None) -> Column:
        named = {"category": category, "page": page, "interaction": interaction, "source": source, "pack": pack, "rule": rule}
        texts = ", ".join(f"'{k}', {'cast(null AS string)' if v is None else repr(v)}" for k, v in named.items())
        return F.expr(f"named_struct({texts}, 'confidence', double({confidence}))")

    cases = [(overridden(o, u), decided(o.category, o.page, o.interaction, OVERRIDE, "user-override", "user-override", o.value)) for o in overrides]
    cases += [(u.domain == r.hosts[0], decided(r.category, r.page, r.interaction, EXACT, "exact-domain-rule", r.pack, r.name)) for r in EXACT_RULES]
    cases += [((u.host != "") & matches(r, u), decided(r.category, r.page, r.interaction, BY_RULE, "host-path-rule", r.pack, r.name)) for r in PATH_RULES]
    cases += [(_any([F.contains(low, F.lit(w)) for w in r.words]), decided(r.category, r.page, r.interaction, BY_WORD, "lexicon-rule", r.pack, r.name)) for r in WORD_RULES]
    out = F.when(*cases[0])
    for c, v in cases[1:]:
        out = out.when(c, v)
    return out.otherwise(decided("unknown", "unknown", "unknown", 0.0, "unknown", None, None))


def evidence_tier(url: Column | Parts, title: Column, has_term: Column, referrer: Column, from_visit: Column) -> Column:
    """tier-a: a search term, a result page or a way here; tier-b: a path, parameters or a title that says something; else tier-c."""
    u = urls.parse(url)
    strong = has_term | urls.search_query(u).isNotNull() | referrer.isNotNull() | from_visit.isNotNull()
    some = ((u.host != "") & ((u.path != "/") | (F.size(u.kept) > 0))) | (F.size(tokenize(F.coalesce(title, F.lit("")))) > 0)
    return F.when(strong, "tier-a").when(some, "tier-b").otherwise("tier-c")
