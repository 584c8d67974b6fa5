"""Search engines and sites: rules that read a query from a URL, engine ids, display names."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayfold.functions import urls
from wayfold.functions.taxonomy import under
from wayfold.functions.text import normalize_query
from wayfold.functions.urls import Parts


@dataclass(frozen=True)
class SearchRule:
    """A host (or a domain above it) and a path prefix whose URLs hold the query in a parameter."""

    engine: str
    name: str
    host: str
    prefix: str | None
    key: str
    enabled: bool = True


#: Built-in rules in order; fixed values.
SEARCH_RULES = (
    SearchRule("google", "Google", "google.com", "/search", "q"),
    SearchRule("bing", "Bing", "bing.com", "/search", "q"),
    SearchRule("duckduckgo", "DuckDuckGo", "duckduckgo.com", None, "q"),
    SearchRule("brave", "Brave Search", "search.brave.com", "/search", "q"),
    SearchRule("baidu", "Baidu", "baidu.com", "/s", "wd"),
    SearchRule("sogou", "Sogou", "sogou.com", "/web", "query"),
    SearchRule("so", "360 Search", "so.com", "/s", "q"),
    SearchRule("yahoo", "Yahoo", "yahoo.com", "/search", "p"),
    SearchRule("yandex", "Yandex", "yandex.ru", "/search", "text"),
    SearchRule("youtube", "YouTube", "youtube.com", "/results", "search_query"),
    SearchRule("bilibili", "BiliBili", "search.bilibili.com", "/all", "keyword"),
    SearchRule("github", "GitHub", "github.com", "/search", "q"),
    SearchRule("reddit", "Reddit", "reddit.com", "/search", "q"),
    SearchRule("zhihu", "Zhihu", "zhihu.com", "/search", "q"),
    SearchRule("taobao", "Taobao", "taobao.com", "/search", "q"),
    SearchRule("amazon", "Amazon", "amazon.com", "/s", "k"),
)
#: Engine of a registrable domain; fixed values. brave.com only at search.brave.com.
ENGINE_IDS = {
    "baidu.com": "baidu", "bing.com": "bing", "duckduckgo.com": "duckduckgo", "google.com": "google", "sogou.com": "sogou", "so.com": "so", "yahoo.com": "yahoo",
    "yandex.ru": "yandex", "reddit.com": "reddit", "youtube.com": "youtube", "bilibili.com": "bilibili", "github.com": "github", "amazon.com": "amazon", "taobao.com": "taobao",
    "zhihu.com": "zhihu", "ecosia.org": "ecosia", "startpage.com": "startpage", "perplexity.ai": "perplexity", "wolframalpha.com": "wolfram",
}
#: Names of engines and of sites; fixed values.
ENGINE_NAMES = {
    "amazon": "Amazon", "baidu": "Baidu", "bilibili": "BiliBili", "bing": "Bing", "brave": "Brave Search", "duckduckgo": "DuckDuckGo", "ecosia": "Ecosia", "github": "GitHub",
    "google": "Google", "perplexity": "Perplexity", "reddit": "Reddit", "searx": "SearX", "sogou": "Sogou", "so": "360 Search", "startpage": "Startpage", "taobao": "Taobao",
    "wolfram": "Wolfram Alpha", "youtube": "YouTube", "yahoo": "Yahoo", "yandex": "Yandex", "zhihu": "Zhihu",
}
SITE_NAMES = {
    "github.com": "GitHub", "gitlab.com": "GitLab", "stackoverflow.com": "Stack Overflow", "npmjs.com": "npm", "crates.io": "crates.io", "docs.rs": "docs.rs",
    "developer.mozilla.org": "MDN", "mozilla.org": "MDN", "w3schools.com": "W3Schools", "codepen.io": "CodePen", "vercel.com": "Vercel", "netlify.com": "Netlify",
    "heroku.com": "Heroku", "docker.com": "Docker", "kubernetes.io": "Kubernetes", "pypi.org": "PyPI", "rubygems.org": "RubyGems", "bitbucket.org": "Bitbucket", "sqlite.org": "SQLite",
    "reddit.com": "Reddit", "twitter.com": "X (Twitter)", "x.com": "X (Twitter)", "facebook.com": "Facebook", "instagram.com": "Instagram", "linkedin.com": "LinkedIn",
    "discord.com": "Discord", "slack.com": "Slack", "mastodon.social": "Mastodon", "threads.net": "Threads", "pinterest.com": "Pinterest", "tumblr.com": "Tumblr",
    "wikipedia.org": "Wikipedia", "medium.com": "Medium", "substack.com": "Substack", "quora.com": "Quora", "zhihu.com": "知乎", "notion.so": "Notion", "obsidian.md": "Obsidian",
    "wikimedia.org": "Wikimedia", "google.com": "Google", "bing.com": "Bing", "duckduckgo.com": "DuckDuckGo", "brave.com": "Brave", "yahoo.com": "Yahoo", "yandex.ru": "Yandex",
    "ecosia.org": "Ecosia", "startpage.com": "Startpage", "youtube.com": "YouTube", "bilibili.com": "BiliBili", "twitch.tv": "Twitch", "netflix.com": "Netflix",
    "spotify.com": "Spotify", "vimeo.com": "Vimeo", "douyin.com": "抖音", "iqiyi.com": "iQIYI", "soundcloud.com": "SoundCloud", "disneyplus.com": "Disney+", "amazon.com": "Amazon",
    "ebay.com": "eBay", "taobao.com": "淘寶", "jd.com": "京東", "shopify.com": "Shopify", "etsy.com": "Etsy", "aliexpress.com": "AliExpress", "walmart.com": "Walmart", "cnn.com": "CNN",
    "bbc.com": "BBC", "bbc.co.uk": "BBC", "nytimes.com": "NYT", "theguardian.com": "The Guardian", "reuters.com": "Reuters", "news.ycombinator.com": "Hacker News",
    "ycombinator.com": "Hacker News", "washingtonpost.com": "Washington Post", "apnews.com": "AP News", "openai.com": "OpenAI", "anthropic.com": "Anthropic",
    "huggingface.co": "Hugging Face", "chatgpt.com": "ChatGPT", "claude.ai": "Claude", "gemini.google.com": "Gemini", "perplexity.ai": "Perplexity", "aws.amazon.com": "AWS",
    "cloud.google.com": "Google Cloud", "azure.microsoft.com": "Azure", "figma.com": "Figma", "canva.com": "Canva", "dropbox.com": "Dropbox", "drive.google.com": "Google Drive",
    "zoom.us": "Zoom", "atlassian.com": "Atlassian", "weibo.com": "微博", "csdn.net": "CSDN", "juejin.cn": "掘金", "segmentfault.com": "SegmentFault", "douban.com": "豆瓣",
    "xiaohongshu.com": "小紅書", "baidu.com": "百度", "tencent.com": "騰訊", "aliyun.com": "阿里雲", "sogou.com": "搜狗", "so.com": "360 Search", "bilibili.tv": "BiliBili",
    "zhipin.com": "BOSS直聘", "docs.google.com": "Google Docs", "office.com": "Microsoft Office", "apple.com": "Apple", "microsoft.com": "Microsoft", "archive.org": "Internet Archive",
    "producthunt.com": "Product Hunt", "trello.com": "Trello", "airtable.com": "Airtable", "stackoverflow.blog": "Stack Overflow Blog",
}
#: Engines of the day view: host without www., and the parameter of the query; fixed values.
DAY_ENGINES = {
    "google.com": "q", "bing.com": "q", "duckduckgo.com": "q", "kagi.com": "q", "startpage.com": "query", "ecosia.com": "q", "brave.com": "q", "search.brave.com": "q", "baidu.com": "wd",
    "yandex.com": "text", "yandex.ru": "text", "yahoo.com": "p", "search.yahoo.com": "p", "so.com": "q", "sogou.com": "query",
}


def lookup(names: dict[str, str], key: Column) -> Column:
    """A small fixed table as a map expression; null for what it lacks."""
    pairs = ", ".join(f"'{x}'" for x in chain.from_iterable(names.items()))
    return F.try_element_at(F.expr(f"map({pairs})"), key)


def search_rule(url: Column | Parts, rules: Sequence[SearchRule] = SEARCH_RULES) -> Column:
    """struct(engine, name, query) of the first enabled rule whose host and path fit; null if its parameter is empty or missing, whatever other rules say."""
    u = urls.parse(url)
    out = F.lit(None).cast("struct<engine:string,name:string,query:string>")
    for r in reversed([r for r in rules if r.enabled]):
        fits = under(u.host, r.host) | under(u.domain, r.host)
        fits = fits & F.startswith(u.path, F.lit(r.prefix)) if r.prefix else fits
        value = urls.query_value(u, r.key)
        found = F.when(value != "", F.struct(F.lit(r.engine).alias("engine"), F.lit(r.name).alias("name"), value.alias("query")))
        out = F.when(fits, found).otherwise(out)
    return out


def engine_id(url: Column | Parts) -> Column:
    """A stable id of an engine that no rule names: by domain, searx by host, else the host itself."""
    u = urls.parse(url)
    return F.coalesce(F.when((u.domain == "brave.com") & (u.host == "search.brave.com"), "brave"), lookup(ENGINE_IDS, u.domain), F.when(F.contains(u.host, F.lit("searx")), "searx"), u.host)


def site_name(domain: Column) -> Column:
    return lookup(SITE_NAMES, domain)


def engine_name(engine: Column) -> Column:
    return lookup(ENGINE_NAMES, engine)


def day_query(url: Column) -> Column:
    """The query that the day view shows: of a known engine's host, trimmed, of 1 to 120 bytes."""
    host = F.regexp_replace(urls.host(url), r"^www\.", "")
    value = F.trim(urls.query_value(url, lookup(DAY_ENGINES, host)))
    return F.when((value != "") & (F.octet_length(value) <= 120), value)


def search_of(url: Column | Parts, term: Column, rules: Sequence[SearchRule] = SEARCH_RULES) -> Column:
    """struct(query, engine, name): the archive's own term, else what a rule reads, else what the URL of a built-in engine tells."""
    u = urls.parse(url)
    return decided_search(u, term, search_rule(u, rules))


def decided_search(u: Parts, term: Column, ruled: Column) -> Column:
    query = F.coalesce(F.nullif(normalize_query(term), F.lit("")), normalize_query(ruled["query"]), urls.search_query(u))
    engine = F.coalesce(ruled["engine"], F.when(query.isNotNull() & (u.host != ""), engine_id(u)))
    return F.struct(query.alias("query"), engine.alias("engine"), F.coalesce(ruled["name"], site_name(u.domain)).alias("name"))
