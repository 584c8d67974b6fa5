"""Text expressions: query normalisation, tokens, similarity."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from wayfold.functions import urls

#: Words that carry no topic, in queries and in titles; fixed values.
STOP_WORDS = ("a", "an", "and", "com", "edu", "for", "from", "how", "html", "http", "https", "in", "is", "net", "of", "on", "org", "the", "to", "what", "when", "where", "with", "www")
TITLE_STOP_WORDS = ("the", "and", "for", "that", "with", "from", "into", "this", "your", "what", "how", "why", "when", "where", "about", "http", "https", "www", "com", "org", "net", "html")
#: Scripts that are cut into runs and pairs; kana, ideographs, Hangul. HAN are those that search cuts into grams.
CJK = r"\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uac00-\ud7af\uf900-\ufaff"
HAN = r"\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\x{20000}-\x{2ebef}\x{30000}-\x{3134f}"
_WORDS = r"\p{IsAlphabetic}\p{N}"


def normalize_query(q: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(q, r"\s+", " ")))


def query_terms(q: Column) -> Column:
    """Lower-cased words of letters and digits without stop words, repeats kept."""
    return F.filter(F.split(F.lower(q), rf"[^{_WORDS}{CJK}]+"), lambda w: (w != "") & ~w.isin(*STOP_WORDS))


def _windows(run: Column, size: int) -> Column:
    n = F.char_length(run) - (size - 1)
    return F.when(n < 1, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(run, i, size)))


def windows(size: int):
    """The function that gives all parts of so many characters of a string."""
    return lambda run: _windows(run, size)


def tokenize(text: Column) -> Column:
    """Words of two bytes and more without stop words; runs of CJK scripts whole and in pairs. In order, repeats kept."""
    parts = F.regexp_extract_all(text, F.lit(rf"[{CJK}]+|[{_WORDS}&&[^{CJK}]]+"), F.lit(0))
    run = lambda p: F.when(F.char_length(p) == 1, F.array(p)).otherwise(F.concat(F.array(p), _windows(p, 2)))
    word = lambda p: F.when((F.octet_length(p) > 1) & ~p.isin(*TITLE_STOP_WORDS), F.array(p)).otherwise(F.array().cast("array<string>"))
    return F.flatten(F.transform(parts, lambda p: F.when(p.rlike(rf"^[{CJK}]"), run(p)).otherwise(word(F.lower(p)))))


def normalize_text(text: Column) -> Column:
    """Compatibility-composed lower case without null characters, as documents and queries are indexed."""


    @F.arrow_udf("string")
    def nfkc(texts: pa.Array) -> pa.Array:
        return pc.utf8_normalize(texts, form="NFKC")

    return F.lower(nfkc(F.replace(F.coalesce(text, F.lit("")), F.lit("\0"), F.lit(""))))


def compact(text: Column) -> Column:
    """Letters and digits only."""
    return F.regexp_replace(text, rf"[^{_WORDS}]+", "")


def han_grams(text: Column) -> Column:
    """The distinct pairs and triples of runs of ideographs, sorted."""
    runs = F.regexp_extract_all(text, F.lit(rf"[{HAN}]+"), F.lit(0))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(runs, lambda r: F.concat(_windows(r, 2), _windows(r, 3))))))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / F.size(F.array_union(a, b)))


def trigrams(s: Column) -> Column:
    """The distinct three-character windows of a string; none below three characters."""
    n = F.char_length(s)
    return F.when(n < 3, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.substring(s, i, 3))))


def allowed_edits(length: Column) -> Column:
    """Edits a fuzzy match may have: none up to 3 characters, then 1, 2, 3 and 4 from 4, 6, 10 and 17 on."""
    return F.when(length <= 3, 0).when(length <= 5, 1).when(length <= 9, 2).when(length <= 16, 3).otherwise(4)


def bounded_distance(a: Column, b: Column) -> Column:
    """Edit distance, or null beyond what b's length allows."""
    d = F.levenshtein(a, b, 4)  # -1 beyond the most that any length allows
    return F.when((d >= 0) & (d <= allowed_edits(F.char_length(b))), d)


def content_hash(canonical: Column, title: Column, enrichment: Column) -> Column:
    """Key of a page's content for embedding reuse."""
    parts = F.concat_ws("\n", F.lit("dedup/v1"), *[F.concat(F.lit(f"{n}="), F.coalesce(c, F.lit(""))) for n, c in (("canonical", canonical), ("title", title), ("enrichment", enrichment))])
    return F.sha2(parts, 256)


def chrome_ms(us: Column) -> Column:
    """Microseconds since 1601 as clamped Unix milliseconds, floored."""
    return clamp_ms(F.floor((us - 11644473600000000) / 1000))


def firefox_ms(us: Column) -> Column:
    return clamp_ms(F.floor(us / 1000))


def safari_ms(s: Column) -> Column:
    """Real seconds since 2001; what isn't finite is 0, halves round away from zero."""
    finite = ~(F.isnan(s) | s.isin(float("inf"), float("-inf")))
    return clamp_ms(F.when(finite, F.round((s + 978307200.0) * 1000).cast("long")).otherwise(0))


def clamp_ms(ms: Column) -> Column:
    return F.least(F.greatest(ms.cast("long"), F.lit(0).cast("long")), F.lit(253402300799999))


def content_key(hashed: Column) -> Column:
    """The first 64 bits of a content hash, as 16 hex digits: they sort like the unsigned number."""
    return F.substring(hashed, 1, 16)


def query_kind(raw: Column, landing_domain: Column) -> Column:
    """navigational if the query is empty or names the domain that it led to (or any domain, if it led nowhere); else keyword."""
    asked = F.regexp_replace(F.regexp_replace(F.trim(raw), '^"+|"+$', ""), "^'+|'+$", "")
    given = F.when(asked.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), asked).when(F.contains(asked, F.lit(".")), F.concat(F.lit("https://"), asked))
    host = F.when((asked != "") & ~asked.rlike(r"\s"), urls.host(given))
    domain = F.when(host != "", urls.registrable_domain(host))
    same = landing_domain.isNull() | (landing_domain == domain) | F.endswith(landing_domain, F.concat(F.lit("."), domain)) | F.endswith(domain, F.concat(F.lit("."), landing_domain))
    return F.when((normalize_query(raw) == "") | (domain.isNotNull() & same), "navigational").otherwise("keyword")


def excerpt(text: Column, most: int = 180) -> Column:
    """A text of at most so many characters for lists; a longer one is cut and ends in an ellipsis, a blank one is null."""
    cut = F.trim(text)
    return F.when(F.char_length(cut) <= most, F.nullif(cut, F.lit(""))).otherwise(F.concat(F.rtrim(F.substring(cut, 1, most)), F.lit("…")))


def enrichment_text(summary: Column, metadata: Column) -> Column:
    """Summary and the metadata's name, description, language and topics, each once, joined by bullets."""
    given = F.from_json(metadata, "fullName string, description string, language string, topics array<string>")
    topics = F.array_join(F.coalesce(given.topics, F.array().cast("array<string>")), " ")
    parts = F.transform(F.array(summary, given.fullName, given.description, given.language, topics), lambda p: F.trim(p))
    return F.array_join(F.array_distinct(F.filter(parts, lambda p: p.isNotNull() & (p != ""))), " • ")


def embedding_content(profile: Column, url: Column, title: Column, visited_at: Column, readable_title: Column, summary: Column, text: Column, most: int = 512 * 4) -> Column:
    """What a page is embedded by: labelled lines, then its readable text cut to so many characters."""
    filled = lambda c: F.nullif(F.trim(c), F.lit(""))
    line = lambda name, c: F.concat(F.lit(f"{name}: "), c)
    body = F.concat(F.lit("Readable text:\n"), F.when(F.char_length(filled(text)) <= most, filled(text)).otherwise(F.rtrim(F.substring(filled(text), 1, most))))
    lines = [line("Profile", profile), line("Visited at", visited_at), line("URL", url), line("Domain", urls.host(url)), line("Title", F.coalesce(title, F.lit("(untitled)")))]
    return F.concat_ws("\n", *lines, line("Readable title", filled(readable_title)), line("Summary", filled(summary)), body)
