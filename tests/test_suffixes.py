"""Public-suffix rules of each kind, and what is kept where none fits."""

from wayfold.operators import suffixes

RULES = ["// comment", "", "com", "ck", "*.ck", "!www.ck", "co.uk", "uk", "blogspot.com", "*.compute.example.com", "kobe.jp", "*.kobe.jp", "!city.kobe.jp", "jp", "COM"]
CASES = {
    "a.b.example.org": "example.org", "www.example.com": "example.com", "com": "com", "x.y.co.uk": "y.co.uk", "co.uk": "co.uk", "me.blogspot.com": "me.blogspot.com", "x.me.blogspot.com": "me.blogspot.com", "blogspot.com": "blogspot.com",
    "a.b.ck": "a.b.ck", "x.a.b.ck": "a.b.ck", "b.ck": "b.ck", "www.ck": "www.ck", "x.www.ck": "www.ck", "city.kobe.jp": "city.kobe.jp", "a.city.kobe.jp": "city.kobe.jp", "a.b.kobe.jp": "a.b.kobe.jp", "z.a.b.kobe.jp": "a.b.kobe.jp",
    "v.m.compute.example.com": "v.m.compute.example.com", "m.compute.example.com": "example.com", "intranet": "intranet", "WWW.Example.COM.": "example.com", "a.b.co.jp": "b.co.jp", "": "", None: None,
}


def test_rules(spark):
    rules = spark.createDataFrame([(r,) for r in RULES], "rule string")
    hosts = spark.createDataFrame([(i, h, "x") for i, h in enumerate(CASES)], "id int, host string, tail string")
    got = suffixes.with_domains(hosts, rules)
    assert got.columns == ["id", "host", "tail", "domain"] and {r.host: r.domain for r in got.collect()} == CASES
    plain = suffixes.with_domains(hosts, rules.limit(0)).where("host = 'x.a.b.ck'").first()
    assert plain.domain == "b.ck" and suffixes.with_domains(hosts.limit(0), rules).count() == 0
