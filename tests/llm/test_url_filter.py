import random
import re

from textlattice.llm import queries
from textlattice.llm import url_filter as U


def plain(url):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in queries.RULES if ("." + host).endswith("." + r.host) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.name), default=None)
    return (host, path, best.name if best else None, best.verdict if best else "allow")


def test_rules_are_those_of_the_contract(spark):
    contract = "block com/en/, allow example.com/en/7, allow net/de/, block example.net/de/8, block org/es/"
    assert [f"{r.verdict} {r.name}" for r in queries.RULES] == contract.split(", ")
    urls = ["http://x.net/de/1", "http://example.net/de/7", "http://example.net/de/8", "http://x.com/en/", "http://example.com/en/71", "http://org/es/"]
    got = U.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), queries.RULES)
    assert [x["verdict"] for x in got.orderBy("page_id").collect()] == ["allow", "allow", "block", "block", "allow", "block"]


def test_against_plain_rules(spark):
    r = random.Random(5)
    hosts = ["example.com", "EXAMPLE.com", "notexample.com", "a.example.com", "com", "example.net", "x.net", "net", "org", "a.b.org", "commons", "example.com:80", ""]
    paths = ["/en/", "/en/7", "/en/71/x", "/en", "/de/8?x", "/de/", "/de/9#y", "/es/a/b//c?d#e", "", "?en/", "/EN/"]
    urls = [f"{r.choice(['http', 'https', 'x'])}://{r.choice(hosts)}{r.choice(paths)}" for _ in range(600)]
    urls += [None, "", "no scheme/en/", "://com/en/", "a://b://com/en/", "http://com/en/\nnew", "http://com/en/" + "x" * 5000, "http://exämple.com/en/ü"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {x["page_id"]: tuple(x)[1:] for x in U.judge(pages, queries.RULES).collect()}
    assert got == {k: plain(u) for k, u in enumerate(urls)}
    assert U.judge(pages.limit(0), queries.RULES).collect() == []


def test_odd_rows(spark):
    rows = [(None, "http://com/en/", 1), (1, "http://com/en/", 2), (1, "http://com/en/", 3), (2, None, 4)]
    got = U.judge(spark.createDataFrame(rows, "page_id long, url string, host int"), queries.RULES)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(((i, *plain(u)) for i, u, _ in rows), key=repr)
    same = [U.Rule("block", "com", "/a/"), U.Rule("allow", "com", "/a/")]
    assert U.judge(spark.createDataFrame([(1, "x://com/a/")], "page_id long, url string"), same).first()["verdict"] == "block"


def test_globs_against_regex():
    globs = ["a*c", "**x", "*/y**", "abc", "*", "**", "a**b*c", "." + "ab*" * 30 + "**"]
    r = random.Random(2)
    texts = ["".join(r.choice("abcxy/.") for _ in range(r.randrange(12))).encode() for _ in range(500)] + [b"." + b"abz" * 30]
    got = U.GlobAutomaton(globs).matches(texts)
    for g, glob in enumerate(globs):
        rule = re.compile("".join(".*" if p == "**" else "[^/]*" if p == "*" else re.escape(p) for p in re.findall(r"\*\*|\*|[^*]", glob)))
        assert got[:, g].tolist() == [bool(rule.fullmatch(t.decode())) for t in texts]
