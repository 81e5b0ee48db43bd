import hashlib
import math
from collections import Counter

from llm.helpers import clashing

from siftstone.llm import queries, urls

RULES = queries.URL_RULES


def parts(url):
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    ends = [i for i in (rest.find(c) for c in "/?#") if i >= 0]
    host, rest = (rest[: min(ends)], rest[min(ends) :]) if ends else (rest, "")
    path = rest.split("?")[0].split("#")[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def rule_of(url):
    host, path = parts(url)
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def models(rows):
    """Counts of every order by brute force, for allowed and blocked urls that are not kept back."""
    aside = {i for i, _ in rows if hashlib.md5(str(i).encode()).hexdigest()[0] in "012"}
    counts = {v: [Counter() for _ in range(urls.ORDER + 1)] for v in ("allow", "block")}
    for i, url in rows:
        verdict = rule_of(url)[1]
        if verdict and i not in aside:
            text = urls.START * urls.ORDER + (url or "") + urls.END
            for j in range(urls.ORDER, len(text)):
                for k in range(urls.ORDER + 1):
                    counts[verdict][k][text[j - k : j + 1]] += 1
    return counts


def log_likelihood(counts, text):
    total = 0.0
    for j in range(urls.ORDER, len(text)):
        p = 1 / urls.ALPHABET
        for k in range(urls.ORDER + 1):
            context = text[j - k : j]
            seen = [(g, c) for g, c in counts[k].items() if g[:k] == context]
            if seen:
                p = (counts[k][text[j - k : j + 1]] + len(seen) * p) / (sum(c for _, c in seen) + len(seen))
        total += math.log(p)
    return total / (len(text) - urls.ORDER)


def test_scores_and_rules(spark):
    rows = [(i, f"https://{'good' if i % 2 else 'casino'}{i % 4}.example.{'com' if i % 2 else 'net'}/{'de' if i % 2 else 'es'}/{i}?q#x") for i in range(40)]
    rows += [(100, "http://WWW.Example.com/en/1"), (101, "http://example.com/en/"), (102, "http://example.org/de/good1"), (103, "http://casino2.example.org/es/"), (104, None), (105, "no scheme"), (106, "http://a.com"), (106, "http://a.com"), (107, "")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    found = urls.judge(clashing(pages), RULES).collect()
    assert len(found) == len(rows)
    counts, known = models(rows), dict(rows)
    for r in found:
        url = known[r["page_id"]]
        assert (r["host"], r["path"]) == parts(url)
        rule, verdict = rule_of(url)
        assert r["rule"] == rule and r["verdict"] == (verdict or r["verdict"]) and r["verdict"] in ("allow", "block")
        text = urls.START * urls.ORDER + (url or "") + urls.END
        assert abs(r["score"] - (log_likelihood(counts["allow"], text) - log_likelihood(counts["block"], text))) < 1e-6
    verdicts = {r["page_id"]: r["verdict"] for r in found}
    assert verdicts[102] == "allow" and verdicts[103] == "block"


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "page_id long, url string")
    assert urls.judge(empty, RULES).count() == 0
    unlabelled = spark.createDataFrame([(1, "http://x.org/"), (None, None), (2, "u" * 20_000)], "page_id long, url string")
    assert {r["verdict"] for r in urls.judge(unlabelled, RULES).collect()} == {"allow"}


def test_path_needs_its_slash(spark):
    pages = spark.createDataFrame([(1, "http://a.com"), (2, "http://a.com/"), (3, "http://notcom/"), (4, "http://com/x")], "page_id long, url string")
    assert {r["page_id"]: r["rule"] for r in urls.judge(pages, RULES).collect()} == {1: None, 2: "com/", 3: None, 4: "com/"}


def test_urls_that_hold_the_end_mark(spark):
    """One row comes back for each row, also where a url holds the characters that stand for its start and end."""
    rows = [(i, f"http://{'good' if i % 2 else 'casino'}{i}.example.{'com' if i % 2 else 'net'}/{i}") for i in range(20)]
    rows += [(30, "http://a.com/\x03b"), (31, "\x03"), (32, "http://a.com/\x03\x03\x03"), (33, "http://a.com/\x02\x03"), (33, "http://a.com/\x02\x03"), (None, "\x03x")]
    found = urls.judge(spark.createDataFrame(rows, "page_id long, url string"), RULES).collect()
    assert Counter(r["page_id"] for r in found) == Counter(i for i, _ in rows)
