"""The URL filter's method against plain Python: segmentation, naive Bayes and verdicts of whole tables."""

import collections
import math

import regex

from regspark.llm import url_filter as uf

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(url: str | None) -> tuple[str, str]:
    m = regex.search(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    return (m[1].translate(UPPER), m[2]) if m else ("", "")


def rule(host: str, path: str) -> uf.Rule | None:
    fits = [r for r in uf.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.text), default=None)


def best_words(run: str, counts: dict, total: int) -> list[str]:
    """The most likely words by trying every last word of every prefix."""
    best = [(0.0, [])]
    for j in range(1, len(run) + 1):
        ways = []
        for i in range(max(0, j - uf.LONGEST_WORD), j):
            word = run[i:j]
            if word in counts:
                ways.append((best[i][0] + math.log(counts[word] / total), -i, word))
            ways.append((best[i][0] - math.log(total) - 2.3 - 2.3 * len(word), -i, word))
        score, i, word = max(ways)
        best.append((score, [*best[-i][1], word]))
    return best[-1][1]


def brute(rows: list[tuple]) -> dict:
    """page_id: (host, path, rule, verdict, log odds)."""
    counts: collections.Counter = collections.Counter()
    for _, _, html in rows:
        shown = regex.sub(r"<[^>]*>|&[A-Za-z0-9_]+;", " ", regex.sub(r"(?is)<(script|style)\b.*?</\1>", " ", html or ""))
        counts.update(w for w in regex.split(r"\P{L}+", shown.lower()) if 0 < len(w) <= uf.LONGEST_WORD)
    total = sum(counts.values()) + 1
    seen: dict = {}

    def tokens(host: str, path: str) -> list[str]:
        runs = [x for x in regex.split(r"[^\p{L}#]+", regex.sub(r"[0-9]+", " # ", f"{host}/{path}".lower())) if x]
        return [t for x in runs for t in ([x] if x == "#" else seen.setdefault(x, None) or seen.__setitem__(x, best_words(x, counts, total)) or seen[x])]

    times: dict = {"block": collections.Counter(), "allow": collections.Counter()}
    pages, listed, every = collections.Counter(), {}, set()
    for k, url, _ in rows:
        host, path = parts(url)
        r, t = rule(host, path), tokens(host, path)
        listed[k] = host, path, r, t
        every |= set(t)
        if r:
            pages[r.verdict] += 1
            times[r.verdict].update(t)
    size = max(1, len(every))
    log = lambda v, t: math.log((times[v][t] + 1) / (sum(times[v].values()) + size))
    prior = math.log((pages["block"] + 1) / (pages["allow"] + 1))
    out = {}
    for k, (host, path, r, t) in listed.items():
        odds = prior + sum(log("block", x) - log("allow", x) for x in t)
        verdict = r.verdict if r else "block" if odds > 0 and pages else "allow"
        out[k] = host, path, r and r.text, verdict, None if r else odds
    return out


def check(pages) -> dict:
    want = brute([tuple(r) for r in pages.select("page_id", "url", "html").collect()])
    rows = uf.url_verdicts(pages).collect()
    for r in rows:
        host, path, name, verdict, odds = want[r.page_id]
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, name, verdict)
        assert (r.log_odds is None) == (odds is None) and (odds is None or abs(r.log_odds - odds) < 1e-5)
    assert {r.page_id for r in rows} == set(want) and len(rows) == pages.count()
    return want


def test_whole_table_equals_brute_force(spark):
    want = check(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"))
    assert {x[3] for x in want.values() if x[2] is None} and any(x[2] for x in want.values())


def test_odd_urls_and_repeated_rows(spark):
    long = "http://www." + "cheappillsshop" * 300 + ".com/" + "buynow/" * 500 + "x" * 3000
    urls = ["http://cheappills.net/shop1", "http://news.org/fr/cheap", "https://cheapnews.com/de?x", long, long, None, "", "no host", "://", "HTTP://A.NET", "http://a.net/", "http://x.example.net/en/1", "http://пример.org/fr/2", "http://cheapnews.com/1"]
    rows = [(i, u, "<p>cheap pills buy now shop news</p> pills") for i, u in enumerate(urls)] + [(3, long, None), (None, "http://x.org/", "<b>x</b>")]
    check(spark.createDataFrame(rows, "page_id long, url string, html string"))
