"""URL rules and the model ratio against plain Python."""

import math
import random
from collections import Counter, defaultdict

import pytest

from featlake.llm import urls
from featlake.llm.queries import LLM_QUERIES


def parted(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = rest[:min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))]
    path = rest[len(host):]
    path = path[:min([path.find(c) for c in "?#" if c in path], default=len(path))]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def ruled(host, path):
    fits = [(h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda x: len(x[0]), default=(None, None))


def models(counted, order):
    """Witten-Bell probabilities from texts of both kinds."""
    grams, follow = [Counter(), Counter()], [defaultdict(set), defaultdict(set)]
    total = [Counter(), Counter()]
    for text, kind in counted:
        for i in range(order, len(text)):
            for n in range(order + 1):
                c = text[i - n:i]
                grams[kind][c, text[i]] += 1
                total[kind][c] += 1
                follow[kind][c].add(text[i])

    def p(kind, context, char):
        low = 1 / urls.ALPHABET if not context else p(kind, context[1:], char)
        if not context:
            n = total[kind][""]
            return low if not n else (grams[kind]["", char] + len(follow[kind][""]) * low) / (n + len(follow[kind][""]))
        n, t = total[kind][context], len(follow[kind][context])
        return low if not n else (grams[kind][context, char] + t * low) / (n + t)
    return p


def texts(seed):
    r = random.Random(seed)
    out = [None, "", "no scheme", "http://", "HTTP://A.NET/x?y", "http://net/", "http://net", "http://anet/", "x://y://z.org/fr/", "http://É.Org/fr/\nq", "http://sub.example.net/en/1#a", "http://example.net:80/en/", "mailto:a@b", "http://?q"]
    for _ in range(200):
        host = r.choice(["a", "bb", "www.x", "free-bets"]) + "." + r.choice(["example.net", "example.com", "example.org", "net", "org", "de"])
        out.append(f"http{r.choice(['', 's'])}://{host}/{r.choice(['en', 'de', 'fr', 'es'])}/{r.randint(1, 60)}{r.choice(['', '/', '?p=1', '#t'])}")
    return out + out[20:40]


def test_registered(spark, tmp_path):
    rows = list(enumerate(texts(1))) + [(None, "http://q.de/en/"), (3, "http://q.de/en/")]
    spark.createDataFrame([(i, u, "", "x") for i, u in rows], "page_id long, url string, host string, gram string").repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    df = LLM_QUERIES["op9_url_filter"](spark, str(tmp_path))
    assert df.columns[:5] == ["page_id", "host", "path", "rule", "verdict"]
    got = df.collect()
    by = {}
    for r in got:
        by.setdefault(r.page_id, []).append(r)
    assert len(got) == len(rows)
    for i, u in rows:
        host, path = parted(u)
        rule, verdict = ruled(host, path)
        mine = [r for r in by[i] if (r.host, r.path) == (host, path)]
        assert mine and mine[0].rule == rule and (rule is None or mine[0].verdict == verdict)
        assert mine[0].verdict in ("allow", "block")


def test_scores_against_plain_models(spark):
    r = random.Random(2)
    rows = []
    for u in {t for t in texts(3) if t}:
        rows.append((u, r.choice(["allow", "block", None]), r.random() < .2))
    got = {x.url: x.score for x in urls.scores(spark.createDataFrame(rows, "url string, kind string, held boolean"), 3).collect()}

    def padded(u):
        return urls.START * 3 + "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in u) + urls.END
    p = models([(padded(u), ["allow", "block"].index(k)) for u, k, h in rows if k and not h], 3)
    for u, _, _ in rows:
        t = padded(u)
        want = sum(math.log(p(0, t[i - 3:i], t[i])) - math.log(p(1, t[i - 3:i], t[i])) for i in range(3, len(t))) / (len(t) - 3)
        assert got[u] == pytest.approx(want, abs=1e-9)


def test_model_parts_hosts(spark):
    """Without rules for them, hosts that look like the rejected ones are blocked."""
    df = urls.judged(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))
    free = df.where("rule is null").collect()
    assert {r.verdict for r in free} == {"allow", "block"}


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "http://a.net/x"), (1, "http://a.net/x")]])
def test_small_tables(spark, rows):
    got = urls.judged(spark.createDataFrame(rows, "page_id long, url string")).collect()
    assert len(got) == len(rows) and all(r.verdict in ("allow", "block") for r in got)
