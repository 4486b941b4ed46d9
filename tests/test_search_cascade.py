"""The web-search cascade against a plain one, request by request."""

import random

from skein.operators import scope


def plain(req, answers, most):
    q, pref, tavily, serper, domains, fallback = req

    def ask(engine, within):
        keys = {"tavily": tavily, "serper": serper, "duckduckgo": "-"}
        return [(engine, u) for u, _ in sorted(((u, p) for e, w, p, u in answers.get(q, ()) if e == engine and w == within), key=lambda x: (x[1], x[0]))] if (keys[engine] or "").strip() else []

    def run(within, fallback):
        p = (pref or "auto").lower()
        if p in ("tavily", "serper"):
            return ask(p, within) or (ask("duckduckgo", within) if fallback else [])
        if p in ("duckduckgo", "ddg"):
            return ask("duckduckgo", within)
        found = ask("tavily", within) if (tavily or "").strip() else ask("serper", within) if (serper or "").strip() else []
        return found or ask("duckduckgo", within)

    found, widened = run(domains, fallback), False
    if not found and domains and fallback:
        found, widened = run(False, False), True
    return [(q, e, u, i + 1, widened) for i, (e, u) in enumerate(list(dict.fromkeys(found))[:most])]


def test_searches_equal_a_plain_cascade(spark):
    rng = random.Random(8)
    requests = [(i, rng.choice(["tavily", "serper", "DDG", "duckduckgo", "auto", None, "?"]), rng.choice(["k", " ", None]), rng.choice(["k", "", None]), rng.random() < 0.5, rng.random() < 0.7) for i in range(400)]
    answers = {i: [(e, w, rng.randint(0, 3), f"u{rng.randint(0, 3)}") for e in ("tavily", "serper", "duckduckgo") for w in (True, False) for _ in range(rng.choice([0, 0, 1, 5]))] for i in range(400)}
    r = spark.createDataFrame([(*x, "clash") for x in requests], "q int, pref string, tavily_key string, serper_key string, domains boolean, fallback boolean, other string")
    a = spark.createDataFrame([(q, *x) for q, v in answers.items() for x in v], "q int, engine string, within boolean, pos int, url string")
    got = sorted(map(tuple, scope.searched(r, a, 3).select("q", "engine", "url", "rank", "widened").collect()))
    assert got == sorted(x for req in requests for x in plain(req, answers, 3))
    assert scope.searched(r.limit(0), a, 3).count() == 0 and scope.searched(r, a.limit(0), 3).count() == 0
