import fnmatch
import random

from graphjobs.llm import urlglobs


def test_automaton_matches_fnmatch():
    rng = random.Random(5)
    globs = ["".join(rng.choices("ab*?c", k=rng.randint(0, 9))) for _ in range(80)] + ["", "*", "?", "a" * 70 + "*b", "**a**"]
    texts = ["".join(rng.choices("abc", k=rng.randint(0, 12))) for _ in range(300)] + ["", "a" * 75 + "b", "é", "a\nb"]
    hits = urlglobs.Automaton(globs).match(texts)
    for i, t in enumerate(texts):
        for k, g in enumerate(globs):
            assert hits[i, k] == fnmatch.fnmatchcase(t, g), (t, g)


def test_escaped_characters_are_literal():
    hits = urlglobs.Automaton([urlglobs.escape("a*b?")]).match(["a*b?", "axbc", "a*b"])
    assert hits[:, 0].tolist() == [True, False, False]


def test_rules(spark):
    rows = [
        (1, "http://WWW.Example.com/en/x?q=/fr/"),
        (2, "http://a.example.com/en/"),
        (3, "https://example.com/fr/1#/en/"),
        (4, "http://foo.net/fr/a"),
        (5, "http://net/es/"),
        (6, "http://notnet/es/"),
        (7, "http://spamnet.org/x"),
        (8, "http://x.com"),
        (9, None),
        (10, "no scheme"),
        (11, ""),
        (12, "http://x.com?y=/"),
        (12, "http://x.com?y=/"),
        (13, "http://a.org/\nspam\n/"),
    ]
    df = spark.createDataFrame([(*r, "own") for r in rows], "page_id long, url string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlglobs.judge_urls(df).collect()}
    assert got[1] == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert got[2] == ("a.example.com", "/en/", "example.com/en/", "block")
    assert got[3] == ("example.com", "/fr/1", "com/", "allow")
    assert got[4][2:] == ("net/fr/", "block")
    assert got[5][2:] == ("net/es/", "block")
    assert got[6][2:] == (None, "allow")
    assert got[7][2:] == (None, "block")
    assert got[8] == ("x.com", "", None, "allow")
    assert got[9] == got[10] == got[11] == ("", "", None, "allow")
    assert got[13] == ("a.org", "/\nspam\n/", None, "allow")
    assert urlglobs.judge_urls(df).count() == len(rows)
    assert urlglobs.judge_urls(df.limit(0)).count() == 0


def test_long_urls_step_like_short_ones():
    automaton = urlglobs.Automaton(["*x*y", "a?c*", "*"])
    texts = ["x" + "-" * 300_000 + "y", "abc", "", "ab", "zx.y" * 3, "a\U0001f600c!"]
    want = [[True, False, True], [False, True, True], [False, False, True], [False, False, True], [True, False, True], [False, True, True]]
    assert automaton.match(texts).tolist() == want
