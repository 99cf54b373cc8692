import re

import corpus_pipeline
from graphjobs.llm import decontam, secrets
from graphjobs.llm.common import table

SF = "/root/testdata/sf0.001"


def parts(words):
    n = max(1, len(words) // 8)
    return [words[i : i + n] for i in range(0, len(words) - n + 1, max(1, n // 2))]


def spans_by_hand(text):
    """Merged (kind, start, end) of the rules' matches by Python's own engine."""
    found = []
    for rank, rule in enumerate(secrets.BASE_RULES + secrets.MORE_RULES):
        found += [(m.start(), rank, m.end(), rule.kind) for m in re.finditer(rule.regex, text) if len(m[rule.group]) >= rule.min_length]
    out = []
    for start, _, end, kind in sorted(found):
        if out and start < out[-1][2]:
            out[-1] = (out[-1][0], out[-1][1], max(end, out[-1][2]))
        else:
            out.append((kind, start, end))
    return out


def test_stages_hold_against_brute_force(spark):
    from test_decontam import semi_global
    from test_simhash import brute

    docs = table(spark, SF, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        out = stage(spark, docs, SF).cache()
        after = {r.doc_id: r for r in out.collect()}
        assert set(after) <= set(before)
        if name == "language":
            assert set(before) - set(after) == {d for d, r in before.items() if not any(c.isalpha() for c in r.text or "")}
        elif name == "near duplicates":
            assert sorted(after) == sorted(d for d, _, c in brute([(d, r.text) for d, r in before.items()], words=5, signatures=6) if d == c)
        elif name == "decontamination":
            items = [decontam.normalise(r.text) for r in table(spark, SF, "benchmark").collect()]
            own = {d: decontam.normalise(r.text) for d, r in before.items()}
            # a passage within the budget shares an eighth of its words in a row with its item
            for d, text in own.items():
                close = [x for x in items if any(" ".join(p) in text for p in parts(x.split()))]
                dirty = any((best := semi_global(x, text)) and best[0] <= len(x) // 20 for x in close)
                assert (d in after) != dirty
        elif name == "secrets":
            assert set(after) == set(before)
            assert all(r.n_chars == len(r.text) for d, r in after.items() if r.text != before[d].text)
            for d, r in after.items():
                want = before[d].text or ""
                for kind, start, end in reversed(spans_by_hand(want)):
                    want = f"{want[:start]}[{kind}]{want[end:]}"
                assert (r.text or "") == want
        else:
            assert all(r.taken > 0 for r in after.values()) and out.columns[: len(columns)] == columns
        if name != "mixing":
            assert out.columns == columns
        docs = out


def test_the_query_runs(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and sum(r.taken for r in rows) > 0
