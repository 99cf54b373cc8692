import gzip
import hashlib
import random
import zlib
from pathlib import Path

from graphjobs.llm import warc


def pages():
    rng = random.Random(9)
    big = "<p>" + "same é text " * 120
    rows = [(i, f"http://{rng.choice('abc')}.Example.com:80/p/{i}?q={i % 3}#f", "<html>" + "x" * rng.randint(0, 3000) + str(i)) for i in range(120)]
    rows += [(200, "http://a.example.com/1", big), (300, "http://b.example.com/2", big), (250, None, big), (None, "http://z.org/", big)]
    rows += [(400, "http://s.org/ sp ace\r\nX: y", "short"), (401, "", "short"), (402, "http://ü.de/ü", None), (403, "none", ""), (404, "http://bin.org/", "\x00\x1f\x8b" * 700 + "\r\n\r\nWARC/1.1\r\n")]
    rows += [(5, rows[5][1], rows[5][2]), (-1, "http://z.org/", "minus"), (500, "http://big.org/", "y" * (17 << 20))]
    return rows


def brute(rows):
    last = {}
    for page_id, _, html in rows:
        p = (html or "").encode()
        if len(p) >= 1000 and page_id is not None:
            last[p] = max(last.get(p, page_id), page_id)
    count = {}
    for _, _, html in rows:
        count[(html or "").encode()] = count.get((html or "").encode(), 0) + 1
    out = []
    for page_id, _, html in rows:
        p = (html or "").encode()
        to = last.get(p) if count[p] > 1 else None
        again = to is not None and page_id != to
        out.append((page_id, len(p), hashlib.sha1(p).hexdigest(), "revisit" if again else "response", to if again else None))
    return sorted(out, key=repr)


def test_round_trip(spark):
    rows = pages()
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, refers_to string").repartition(3)
    got = sorted([tuple(r) for r in warc.round_trip(df).collect()], key=repr)
    assert got == brute(rows)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_files_are_plain_gzip(spark, tmp_path):
    rows = pages()[:40]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    warc.write_archive(df, str(tmp_path / "w"), per_file=15)
    files = sorted(Path(tmp_path / "w").glob("part-*"))
    assert len(files) == 3
    whole = b"".join(gzip.decompress(f.read_bytes()) for f in files)
    assert whole.count(b"WARC-Record-ID") == 40
    for f in files:
        for offset, length, content in warc.scan_members(str(f), chunk=97):
            assert zlib.decompressobj(31).decompress(f.read_bytes()[offset : offset + length]) == content


def test_lookup_over_many_blocks(spark, tmp_path):
    rows = [(i, f"http://host{i % 7}.org/{i % 11}", f"page {i}") for i in range(300)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write_archive(df, str(tmp_path / "w"))
    directory = warc.build_index(spark, str(tmp_path / "w"), str(tmp_path / "i"), block_lines=4)
    assert len(directory.first) >= 75 and directory.first == sorted(directory.first)
    wanted = spark.createDataFrame([(warc.surt(u), i) for i, u, _ in rows[::5]] + [("nowhere", 1), ("", 0), ("zzz", 9)], "key string, page_id long")
    got = warc.fetch(warc.locate(wanted, directory))
    assert sorted(r.page_id for r in got.collect()) == [i for i, _, _ in rows[::5]]


def test_surt():
    assert warc.surt("http://WWW.Example.com:8080/a/B?c#d") == "com,example,www:8080)/a/B?c"
    assert warc.surt("http://u@x.org") == "org,x)"
    assert warc.surt(None) == "about:blank"
