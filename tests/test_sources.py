import csv
import io
import json
import random

import pytest
from graphjobs.sources import records
from graphjobs.streaming import append

RECORD = "id long, name string"


def test_records_as_array_or_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id": 1, "name": "立春"},\n {"id": 2}]')
    (tmp_path / "b.json").write_text('{"id": 3, "name": "x"}\n\n{"id": 4}\n')
    assert sorted(r.id for r in records.read_records(spark, str(tmp_path / "a.json"), RECORD).collect()) == [1, 2]
    assert sorted(r.id for r in records.read_records(spark, str(tmp_path / "b.json"), RECORD).collect()) == [3, 4]


@pytest.fixture
def small_splits(spark):
    """Splits of so few bytes that records go over several."""
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    yield lambda n: spark.conf.set(name, str(n))
    spark.conf.set(name, before)


TEXTS = ["立春", 'a "quoted" word', "x }, {", "]", "[{", "\\", '\\"', "line\nbreak", "", "tab\t,", "}" * 30, 'é"', "\n\n", " lead", "long " * 60]


@pytest.mark.parametrize("bytes_each", [23, 200, 100_000])
def test_arrays_in_splits_of_any_size(spark, tmp_path, small_splits, bytes_each):
    rng = random.Random(bytes_each)
    rows = [{"id": k, "name": rng.choice(TEXTS), "in": {"l": [1, {"x": rng.choice(TEXTS)}]}} for k in range(60)]
    for k, (indent, part) in enumerate([(None, rows[:25]), (2, rows[25:40]), (0, rows[40:]), (None, [])]):
        (tmp_path / f"{k}.json").write_text("\ufeff" * (k == 1) + json.dumps(part, indent=indent, ensure_ascii=k == 0) + "\n" * k, encoding="utf-8")
    small_splits(bytes_each)
    got = records.read_records(spark, str(tmp_path), "id long, name string, in struct<l: array<string>>").collect()
    assert sorted((r.id, r.name, json.loads(r["in"].l[1])["x"]) for r in got) == sorted((r["id"], r["name"], r["in"]["l"][1]["x"]) for r in rows)


def test_an_array_that_breaks_off(spark, tmp_path, small_splits):
    (tmp_path / "a.json").write_text('[{"id": 1, "name": "x"}, {"id": 2, "na')
    small_splits(10)
    assert sorted(str(r.id) for r in records.read_records(spark, str(tmp_path), RECORD).collect()) == ["1", "None"]


@pytest.mark.parametrize("bytes_each", [17, 150, 100_000])
@pytest.mark.parametrize("ending", ["\n", "\r\n"])
def test_csv_rows_are_numbered_in_splits_of_any_size(spark, tmp_path, small_splits, bytes_each, ending):
    rng = random.Random(bytes_each)
    want, pos = [], 0
    for k in range(3):
        out = io.StringIO()
        writer = csv.writer(out, lineterminator=ending)
        writer.writerow(["source", "target", "type", "season"])
        for i in range(30 * (k != 1)):
            if rng.random() < 0.1:
                out.write(ending)  # no row
            writer.writerow([f"s{k}-{i}", rng.choice(TEXTS), rng.choice(TEXTS), rng.choice(["", "冬至"])])
        if k == 2:
            out.write('s2-x,a"b,"c"d,e')  # quotes that quote nothing, and no break at the end
        (tmp_path / f"{k}.csv").write_text(out.getvalue(), newline="")
        for n, row in enumerate(csv.DictReader(io.StringIO(out.getvalue(), newline="")), start=2):
            want.append((row["source"], row["target"], row["type"], row["season"], n))
            pos += 1
    small_splits(bytes_each)
    got = [tuple(r) for r in records.read_relations(spark, str(tmp_path)).collect()]
    assert sorted(r for r in got if r[0] != "s2-x") == sorted(r for r in want if r[0] != "s2-x")
    assert [r[-1] for r in got if r[0] == "s2-x"] == [32]
    places = records._csv(spark, str(tmp_path)).orderBy("pos").select("source", "pos").collect()
    assert [r.source for r in places] == [r[0] for r in want] and [r.pos for r in places] == list(range(len(want)))


def test_broken_lines_are_rejected_with_numbers(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"id": 1}\n\n{broken\n{"id": 2, "name": "n"}\n   \nnot json')
    good, bad = records.read_jsonl_with_rejects(spark, str(tmp_path / "x.jsonl"), RECORD)
    assert sorted((r.line_no, r.id) for r in good.collect()) == [(1, 1), (4, 2)]
    assert sorted(r.line_no for r in bad.collect()) == [3, 6]


def test_csv_readers_and_writers(spark, tmp_path):
    (tmp_path / "e.csv").write_text("name,label\n 立春 ,SolarTerm\n,x\ny,\n")
    assert [(r.name, r.label) for r in records.read_entities(spark, str(tmp_path / "e.csv")).collect()] == [("立春", "SolarTerm")]
    (tmp_path / "r.csv").write_text("head,object,relation,season\na,b,宜,\n,c,d,e\n")
    rows = [tuple(r) for r in records.read_relations(spark, str(tmp_path / "r.csv")).collect()]
    assert rows == [("a", "b", "宜", "", 2), ("", "c", "d", "e", 3)]
    records.write_nodes(spark.createDataFrame([("b", "L"), ("a", "L")], "name string, label string"), str(tmp_path / "n"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "n").glob("part-*.csv")))
    assert [x for x in text.splitlines() if x != "name,label"] == ["a,L", "b,L"]
    records.write_rejects(spark.createDataFrame([("k", 1), ("m", 2)], "category string, line_no long"), str(tmp_path / "rej"))
    assert (tmp_path / "rej" / "category=k").is_dir()
    nodes = spark.createDataFrame([("1", "a", "X")], "node_id string, name string, label string")
    edges = spark.createDataFrame([("1", "1", "r")], "src_id string, dst_id string, rel_type string")
    records.write_graph(nodes, edges, str(tmp_path / "g"))
    assert spark.read.parquet(str(tmp_path / "g/nodes")).count() == 1
    records.write_json(spark.createDataFrame([("立春", [("a", "b")])], "name string, entities array<struct<name:string,label:string>>"), str(tmp_path / "j"))
    assert "立春" in "".join(p.read_text() for p in (tmp_path / "j").glob("part-*.json"))


STREAM = "source string, target string, type string, season string, row_no long"


def arriving(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(json.dumps(r) + "\n" for r in rows))


def appended(spark, tmp_path, **options):
    source, table, check = (str(tmp_path / x) for x in ("in", "table", "check"))
    append.append_relations_stream(spark, source, STREAM, lambda df: df, table, check, **options).awaitTermination()
    return sorted(tuple(r) for r in spark.read.parquet(table).select("source", "season").na.fill("").collect())


def test_two_micro_batches_equal_one(spark, tmp_path):
    rows = [dict(source=f"a{i % 5}", target="b", type="t", season=None if i % 2 else "s", row_no=i) for i in range(30)]
    arriving(tmp_path / "in", "1.json", rows[:12])
    appended(spark, tmp_path)
    arriving(tmp_path / "in", "2.json", rows[12:])
    got = appended(spark, tmp_path)
    assert got == sorted({(r["source"], r["season"] or "") for r in rows})
    assert appended(spark, tmp_path) == got
    assert "Rocks" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass")


def test_batches_don_t_read_the_table_and_run_again_after_a_failure(spark, tmp_path):
    rows = [dict(source=f"a{i % 7}", target="b", type="t", season="s", row_no=i) for i in range(20)]
    arriving(tmp_path / "in", "1.json", rows)
    appended(spark, tmp_path)
    (tmp_path / "table").rename(tmp_path / "old")
    arriving(tmp_path / "in", "2.json", [*rows, dict(rows[0], source="new")])
    assert appended(spark, tmp_path) == [("new", "s")]
    # the last batch is not known to have ended, and the first rows of a third came
    last = max((p for p in (tmp_path / "check" / "commits").iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
    last.unlink()
    (tmp_path / "check" / "commits" / f".{last.name}.crc").unlink(missing_ok=True)
    arriving(tmp_path / "in", "3.json", [dict(rows[0], source="third"), rows[3]])
    assert appended(spark, tmp_path, files_per_batch=1) == [("new", "s"), ("third", "s")]


def test_the_least_number_of_the_first_batch_stays(spark, tmp_path):
    rows = [dict(source="a", target="b", type="t", season=None, row_no=n) for n in (5, 3, 9)]
    arriving(tmp_path / "in", "1.json", [*rows, dict(rows[0], source="c")])
    appended(spark, tmp_path)
    arriving(tmp_path / "in", "2.json", [dict(rows[0], row_no=1), dict(rows[0], source="d", row_no=8), dict(rows[0], source="d", row_no=7)])
    appended(spark, tmp_path)
    got = [(r.source, r.row_no) for r in spark.read.parquet(str(tmp_path / "table")).collect()]
    assert sorted(got) == [("a", 3), ("c", 5), ("d", 7)]
