import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import make, profiles
from profseek.config import SearchConfig
from profseek.plans.run import dump, run_search
from profseek.sinks import reports
from profseek.sources.load import first_by_id, load_profiles
from profseek.sources.native import encode_record, footer, read_native, write_native, write_native_file
from profseek.sources.profile_files import MAX_SPLITS, _Reader, register
from profseek.sources.text import read_query_text
from profseek.sources.xml import problems, read_xml

GOOD = "\n first \nACGUN\n0.5,nan,1.25,-999,NaN\n\n\nsecond\n TTGA  rest\n1,2,.5,1e-1   \n"


def put(path, text):
    path.write_text(text)
    return str(path)


def test_query_text(spark, tmp_path):
    rows = read_query_text(spark, put(tmp_path / "q.txt", GOOD)).orderBy("ord").collect()
    assert [(r.id, r.bases, r.molecule) for r in rows] == [("first", "ACGTN", "RNA"), ("second", "TTGA", "DNA")]
    assert rows[0].reactivity == [0.5, None, 1.25, None, None]
    assert rows[1].reactivity == pytest.approx([1.0, 2.0, 0.5, 0.1])


@pytest.mark.parametrize("text, message", [
    ("a\nACG\n1,2,3\nb\n", "file truncated, expected sequence"),
    ("a\nACG\n1,2,3\nb\nAC\n", "file truncated, expected reactivities"),
    ("a\n\nACG\n1,2,3\n", "unexpected empty sequence at line 2"),
    ("a\nACG\n\nb\n", "invalid reactivity at line 3 and column 1"),
    ("a\nACxG\n1,2,3,4\n", "invalid sequence base at line 2 and column 3"),
    ("a\n  ATGUC\n1,2,3,4,5\n", "invalid sequence base at line 2 and column 6"),
    ("a\nACG\n1,22,z\n", "invalid reactivity at line 3 and column 6"),
    ("a\nACG\n1, 2,3\n", "invalid reactivity at line 3 and column 3"),
    ("\na\nACG\n1,2\n", "unmatching lengths between sequence (3) and reactivities (2) for query starting at line 2"),
])
def test_query_text_errors(spark, tmp_path, text, message):
    path = put(tmp_path / "q.txt", text)
    rows = read_query_text(spark, path, permissive=True).where("error is not null").orderBy("row").collect()
    assert rows[0].error == message
    with pytest.raises(Exception, match="USER_RAISED"):
        read_query_text(spark, path).collect()


def test_text_in_many_splits(spark, tmp_path):
    rng = np.random.default_rng(0)
    text = "".join(f"{chr(10) * int(rng.integers(0, 3))}n{i}\n{'ACGT' * 10}\n{','.join(['0.5'] * 40)}\n"
                   for i in range(400))
    path = put(tmp_path / "q.txt", text)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        rows = read_query_text(spark, path).orderBy("ord").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [r.id for r in rows] == [f"n{i}" for i in range(400)]


XML = '<data a="1">{meta}<transcript id="{id}" length="3"><sequence>\nA C\nU</sequence><reactivity>0.5, NaN,\n2' \
      '</reactivity></transcript></data>'
META = "<meta-data><organism>x</organism><source><citation>c</citation><pmid>1</pmid></source></meta-data>"


def test_xml(spark, tmp_path):
    (tmp_path / "d").mkdir()
    good = put(tmp_path / "d" / "a.XML", XML.format(id="one", meta=META))
    put(tmp_path / "d" / "b.xml", XML.format(id="two", meta=""))
    put(tmp_path / "d" / "c.xml", XML.format(id="x", meta="<meta-data><oops>1</oops></meta-data>"))
    put(tmp_path / "d" / "d.xml", XML.format(id="x", meta="").replace("NaN", "zz"))
    put(tmp_path / "d" / "note.txt", "no profile")
    rows = load_profiles(spark, str(tmp_path / "d")).orderBy("id").collect()
    assert [(r.id, r.bases, r.reactivity) for r in rows] == [(n, "ACT", [0.5, None, 2.0]) for n in ("one", "two")]
    assert {os.path.basename(r.file): r.error for r in problems(spark, str(tmp_path / "d")).collect()} == {
        "c.xml": "unexpected tag", "d.xml": "invalid reactivity"}
    assert load_profiles(spark, good).count() == 1
    with pytest.raises(Exception, match="USER_RAISED"):
        read_xml(spark, str(tmp_path / "d" / "c.xml")).collect()


def test_native_round_trip(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = make(rng, "t", [5, 0, 1, 64, 33]) + [("Nn", "NNA", [None, 0.5, 1.0])]
    frame = profiles(spark, rows)
    assert write_native(frame, str(tmp_path / "parts")) == 6
    assert write_native_file(frame, str(tmp_path / "one.db")) == 6
    want = {i: (b, None if v is None else [None if x is None else float(np.float32(x)) for x in v])
            for i, b, v in rows}
    for path in ("parts", "one.db"):
        for split in (1, 64, 1 << 20):
            got = read_native(spark, str(tmp_path / path), split).collect()
            assert {r.id: (r.bases, r.reactivity) for r in got} == want
    assert [r.id for r in read_native(spark, str(tmp_path / "one.db"), 1).orderBy("ord").collect()] == [
        r[0] for r in rows]


def test_profile_files(spark, tmp_path):
    register(spark)
    rows = [(f"r{n}", n, "ACGTN" * n, [None if i % 7 == 3 else i / 8 for i in range(5 * n)], "DNA") for n in range(1, 9)]
    frame = spark.createDataFrame(rows, "id string, ord long, bases string, reactivity array<double>, molecule string")
    folder = str(tmp_path / "p")
    frame.repartition(3).write.format("profiles").mode("append").save(folder)
    for split in (1, 200, 1 << 20):
        got = spark.read.format("profiles").option("splitBytes", split).load(folder).collect()
        assert sorted((r.id, r.bases, r.reactivity) for r in got) == sorted((r[0], r[2], r[3]) for r in rows)
        assert sorted(r.ord for r in got) == list(range(8))
    as_function = read_native(spark, folder).collect()
    assert sorted(map(tuple, as_function)) == sorted(map(tuple, got))

    before = sorted(p.name for p in (tmp_path / "p").iterdir())
    broken = frame.withColumn("bases", F.when(F.col("ord") != 8, F.col("bases")))
    for mode in ("append", "overwrite"):
        with pytest.raises(Exception, match="cannot be written"):
            broken.write.format("profiles").mode(mode).save(folder)
        assert sorted(p.name for p in (tmp_path / "p").iterdir()) == before
    frame.where("ord < 3").write.format("profiles").mode("overwrite").save(folder)
    assert sorted(r.id for r in spark.read.format("profiles").load(folder).collect()) == ["r1", "r2"]
    frame.where("ord = 5").write.format("profiles").mode("append").save(folder)
    assert spark.read.format("profiles").load(folder).count() == 3
    frame.limit(0).write.format("profiles").mode("overwrite").save(folder)
    assert spark.read.format("profiles").load(folder).count() == 0
    write_native_file(frame, str(tmp_path / "one.db"))
    assert spark.read.format("profiles").option("splitBytes", 1).load(str(tmp_path / "one.db")).count() == 8
    with pytest.raises(Exception, match="lack the columns"):
        frame.drop("bases").write.format("profiles").mode("append").save(folder)


def test_native_errors(spark, tmp_path):
    good = encode_record("a", "ACGT", np.arange(4.0))
    for name, content in {"marker": good + footer(1)[:-1] + b"x", "short": b"abc",
                          "nul": good.replace(b"a\0", b"ab") + footer(1), "past": good[:-3] + footer(1)}.items():
        (tmp_path / f"{name}.db").write_bytes(content)
        with pytest.raises(Exception):
            read_native(spark, str(tmp_path / f"{name}.db")).collect()
    bad = bytearray(good)
    bad[10] = 0x5F
    (tmp_path / "nibble.db").write_bytes(bytes(bad) + footer(1))
    with pytest.raises(Exception, match="nibble"):
        read_native(spark, str(tmp_path / "nibble.db")).collect()


def test_loader_errors(spark, tmp_path):
    for name in ("plain", "x.csv"):
        with pytest.raises(ValueError):
            load_profiles(spark, put(tmp_path / name, ""))
    with pytest.raises(FileNotFoundError):
        load_profiles(spark, str(tmp_path / "none.db"))


def test_first_by_id(spark):
    frame = profiles(spark, [("a", "AC", [1.0, 2.0]), ("b", "G", [3.0]), ("a", "T", [4.0])])
    assert {r.id: r.bases for r in first_by_id(frame).collect()} == {"a": "AC", "b": "G"}


def test_dump(spark, tmp_path):
    rng = np.random.default_rng(4)
    frame = profiles(spark, make(rng, "t", [57, 23, 40]))
    cfg = SearchConfig(db_shuffles=3)
    dump(frame, str(tmp_path / "db.parquet"), str(tmp_path / "null.db"), cfg)
    assert load_profiles(spark, str(tmp_path / "db.parquet")).count() == 3
    null = load_profiles(spark, str(tmp_path / "null.db")).collect()
    source = {r.id: r for r in frame.collect()}
    assert len(null) == 9
    for r in null:
        assert sorted(r.bases) == sorted(source[r.id].bases) and len(r.reactivity) == len(r.bases)


def test_whole_run_writes_reports(spark, tmp_path):
    rng = np.random.default_rng(6)
    targets = make(rng, "t", [120, 200, 90, 60])
    values = [0.3 if v is None else v for v in targets[1][2]]
    targets[1] = (targets[1][0], targets[1][1], values)
    query = ",".join(str(v) for v in values[50:110])
    qfile = put(tmp_path / "q.txt", f"probe\n{targets[1][1][50:110].replace('T', 'U')}\n{query}\n")
    write_native_file(profiles(spark, targets), str(tmp_path / "t.db"))
    cfg = SearchConfig(kmer_len=10, null_hsgs=50, kmer_max_match_every_nt=20, report_alignment="stockholm",
                       report_reactivity=True, inclusion_evalue=0.5, report_evalue=0.5)
    out = str(tmp_path / "out")
    run_search(spark, str(tmp_path / "t.db"), qfile, out, cfg, single_file=True)
    lines = (tmp_path / "out" / "results.out").read_text().splitlines()
    assert lines[0].split("\t")[:4] == ["Query", "DB field", "Qstart", "Qend"]
    assert lines[1].split("\t")[:6] == ["probe", "t1", "0", "59", "50", "109"] and lines[1].endswith("!")
    assert "kmer-len = 10" in (tmp_path / "out" / "params.out").read_text()
    name = "t1_50-109_probe_0-59"
    sto = (tmp_path / "out" / "alignments" / f"{name}.sto").read_text().splitlines()
    assert sto[0] == "# STOCKHOLM 1.0" and sto[1] == f"#=GF ID {name}" and sto[-1] == "//"
    assert sto[5].split() == ["probe", targets[1][1][50:110].replace("T", "U")]
    data = json.loads((tmp_path / "out" / "reactivities" / f"{name}.json").read_text())
    assert list(data) == ["query", "queryId", "queryFrom", "queryTo", "target", "targetId", "targetFrom", "targetTo"]
    assert data["queryTo"] == 59 and data["query"] == pytest.approx(values[50:110], abs=1e-6)
    with pytest.raises(FileExistsError):
        run_search(spark, str(tmp_path / "t.db"), qfile, out, cfg)
    # a null database from storage, FASTA reports, an empty result
    dump(profiles(spark, targets), None, str(tmp_path / "null"), cfg.replace(db_shuffles=5))
    strict = cfg.replace(report_alignment="fasta", report_reactivity=False, inclusion_evalue=-1.0, report_evalue=-1.0)
    run_search(spark, str(tmp_path / "t.db"), qfile, out, strict, overwrite=True, shuffled_db=str(tmp_path / "null"),
               single_file=True)
    assert (tmp_path / "out" / "results.out").read_text().count("\n") == 0
    assert not (tmp_path / "out" / "reactivities").exists()


def test_table_folder(spark, tmp_path):
    frame = spark.createDataFrame([("a", 1), ("b\tc", 2)], "Query string, status long")
    reports.write_table(frame, str(tmp_path / "t"))
    back = spark.read.option("sep", "\t").option("header", "true").csv(str(tmp_path / "t"))
    assert sorted(r[0] for r in back.collect()) == ["a", "b\tc"]


def test_table_text(spark, tmp_path):
    frame = spark.createDataFrame([("a", ""), ("b\tc", "!"), ('say "x"', "?")], "Query string, status string").coalesce(1)
    reports.write_table(frame, str(tmp_path / "t"))
    text = next((tmp_path / "t").glob("part-*.csv")).read_text()
    assert text == 'Query\t\na\t\n"b\tc"\t!\n"say ""x"""\t?\n'
    reports.write_table(frame, str(tmp_path / "one"), single_file=True)
    assert (tmp_path / "one").read_text() == 'Query\t\na\t\n"b\tc"\t!\n"say ""x"""\t?\n'


def test_console_table_is_whole(spark, capsys):
    reports.print_table(spark.range(1500).selectExpr("id AS Query", "'' AS status"))
    assert len(capsys.readouterr().out.splitlines()) == 1501
    reports.print_table(spark.range(0).selectExpr("id AS Query", "'' AS status"))
    assert capsys.readouterr().out == "No match found.\n"


def test_records_of_one_name_stay_apart(spark, tmp_path):
    """Names repeated over files and within a query file give what distinct names give."""
    from profseek.operators import nulls
    from profseek.plans import search
    from test_search_steps import CFG, fixture

    queries, targets = fixture()
    twin = lambda rows, name: [(name, b, v) for _, b, v in rows]
    text = lambda rows: "\n".join(
        f"{i}\n{b}\n{','.join('NaN' if x is None else repr(x) for x in v)}" for i, b, v in rows)
    found = {}
    for kind, own, others in (("apart", queries[:2], targets[:2]), ("same", twin(queries[:2], "q"), twin(targets[:2], "t"))):
        folder = tmp_path / kind
        folder.mkdir()
        for n, row in enumerate(others):
            write_native_file(profiles(spark, [row]), str(folder / f"{n}.db"))
        db, asked = load_profiles(spark, str(folder)), read_query_text(spark, put(tmp_path / f"{kind}.txt", text(own)))
        assert sorted(r.ord for r in db.select("ord").collect()) == [0, 1]
        assert nulls.draws(db, 0, 8, 2, CFG).count() == 8
        cfg = CFG.replace(tile_len=64)
        seeds = search.seeds_of(search.Queries.prepare(search.with_record_keys(asked), cfg), search.tiled(db, cfg), cfg)
        named = search.with_record_names(seeds)
        found[kind] = sorted(tuple(r) for r in named.select("query_ord", "target_ord", "q_start", "d_start", "q_end").collect())
        hits = search.search_hits(asked, db, CFG.replace(null_hsgs=20, report_evalue=1e9, inclusion_evalue=1.0))
        assert {r.query_id for r in hits.select("query_id").collect()} <= {r[0] for r in own}
    assert found["same"] == found["apart"] and len({r[:2] for r in found["same"]}) > 1


def test_ordinals_cover_all_files(spark, tmp_path):
    for folder in ("text", "xml"):
        (tmp_path / folder).mkdir()
    for n in range(3):
        put(tmp_path / "text" / f"{n}.txt", "one\nAC\n1,2\none\nGT\n3,4\n")
        put(tmp_path / "xml" / f"{n} x.xml", '<data><transcript id="one" length="2"><sequence>AC</sequence>'
                                            '<reactivity>1,2</reactivity></transcript></data>')
        profiles(spark, [("one", "AC", [1.0, float(n)])]).write.mode("append").parquet(str(tmp_path / "rows"))
    assert sorted(r.ord for r in read_query_text(spark, str(tmp_path / "text")).collect()) == list(range(6))
    assert sorted(r.ord for r in load_profiles(spark, str(tmp_path / "xml")).collect()) == [0, 1, 2]
    assert sorted(r.ord for r in load_profiles(spark, str(tmp_path / "rows")).collect()) == [0, 1, 2]


def test_short_records_do_not_make_a_task_each(tmp_path):
    count = 5000
    records = [encode_record(f"r{n}", "ACGT", np.arange(4.0)) for n in range(count)]
    (tmp_path / "many.db").write_bytes(b"".join(records) + footer(count))
    reader = _Reader(str(tmp_path), 1)
    splits = reader.partitions()
    assert 500 < len(splits) <= MAX_SPLITS
    ends = [0, *np.cumsum([len(r) for r in records]).tolist()]
    assert [s.start for s in splits] == [0, *[s.end for s in splits[:-1]]] and splits[-1].end == ends[-1]
    assert [s.first for s in splits] == [ends.index(s.start) for s in splits]
    got = [name for split in splits for batch in reader.read(split) for name in batch.column("id").to_pylist()]
    assert got == [f"r{n}" for n in range(count)]
