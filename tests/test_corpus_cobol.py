"""Sources/sinks (A1, A9) and COBOL decoding (H) hand cases."""

from __future__ import annotations

import os

import pytest
from pyspark.errors import SparkRuntimeException
from pyspark.sql import functions as F

from ferryman.operators import cobol, corpus
from ferryman.plans.corpus_q import corpus_scan
from ferryman.sources import fixtures as fx


def test_corpus_scan_drops_undecodable_bytes(spark, tmpdir_path):
    os.makedirs(tmpdir_path + "/c")
    with open(tmpdir_path + "/c/a.sas", "wb") as f:
        f.write(b"data x;\xff\xfe run;\xc3\xa9")
    with open(tmpdir_path + "/c/b.txt", "wb") as f:
        f.write(b"")
    rows = {os.path.basename(r.path): r.text for r in corpus.corpus_scan(spark, tmpdir_path + "/c").collect()}
    assert rows == {"a.sas": "data x; run;é", "b.txt": ""}
    assert rows["a.sas"] == b"data x;\xff\xfe run;\xc3\xa9".decode("utf-8", errors="ignore")


def test_csv_sink_round_trip_with_quotes_and_newlines(spark, tmpdir_path):
    rows = [(1, 'say "hi", ok', "a\nb\r\nc"), (2, "", "  padded  "), (3, None, "back\\slash")]
    df = spark.createDataFrame(rows, "k bigint, a string, b string")
    corpus.write_csv_all_quoted(df, tmpdir_path + "/csv")
    back = corpus.read_csv_all_quoted(spark, tmpdir_path + "/csv", "k bigint, a string, b string")
    got = sorted(back.collect())
    assert got[0] == (1, 'say "hi", ok', "a\nb\r\nc")
    assert got[1].b == "  padded  " and got[2].b == "back\\slash"
    text = "".join(open(os.path.join(tmpdir_path, "csv", f)).read() for f in os.listdir(tmpdir_path + "/csv")
                   if f.endswith(".csv"))
    assert '"say ""hi"", ok"' in text
    assert '"back\\\\slash"' in text            # a backslash is written as two, as Python's csv does


def test_cost_estimate_integer_truncation(spark):
    df = spark.createDataFrame([(1, "a\nb\nc", "gpt-4o-mini"), (2, "", "gemini-pro")],
                               "script_id bigint, text string, model string")
    out = {r.script_id: r for r in corpus.cost_estimate(df).collect()}
    r = out[1]  # 3 lines -> 52 in, int(52*.12)=6 out, int(52*.04)=2, int(2*.6)=1
    assert (r.lines, r.llm_in, r.llm_out, r.opt_in, r.opt_out) == (3, 52, 6, 2, 1)
    assert str(r.cost_usd) == "0.000375"   # (54*0.005 + 7*0.015)/1000
    assert out[2].lines == 1               # empty text still counts one line


def test_comp3_and_pic_decoding(spark):
    df = spark.createDataFrame([("12345D", "-", "00001234567"), ("0000C", "+", "00000000000"),
                                ("12F", "+", "0000000001X")], "p string, s string, d string")
    out = df.select(cobol.comp3_decode(F.unhex("p"), 13, 2).alias("c3"),
                    cobol.pic_numeric(F.col("d"), 9, 2, sign=F.col("s")).alias("pic")).collect()
    assert [str(r.c3) for r in out] == ["-123.45", "0.00", "0.12"]
    assert [None if r.pic is None else str(r.pic) for r in out] == ["-12345.67", "0.00", None]


def test_cobol_date_invalid_is_null_and_zeros(spark):
    df = spark.createDataFrame([("20240229", "000123"), ("20240231", "0000"), ("2024AB01", "0")],
                               "d string, z string")
    out = df.select(cobol.cobol_date(F.col("d")).cast("string"), cobol.strip_zeros(F.col("z"))).collect()
    assert [tuple(r) for r in out] == [("2024-02-29", "123"), (None, "0"), (None, "0")]


def test_occurs_slices(spark):
    df = spark.createDataFrame([("000100020003",)], "b string")
    assert df.select(cobol.occurs(F.col("b"), 3, 4)).first()[0] == ["0001", "0002", "0003"]


def test_utf8_ignore_matches_python_decode(spark):
    import random
    rnd = random.Random(3)
    alphabet = [b"a", b"\n", b"\xc3\xa9", b"\xef\xbf\xbd", b"\xee\x80\x80", b"\xee\x80\x81", b"\xee\x80\x82",
                b"\xff", b"\xc3", b"\xe2\x82", b"\xf0\x9f\x98\x80", b"\xf0\x9f", b"\x80", b"\xed\xa0\x80"]
    blobs = [b"".join(rnd.choice(alphabet) for _ in range(rnd.randrange(0, 12))) for _ in range(400)]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(blobs)], "i int, b binary")
    got = {r.i: r.t for r in df.select("i", corpus.utf8_ignore(F.col("b")).alias("t")).collect()}
    bad = [(blobs[i], got[i]) for i in got if got[i] != blobs[i].decode("utf-8", errors="ignore")]
    assert not bad, bad[:3]


def test_corpus_scan_gives_empty_files_their_folder_columns(spark, tmpdir_path):
    for i, body in enumerate([b"data x;", b"", b"run;", b""]):
        os.makedirs(tmpdir_path + f"/c/script_id={i}/kind=a b")
        with open(tmpdir_path + f"/c/script_id={i}/kind=a b/f.sas", "wb") as f:
            f.write(body)
    got = {r.script_id: (r.kind, r.length, r.text) for r in corpus.corpus_scan(spark, tmpdir_path + "/c").collect()}
    assert got == {0: ("a b", 7, "data x;"), 1: ("a b", 0, ""), 2: ("a b", 4, "run;"), 3: ("a b", 0, "")}


def test_comp3_of_every_sign_nibble(spark):
    rows = spark.createDataFrame([(bytearray.fromhex("0123" + "4" + n),) for n in "ABCDEF"], "b binary")
    got = [int(r[0]) for r in rows.select(cobol.comp3_decode(F.col("b"), 5, 0)).collect()]
    assert got == [1234, -1234, 1234, -1234, 1234, 1234]


def test_script_files_lie_in_few_folders(spark, tmpdir_path):
    rows = [(i, f"data t{i};\nrun;") for i in range(300)] + [(5, "again"), (-7, "é"), (8, None), (400, ""), (None, "a"), (None, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(tmpdir_path + "/documents.parquet")
    folder = fx.script_files(spark, tmpdir_path).removeprefix("file:")
    assert len([f for f in os.listdir(folder) if not f.startswith((".", "_"))]) <= 4 * spark.sparkContext.defaultParallelism
    lines = {}
    for i, t in rows:
        lines.setdefault(i, []).append((t or "") + "\n")
    got = corpus_scan(spark, tmpdir_path).collect()
    assert len(got) == len(lines) == len({r.script_id for r in got})
    for r in got:
        assert r.length == len(r.text.encode()) and sorted(r.text.splitlines(True)) == sorted("".join(lines[r.script_id]).splitlines(True))


def test_corpus_scan_keeps_no_list_of_files_in_the_driver(spark, tmpdir_path):
    for i in range(60):
        os.makedirs(tmpdir_path + f"/c/part={i % 3}", exist_ok=True)
        with open(tmpdir_path + f"/c/part={i % 3}/s{i}.sas", "w") as f:
            f.write("x" * i)
    df = corpus.corpus_scan(spark, tmpdir_path + "/c")
    assert not [f for f in df.inputFiles() if f.endswith(".sas")]
    assert sorted((os.path.basename(r.path), r.length, r.part, r.text) for r in df.collect()) == \
        sorted((f"s{i}.sas", i, i % 3, "x" * i) for i in range(60))


def test_corpus_scan_reads_files_beside_partition_folders(spark, tmpdir_path):
    for name, body in ("k=1/a.sas", "run;"), ("k=2/b.sas", ""), ("beside.sas", "data x;"), ("_hidden/d.sas", "no"), ("k=1/sub/c.sas", "quit;"):
        os.makedirs(os.path.dirname(f"{tmpdir_path}/c/{name}"), exist_ok=True)
        with open(f"{tmpdir_path}/c/{name}", "w") as f:
            f.write(body)
    got = {os.path.basename(r.path): (r.k, r.length, r.text) for r in corpus.corpus_scan(spark, tmpdir_path + "/c").collect()}
    assert got == {"a.sas": (1, 4, "run;"), "b.sas": (2, 0, ""), "beside.sas": (None, 7, "data x;"), "c.sas": (1, 5, "quit;")}
    for folder in "sub", "sub/k=3", "j=1":  # as with Spark's index
        os.makedirs(f"{tmpdir_path}/{folder}/c/{folder}")
        for name in "c/k=1/a.sas", f"c/{folder}/e.sas":
            os.makedirs(os.path.dirname(f"{tmpdir_path}/{folder}/{name}"), exist_ok=True)
            open(f"{tmpdir_path}/{folder}/{name}", "w").close()
        with pytest.raises(SparkRuntimeException, match="CONFLICTING"):
            corpus.corpus_scan(spark, f"{tmpdir_path}/{folder}/c")


def test_corpus_scan_types_partition_columns_as_sparks_index(spark, tmpdir_path):
    folders = ["a=1/b=9999999999/c=1.5/d=2020-01-01/e=x%3Ay/f=123456789012345678901/g=2020-01-01 10%3A00%3A00/h=__HIVE_DEFAULT_PARTITION__",
               "a=007/b=1/c=2/d=2020-01-02/e=3/f=1/g=2020-01-01 10%3A00%3A01/h=1", "a=-3/b=2/c=7/d=2020-02-29/e=é +/f=2/g=2020-02-29 00%3A00%3A00/h=2"]
    for i, folder in enumerate(folders):
        os.makedirs(f"{tmpdir_path}/c/{folder}/more")
        for j in range(2):
            with open(f"{tmpdir_path}/c/{folder}/more/{i}{j}.{'sas' if j else 'SAS'}", "w") as f:
                f.write("data;")
    for glob in None, "*.{sas,txt}", "?0.SAS":
        now, index = corpus.corpus_scan(spark, tmpdir_path + "/c", glob), corpus._scan_by_index(spark, tmpdir_path + "/c", glob)
        assert now.schema.simpleString() == index.schema.simpleString()
        assert sorted(map(str, now.collect())) == sorted(map(str, index.collect()))


def test_corpus_scan_of_a_glob_of_one_file_and_of_a_store_that_only_spark_reads(spark, tmpdir_path):
    for name in "u/a.sas", "v/b.sas", "w.sas":
        os.makedirs(os.path.dirname(f"{tmpdir_path}/c/{name}"), exist_ok=True)
        with open(f"{tmpdir_path}/c/{name}", "w") as f:
            f.write(name)
    texts = lambda path: sorted(r.text for r in corpus.corpus_scan(spark, path).collect())
    assert texts(tmpdir_path + "/c/*") == ["u/a.sas", "v/b.sas", "w.sas"]
    assert texts(tmpdir_path + "/c/w.sas") == texts(tmpdir_path + "/c") == ["w.sas"]
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.scripts.link./all", "file://" + tmpdir_path)
    assert texts("viewfs://scripts/all/c/u") == ["u/a.sas"]


def test_script_files_written_in_slices_hold_every_script(spark, tmpdir_path, monkeypatch):
    monkeypatch.setattr(fx, "SCRIPTS_A_FOLDER", 4)
    rows = [(i, f"data t{i};") for i in range(300)] + [(5, "again"), (None, "a"), (None, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(tmpdir_path + "/documents.parquet")
    folder = fx.script_files(spark, tmpdir_path).removeprefix("file:")
    numbers = [int(f.removeprefix("part=")) for f in os.listdir(folder) if f.startswith("part=")]
    assert 4 * spark.sparkContext.defaultParallelism < len(numbers) <= 75 and max(numbers) < 75
    lines = {}
    for i, t in rows:
        lines[i] = lines.get(i, ()) + ((t or ""),)
    got = [(r.script_id, tuple(sorted(r.text.splitlines()))) for r in corpus_scan(spark, tmpdir_path).collect()]
    assert len(got) == len(lines) and dict(got) == {i: tuple(sorted(t)) for i, t in lines.items()}
