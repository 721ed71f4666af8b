from datetime import date

import pytest

from sparkloom.plans import daily
from sparkloom.sources import io


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_formats(spark, tmp_path):
    (tmp_path / "p.csv").write_text("name;age;job\nJorge;30;Developer\nBob;32;Developer\n")
    assert rows(io.csv(spark, str(tmp_path / "p.csv"))) == [("Bob", 32, "Developer"), ("Jorge", 30, "Developer")]
    (tmp_path / "p.json").write_text('{"name":"Michael"}\n{"name":"Andy","age":30}\n')
    assert io.json_lines(spark, str(tmp_path / "p.json")).count() == 2
    (tmp_path / "p.txt").write_text("Michael, 29\nAndy, 30\nbroken\n")
    assert rows(io.delimited(spark, str(tmp_path / "p.txt"), ",", "name string, age int")) == [("Andy", 30), ("Michael", 29)]
    assert io.lines(spark, f"{tmp_path}/p.txt,{tmp_path}/p.csv").count() == 6
    df = spark.createDataFrame([("a", [1, 2])], "name string, n array<int>")
    io.save(df, str(tmp_path / "q"))
    assert rows(io.query_file(spark, str(tmp_path / "q"))) == rows(io.load(spark, str(tmp_path / "q"))) == [("a", [1, 2])]
    with pytest.raises(Exception, match="(?i)exists"):
        io.save(df, str(tmp_path / "q"))


def test_text_sinks(spark, tmp_path):
    df = spark.createDataFrame([("k1", 1), ("k2", None)], "k string, v int")
    io.save_tuples(df, str(tmp_path / "a"))
    assert rows(spark.read.text(str(tmp_path / "a"))) == [("(k1,1)",), ("(k2,null)",)]
    io.save_json(df, str(tmp_path / "b"))
    assert rows(io.json_lines(spark, str(tmp_path / "b"), "k string, v int")) == [("k1", 1), ("k2", None)]
    io.save_by_prefix(spark.createDataFrame([("abc", "1"), ("abd", "2"), ("xyz", "3")], "k string, v string"), str(tmp_path / "c"), "k", "v")
    assert {p.name for p in (tmp_path / "c").iterdir() if p.is_dir()} == {"prefix=ab", "prefix=xy"}
    with pytest.raises(Exception, match="key too short"):
        io.save_by_prefix(spark.createDataFrame([("a", "1")], "k string, v string"), str(tmp_path / "d"), "k", "v")


def test_sequence_files(spark, tmp_path):
    io.numbers_sequence(spark, str(tmp_path / "s"), 5)
    got = io.sequence_file(spark, str(tmp_path / "s"))
    assert sorted(r["key"] for r in got.collect()) == ["cat1", "cat2", "cat3", "cat4"]
    assert io.non_empty(spark, str(tmp_path / "s")) and not io.non_empty(spark, str(tmp_path / "none*"))


def test_store_sinks(spark, tmp_path):
    path = str(tmp_path / "store")

    def connect(path=path):
        class Store:
            def _line(self, *x):
                with open(path, "a") as f:
                    f.write(" ".join(map(str, x)) + "\n")

            def incr(self, key, n):
                self._line(key, n)

            def hincr(self, key, field, n):
                self._line(key, field, n)

            def put(self, key, value):
                self._line(key, value)

        return Store()

    io.increment(spark.createDataFrame([("u", 2)], "k string, n int"), "k", "n", connect)
    io.increment_fields(spark.createDataFrame([("ad", 1, 0), ("ad", 2, 0)], "ad string, show int, click int"), "ad", ["show", "click"], connect)
    io.put_absolute(spark.createDataFrame([("w1", "u", 5)], "w string, k string, n int"), ["w", "k"], "n", connect)
    assert sorted(open(path).read().split("\n")[:-1]) == ["ad show 3", "u 2", "w1|u 5"]
    assert io.batch_banner(spark.createDataFrame([("a", 1)], "k string, v int"), 3).startswith("---- batch 3")


def test_daily_job(spark, tmp_path):
    visit = "\x01".join(["adsl1", "1.1.1.1", "http://a.com/x", "", "Acer phone", "x", "y"])
    for day, lines in (("20240102", [visit, visit]), ("20240101", [])):
        if lines:
            (tmp_path / f"in-{day}").mkdir()
            (tmp_path / f"in-{day}" / "part").write_text("\n".join(lines))
    (tmp_path / "out-20240101" / "prefix=ad").mkdir(parents=True)
    (tmp_path / "out-20240101" / "prefix=ad" / "part").write_text("adsl1\told:0.50\n")
    urls = spark.createDataFrame([("a.com", ["t"])], "pattern string, tags array<string>")
    agents = spark.createDataFrame([("Acer", ["phone"])], "pattern string, tags array<string>")
    out = daily.run_day(spark, [f"{tmp_path}/in-{{day}}"], f"{tmp_path}/out-{{day}}", urls, agents, date(2024, 1, 2))
    (line,) = [r[0] for r in spark.read.format("text").load(out).select("value").collect()]
    assert line.startswith("adsl1\t") and {x.split(":")[0] for x in line.split("\t")[1].split(",")} == {"t", "phone", "old"}
    with pytest.raises(FileNotFoundError):
        daily.run_day(spark, [f"{tmp_path}/in-{{day}}"], f"{tmp_path}/out-{{day}}", urls, agents, date(2024, 5, 2))
    (tmp_path / "c.ini").write_text("[a]\nx = 1\n[b]\ny = 2\n")
    assert daily.read_config(str(tmp_path / "c.ini")) == {"x": "1", "y": "2"}
    assert daily.run_jobs([lambda i=i: i * i for i in range(4)], 2) == [0, 1, 4, 9]

