import datetime as dt
import os
import zipfile

import pytest

from cleanframe.sources.csv import append_csv, infer_types, read_csv, write_csv
from cleanframe.sources.dump import read_dump
from cleanframe.sources.load import load
from tests.conftest import rows

SAMPLES = {"cars.csv": "paint,model\nred,fox\nblack,lynx\n", "cars2.csv": "paint,model\ngreen,hare\nwhite,mole",
           "boats/sail.csv": "paint,model\nblue,gull\n", "boats/motor.csv": "model,year,port\ntern,1999\n"}


def write(folder, name, text):
    path = os.path.join(folder, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as out:
        out.write(text)
    return path


@pytest.fixture
def folder(tmp_path):
    for name, text in SAMPLES.items():
        write(str(tmp_path), name, text)
    return str(tmp_path)


def test_csv(spark, folder):
    df = read_csv(spark, f"{folder}/cars.csv")
    assert df.dtypes == [("id", "bigint"), ("paint", "string"), ("model", "string")]
    assert rows(df) == [(1, "red", "fox"), (2, "black", "lynx")]
    more = append_csv(df, f"{folder}/cars2.csv")
    assert rows(more)[2:] == [(3, "green", "hare"), (4, "white", "mole")]
    assert rows(read_csv(spark, f"{folder}/boats/motor.csv")) == [(1, "tern", "1999", None)]
    with pytest.raises(ValueError, match="lacks columns"):
        append_csv(df, f"{folder}/boats/motor.csv")


def test_too_long_rows(spark, folder):
    with pytest.raises(Exception, match="more values than the header"):
        read_csv(spark, write(folder, "wide.csv", "a,b\n1,2\n1,2,3\n"))
    assert rows(read_csv(spark, write(folder, "comma.csv", "a,b\n1,2,\n"))) == [(1, "1", "2")]
    path = os.path.join(folder, "wide.zip")
    with zipfile.ZipFile(path, "w") as archive:
        archive.writestr("wide.csv", "a,b\n1,2\n1,2,3\n")
    with pytest.raises(Exception, match="more values than the header"):
        load(spark, path)["wide"].collect()


def test_csv_types(spark, folder):
    path = write(folder, "typed.csv", 'n,x,b,t,"a ""s""",m,e\n1,1.5,True,2018-03-04,x,7,\n2,NA,False,03/05/2018,2018,x,\n,2e3,True,,y,1,\n')
    df = read_csv(spark, path, typed=True)
    assert df.dtypes[1:] == [("n", "bigint"), ("x", "double"), ("b", "boolean"), ("t", "timestamp_ntz"), ("a s", "string"),
                             ("m", "string"), ("e", "string")]
    assert rows(df)[1] == (2, 2, None, False, dt.datetime(2018, 3, 5), "2018", "x", None)
    text = read_csv(spark, path)
    assert rows(text, "n", "t")[0] == ("1", "2018-03-04 00:00:00")
    assert infer_types(text.select("m")) == {"m": "string"}


def test_csv_ids_follow_the_file(spark, folder):
    path = write(folder, "long.csv", "v\n" + "".join(f"r{i}\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = read_csv(spark, path)
        assert df.rdd.getNumPartitions() >= 1
        assert all(r["v"] == f"r{r['id'] - 1}" for r in df.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_quoted_line_end(spark, folder):
    path = write(folder, "multi.csv", 'a,b\n"one\ntwo",3\n')
    assert rows(read_csv(spark, path, multiline=True)) == [(1, "one\ntwo", "3")]


def test_export(spark, folder):
    df = spark.createDataFrame([(1, "a;b", 'say "hi"'), (2, None, ""), (3, "it's", " pad ")], "id long, x string, y string")
    out = os.path.join(folder, "out")
    write_csv(df.coalesce(1), out, ";", '"', "-")
    text = "".join(open(os.path.join(out, f)).read() for f in sorted(os.listdir(out)) if f.endswith(".csv"))
    assert text.splitlines() == ['"x";"y"', '"a;b";"say ""hi"""', '"-";"-"', '"it\'s";" pad "']
    plain = os.path.join(folder, "plain")
    write_csv(df.coalesce(1), plain, None, None, None)
    text = "".join(open(os.path.join(plain, f)).read() for f in sorted(os.listdir(plain)) if f.endswith(".csv"))
    assert text.splitlines()[2] == '"",""'


def test_zip(spark, folder):
    path = os.path.join(folder, "all.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for name, text in SAMPLES.items():
            archive.writestr(f"data/{name}", text)
        archive.writestr("more/cars.csv", "model,paint\nlast,grey\n")
        archive.writestr("readme.txt", "no table")
    tables = load(spark, path)
    assert sorted(tables) == ["cars", "cars2", "motor", "sail"]
    assert rows(tables["cars"]) == [(1, "red", "fox"), (2, "black", "lynx"), (3, "grey", "last")]
    assert rows(tables["motor"]) == [(1, "tern", "1999", None)]


DUMP = """DROP TABLE fruit;
INSERT INTO fruit (name, taste) VALUES ('apple pie', 'sweet'), ('lemon', NULL), ('it''s (new)', '');
DELETE FROM fruit;
INSERT INTO "other" VALUES (1, 'a'),
  (2, 'b, c');
INSERT INTO fruit (taste) VALUES ('sour');
"""


def test_dump(spark, folder):
    tables = load(spark, write(folder, "fruit.sql", DUMP))
    assert rows(tables["fruit"]) == [(1, "apple pie", "sweet"), (2, "lemon", None), (3, "it's (new)", None), (4, None, "sour")]
    assert rows(tables["other"]) == [(1, "1", "a"), (2, "2", "b, c")]
    assert read_dump(spark, write(folder, "none.dump", "DELETE FROM x;")) == {}


def test_dispatch(spark, folder):
    assert list(load(spark, f"{folder}/cars.csv")) == ["cars"]
    assert list(load(spark, f"{folder}/cars.csv", "cats")) == ["cats"]
    with pytest.raises(ValueError, match="cannot load"):
        load(spark, "table.xlsx")


def test_dump_with_quotes(spark, folder):
    long = "x''y;(z)" * 150_000
    path = write(folder, "hard.sql", "INSERT INTO t VALUES (1,'one'),(2,'tw;o'),(3,'th\nree');\nDELETE FROM t;\n"
                 f"INSERT INTO t VALUES (4,'{long}'),(5,lower('A, B')),(6,'');INSERT INTO t VALUES (7,'a;'),(8,';b');")
    got = {r["col1"]: r["col2"] for r in read_dump(spark, path, id_col=None)["t"].collect()}
    assert got == {"1": "one", "2": "tw;o", "3": "th\nree", "4": long.replace("''", "'"), "5": "lower('A, B')", "6": None,
                   "7": "a;", "8": ";b"}
    with pytest.raises(Exception, match="not closed|text between"):
        read_dump(spark, write(folder, "slash.sql", r"INSERT INTO t VALUES (4,'it\'s'),(5,'f'),(6,'x''');"))
    with pytest.raises(Exception, match="quote is not closed"):
        read_dump(spark, write(folder, "odd.sql", "INSERT INTO t VALUES (1,'a);"))


def test_csv_with_quoted_line_ends(spark, folder):
    path = write(folder, "lines.csv", 'a,b\n"one\ntwo",3\n"say ""x""",4\n')
    assert rows(read_csv(spark, path)) == [(1, "one\ntwo", "3"), (2, 'say "x"', "4")]
    assert rows(load(spark, path)["lines"]) == rows(read_csv(spark, path))


def test_load_appends(spark, folder):
    cars = load(spark, f"{folder}/cars.csv")["cars"]
    more = load(spark, f"{folder}/cars2.csv", "cars", existing={"cars": cars})["cars"]
    assert rows(more, "id") == [(1,), (2,), (3,), (4,)]
    with pytest.raises(ValueError, match="no such table"):
        load(spark, f"{folder}/cars2.csv", "cats", existing={"cars": cars}, append=True)
    with pytest.raises(ValueError, match="exist already"):
        load(spark, f"{folder}/cars2.csv", "cars", existing={"cars": cars}, append=False)


@pytest.mark.parametrize("size", [700, 6000, 100_000])
def test_csv_with_quoted_line_ends_in_many_splits(spark, folder, size):
    """Rows cut by any split, values longer than a split, empty lines, quotes inside, \\r\\n, and a second file."""
    import csv
    import random
    rng = random.Random(size)

    def value():
        return "".join(rng.choice(["a", "b", ",", '"', "\n", " ", "é", "line\n\nend"]) for _ in range(rng.choice([1, 3, 8, 300]))) + "x"

    want = []
    for name, end in (("a.csv", "\n"), ("b.csv", "\r\n")):
        table = [(f"r{i}", value(), value()) for i in range(60)]
        path = os.path.join(folder, "many", name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w", newline="") as out:
            writer = csv.writer(out, lineterminator=end)
            writer.writerow(["k", "first", "second"])
            for i, row in enumerate(table):
                writer.writerow(row)
                if i % 20 == 0:
                    out.write(end)
        want += table
    settings = {"spark.sql.files.maxPartitionBytes": str(size), "spark.sql.files.openCostInBytes": "1"}
    for key, v in settings.items():
        spark.conf.set(key, v)
    try:
        tasks = spark.read.text(os.path.join(folder, "many", "a.csv")).rdd.getNumPartitions()
        got = rows(read_csv(spark, os.path.join(folder, "many")))
    finally:
        for key in settings:
            spark.conf.unset(key)
    assert [r[0] for r in got] == list(range(1, 121)) and [r[1:] for r in got] == want
    assert size > 6000 or tasks > 1
