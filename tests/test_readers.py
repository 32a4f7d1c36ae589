import random

import pytest

from rill import DataType, Frame, c, derive, groupBy, keep, read_csv, read_parquet, select, write_csv, write_parquet
from rill.functions import types as Y


@pytest.fixture
def file(tmp_path, spark):
    def make(text, name="t.csv"):
        p = tmp_path / name
        p.write_text(text)
        return str(p)

    return make


def columns(f):
    return {n: f.get_col(n).values for n in f.colnames()}


def test_types_and_missing_tokens(file):
    f = read_csv(file("i,f,b,s,m,z\n1,1,Y,x,true,\n NA ,2.5,n,n/a,1,na\n007,,TRUE,.,None,NULL\n"))
    assert f.schema == (DataType.INT64, DataType.FLOAT64, DataType.BOOLEAN, DataType.STRING, DataType.STRING, DataType.STRING)
    got = columns(f)
    assert got["i"] == (1, None, 7) and got["f"] == (1.0, 2.5, None) and got["b"] == (True, False, True)
    assert got["s"] == ("x", "n/a", ".") and got["m"] == ("true", "1", "None") and got["z"] == (None, None, None)


def test_padded_numbers_leave_text(file):
    assert columns(read_csv(file("a\n 5\n7\nNA\n")))["a"] == (" 5", "7", "NA")


def test_names_and_rows(file):
    assert read_csv(file("a,a,a\n1,2,3\n")).colnames() == ["a", "a_1", "a_2"]
    with pytest.raises(ValueError):
        read_csv(file("a,a,a_1\n1,2,3\n"))
    assert columns(read_csv(file("1,x\n2,y\n"), header=False)) == {"x_0": (1, 2), "x_1": ("x", "y")}
    assert columns(read_csv(file("junk\nmore,junk\na,b\n1,x\n"), skip=2)) == {"a": (1,), "b": ("x",)}
    assert columns(read_csv(file("junk\n1,x\n"), header=False, skip=1)) == {"x_0": (1,), "x_1": ("x",)}
    only = read_csv(file("a,b\n"))
    assert only.dims() == (2, 0) and only.schema == (DataType.STRING,) * 2


def test_quotes_and_ragged_rows(file):
    f = read_csv(file('a,b\n"x, ""y""",1\n"two\nlines",2\n'))
    assert columns(f) == {"a": ('x, "y"', "two\nlines"), "b": (1, 2)}
    assert columns(read_csv(file("a,b\n1\n2,3\n")))["b"] == (None, 3)
    with pytest.raises(ValueError):
        read_csv(file("a,b\n1,2,3\n"))


@pytest.mark.parametrize("multiline", [None, True])
def test_skipped_lines_before_quoted_line_breaks(file, multiline):
    """The first lines go as lines, whatever they hold; behind them values keep their line breaks."""
    body = 's,n,t\n"two\nlines",1,"a ""b"" c"\n,2,"x,\n\ny"\nplain,3,\n"""",4\n'
    f = read_csv(file(f"made by 5\" of rain\nmore,junk\n{body}"), skip=2, multiline=multiline)
    want = columns(read_csv(file(body, "u.csv")))
    got = columns(f)
    assert got["s"] == ("two\nlines", want["s"][1], "plain", '"') and got["n"] == (1, 2, 3, 4)
    assert got["t"] == ('a "b" c', "x,\n\ny", *want["t"][2:]) and f.schema == read_csv(file(body, "v.csv")).schema
    assert columns(read_csv(file('junk\n"a\nb",1\nc,2\n'), header=False, skip=1, multiline=multiline)) == {"x_0": ("a\nb", "c"), "x_1": (1, 2)}
    with pytest.raises(ValueError):
        read_csv(file('junk\na,b\n"x\ny",1,2\n'), skip=1, multiline=multiline)


def test_inference_equals_the_plain_rules(file):
    rnd = random.Random(1)
    pool = ["1", "-2", "+3", "1.5", ".5", "5.", "1e3", "1e", "inf", "true", "F", "yes", "no", "0", "NA", "", "null", "x", "1d", "٣"]
    for k in range(12):
        cells = [rnd.choice(pool[: rnd.choice([4, 8, 13, 20])]) for _ in range(6)]
        f = read_csv(file("h,k\n" + "".join(f"{x},1\n" for x in cells), f"r{k}.csv"))
        want = Y.guess(cells) or DataType.STRING
        assert f.schema[0] == want, cells
        if want != DataType.STRING:
            assert list(f.get_col("h")) == [None if Y.is_missing(x) else Y.PARSERS[want](x) for x in cells]


def test_lattice():
    assert Y.join(DataType.INT64, DataType.FLOAT64) == DataType.FLOAT64 and Y.join(DataType.DATE, DataType.DATETIME) == DataType.DATETIME
    assert Y.join(DataType.BOOLEAN, DataType.INT64) == DataType.STRING and Y.infer(" 007 ") == DataType.INT64
    assert Y.guess([None, "na"]) is None and Y.guess([True, False]) == DataType.BOOLEAN and Y.guess([1, "b", 3.0]) == DataType.STRING


def test_round_trips(tmp_path, spark):
    f = Frame.from_list([["x", None, 'a "b", c'], [1, 2, None]], ["s", "n"])
    write_parquet(f, str(tmp_path / "p"))
    write_csv(f, str(tmp_path / "c"))
    key = lambda r: str(r)
    want = sorted(map(tuple, f.sdf.collect()), key=key)
    assert sorted(map(tuple, read_parquet(str(tmp_path / "p")).sdf.collect()), key=key) == want
    assert sorted(map(tuple, read_csv(str(tmp_path / "c")).sdf.collect()), key=key) == want


def test_filters_and_columns_reach_the_scan(spark, small, capsys):
    lines = read_parquet(f"{small}/lineitem.parquet")
    p = lines >> derive(net=c("l_extendedprice") * 0.9) >> select("l_orderkey", "net", "l_quantity") >> keep((c("l_quantity") > 45) & (c("l_orderkey") > 10))
    p.explain()
    plan = capsys.readouterr().out
    assert "GreaterThan(l_quantity,45" in plan and "GreaterThan(l_orderkey,10" in plan
    assert "l_shipdate" not in plan.split("ReadSchema:")[1].split("\n")[0]


def test_streams(spark, small, tmp_path):
    from rill.streaming.streams import on_stream, read_stream, windowed

    events = spark.read.parquet(f"{small}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = read_stream(str(tmp_path / "in"), events.schema, 1)
    kept = on_stream(keep(c("value") > 10) >> derive(double=c("value") * 2), stream)
    out = windowed(kept, "ts", "1 day", "1 hour", ("event_type",), "double")
    q = out.writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    static = windowed((Frame(events) >> keep(c("value") > 10) >> derive(double=c("value") * 2)).execute(), "ts", "1 day", "1 hour", ("event_type",), "double")
    near = lambda rows: sorted((r.start, r.event_type, r.n, round(r.total, 6)) for r in rows)
    assert near(spark.table("w").collect()) == near(static.collect())
    with pytest.raises(ValueError):
        on_stream(groupBy("user_id"), stream)
