"""SRC-1..5, SNK-1..3, CHK-1..3."""

import csv as text_csv
import glob
import io
import os
import random

import pandas as pd
import pytest

from intentspark.operators.checks import ContractError, require_rows
from intentspark.sources import csv as csv_io
from intentspark.sources import csv_records
from intentspark.sources import intents_table as intents
from intentspark.sources.csv_records import survey

FIXTURE = (b'Id,Sentence,Category\n'
           b'0,caf\xe9 bar,PlayMusic\n'
           b'1,"say ""hi"", ok",RateBook\n'
           b'2," lead trail ",GetWeather\n'
           b'3,"two\nlines",RateBook\n'
           b'4,,PlayMusic\n'
           b'5,"",PlayMusic\n'
           b'6,NA,RateBook\n'
           b'7,"NA",RateBook\n')


def _write(tmp_dir, data: bytes, name="in.csv"):
    p = os.path.join(tmp_dir, name)
    with open(p, "wb") as f:
        f.write(data)
    return p


def test_lenient_read_matches_pandas(spark, tmp_dir):
    path = _write(tmp_dir, FIXTURE)
    got = {r["Id"]: (r["Sentence"], r["Category"]) for r in csv_io.read_sentences(spark, path).collect()}
    pdf = pd.read_csv(io.BytesIO(FIXTURE), encoding="utf-8", engine="python", encoding_errors="replace")
    want = {int(r.Id): (None if pd.isna(r.Sentence) else r.Sentence, r.Category) for r in pdf.itertuples()}
    assert got == want
    assert got[0][0] == "caf� bar"
    assert got[1][0] == 'say "hi", ok' and got[2][0] == " lead trail " and got[3][0] == "two\nlines"
    assert all(got[i][0] is None for i in (4, 5, 6, 7))


def test_strict_read_rejects_bad_bytes(spark, tmp_dir):
    path = _write(tmp_dir, FIXTURE)
    with pytest.raises(csv_io.InvalidUtf8Error):
        csv_io.read_sentences(spark, path, strict=True)
    ok = _write(tmp_dir, FIXTURE.replace(b"caf\xe9", b"cafe"), "ok.csv")
    assert csv_io.read_sentences(spark, ok, strict=True).count() == 8


def test_header_variants(spark, tmp_dir):
    reordered = _write(tmp_dir, b"Category,Id,Sentence\nRateBook,3,hello\n", "r.csv")
    r = csv_io.read_sentences(spark, reordered).first()
    assert (r["Id"], r["Sentence"], r["Category"]) == (3, "hello", "RateBook")
    extra = _write(tmp_dir, b"Id,Foo,Sentence,Category\n1,z,hi,PlayMusic\n", "e.csv")
    assert csv_io.read_sentences(spark, extra).columns == ["Id", "Sentence", "Category"]
    missing = _write(tmp_dir, b"Id,Sentence\n1,hi\n", "m.csv")
    with pytest.raises(ContractError) as e:
        csv_io.read_sentences(spark, missing)
    assert "['Id', 'Sentence', 'Category']" in str(e.value) and "['Id', 'Sentence']" in str(e.value)
    assert csv_io.read_sentences(spark, missing, labelled=False).count() == 1
    header_only = _write(tmp_dir, b"Id,Sentence,Category\n", "h.csv")
    with pytest.raises(ContractError):
        require_rows(csv_io.read_sentences(spark, header_only))


@pytest.fixture()
def tiny_splits(spark):
    """Splits of some 100 bytes, so that records and even lines cross them."""
    conf = {"spark.sql.files.maxPartitionBytes": "100", "spark.sql.files.openCostInBytes": "0"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k in conf:
        spark.conf.unset(k)


def as_csv(rows, header=("Id", "Sentence", "Category"), end="\n"):
    out = io.StringIO()
    w = text_csv.writer(out, lineterminator=end)
    w.writerows([header, *rows])
    return out.getvalue().encode()


def test_one_quoted_file_is_read_by_many_tasks(spark, tmp_dir, tiny_splits):
    rng = random.Random(5)
    bits = ["word", "\n", '"', ",", " ", "é", "x\ny", '""', "\n\n", "longer text without anything"]
    rows = [(str(i), "v" + "".join(rng.choices(bits, k=rng.randint(0, 12))), f"c{i % 3}") for i in range(120)]
    rows += [("900", "line\n" * 60 + "end", "c")]  # over many splits
    path = _write(tmp_dir, as_csv(rows))
    got = csv_io.read_sentences(spark, path)
    want = {int(i): (s, c) for i, s, c in rows}
    assert {r["Id"]: (r["Sentence"], r["Category"]) for r in got.collect()} == want
    splits = survey(spark, path)
    assert len(splits.inside) > 8 and splits.any_open
    assert csv_records._lines(spark, path).rdd.getNumPartitions() > 30
    one_task = spark.read.options(header=True, multiLine=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False,
                                  ignoreTrailingWhiteSpace=False).csv(path)
    assert {int(r[0]): (r[1], r[2]) for r in one_task.collect()} == want


@pytest.mark.parametrize("data, want", [
    (b'Id,Sentence,Category\r\n1,"a\r\nb",x\r\n\r\n2,c,y\r\n', {1: ("a\r\nb", "x"), 2: ("c", "y")}),
    (b'Id,Sentence,Category\n1,5" pipe,x\n2,a"b"c,y\n3,"q\nr",z', {1: ('5" pipe', "x"), 2: ('a"b"c', "y"), 3: ("q\nr", "z")}),
    (b'\xef\xbb\xbfId,Sentence,Category\n1,"two\nlines",x\n', {1: ("two\nlines", "x")}),
    (b'"Id","Sentence","Category"\n1,"","x"\n2,"a\n","y"\n', {1: (None, "x"), 2: ("a\n", "y")}),
    (b'Id,"Foo\nBar",Sentence,Category\n1,z,hello,x\n', {1: ("hello", "x")}),
])
def test_quoted_corner_cases(spark, tmp_dir, data, want):
    got = {r["Id"]: (r["Sentence"], r["Category"]) for r in csv_io.read_sentences(spark, _write(tmp_dir, data)).collect()}
    assert got == want


def test_files_with_their_own_headers(spark, tmp_dir, tiny_splits):
    plain = os.path.join(tmp_dir, "plain")
    quoted = os.path.join(tmp_dir, "quoted dir")
    for folder, text in ((plain, "play it"), (quoted, "play\nit")):
        os.makedirs(folder)
        _write(folder, as_csv([("1", text, "PlayMusic"), ("2", "b", "RateBook")]), "a.csv")
        _write(folder, as_csv([("3", "RateBook", "world"), ("4", "PlayMusic", text)], ("Id", "Category", "Sentence")), "b.csv")
        _write(folder, as_csv([("z", "n", "5", "x")], ("Foo", "Sentence", "Id", "Category")), "c d%20.csv")
        _write(folder, as_csv([]), "none.csv")
        got = {r["Id"]: (r["Sentence"], r["Category"]) for r in csv_io.read_sentences(spark, folder).collect()}
        assert got == {1: (text, "PlayMusic"), 2: ("b", "RateBook"), 3: ("world", "RateBook"), 4: (text, "PlayMusic"), 5: ("n", "x")}
    single = csv_io.read_sentences(spark, plain, multi_line=False)
    assert {r["Id"] for r in single.collect()} == {1, 2, 3, 4, 5}
    _write(plain, as_csv([("9", "x")], ("Id", "Other")), "bad.csv")
    with pytest.raises(ContractError):
        csv_io.read_sentences(spark, plain)


def test_surplus_fields_fail_either_way(spark, tmp_dir):
    for i, data in enumerate((b"Id,Sentence,Category\n1,a,b,c\n", b'Id,Sentence,Category\n1,"a\nb",b,c\n')):
        with pytest.raises(Exception, match="more fields"):
            csv_io.read_sentences(spark, _write(tmp_dir, data, f"{i}.csv")).collect()
    with pytest.raises(ContractError):
        csv_io.read_sentences(spark, _write(tmp_dir, b"", "nothing.csv"))


@pytest.mark.parametrize("line, inside, after", [
    ("a,b", False, False), ('"a', False, True), ('a"', True, False), ('a,"b', True, False), ('"a""', False, True),
    ('"a""b",c', False, False), ('x"y', False, False), ('"a"b,"c', False, True), ('', True, True), ('","', False, False),
    ('","', True, True), ('""', False, False), ('""', True, True), ('a,', False, False), ('"', False, True), ('"', True, False)])
def test_line_states(line, inside, after):
    assert csv_records.ends_inside(line, inside) is after


def test_missing_path(spark, tmp_dir):
    with pytest.raises(FileNotFoundError):
        csv_io.read_sentences(spark, os.path.join(tmp_dir, "nope.csv"))


def test_csv_sink_matches_pandas(spark, tmp_dir):
    rows = [(1, " a ", "x"), (2, 'say "hi", ok', "y"), (3, "", "z"), (4, None, "w"), (5, "two\nlines", "v")]
    df = spark.createDataFrame(rows, "Id long, Sentence string, Category string").coalesce(1)
    out = os.path.join(tmp_dir, "out")
    csv_io.write_csv(df, out)
    text = "".join(open(p, encoding="utf-8").read() for p in sorted(glob.glob(f"{out}/part-*.csv")))
    want = pd.DataFrame(rows, columns=["Id", "Sentence", "Category"]).to_csv(index=False)
    assert text == want


def test_submission_sorted_and_cast(spark, tmp_dir):
    df = spark.createDataFrame([(str(i), c) for i, c in [(5, "A"), (1, "B"), (3, "C")]],
                               "Id string, Category string")
    out = os.path.join(tmp_dir, "sub")
    csv_io.write_submission(df, out)
    back = csv_io.read_sentences(spark, out, columns=("Id", "Category")).collect()
    text = "".join(open(p).read() for p in sorted(glob.glob(f"{out}/part-*.csv")))
    ids = [int(line.split(",")[0]) for line in text.splitlines() if not line.startswith("Id")]
    assert ids == [1, 3, 5] and len(back) == 3
    bad = spark.createDataFrame([("x1", "A")], "Id string, Category string")
    with pytest.raises(Exception):
        csv_io.write_submission(bad, os.path.join(tmp_dir, "bad"))


def test_table_replace_keeps_declared_types(spark, tmp_dir):
    name = "intents_test"
    rows3 = [(1, "a", "PlayMusic"), (2, "b", "RateBook"), (3, "c", "GetWeather")]
    df3 = spark.createDataFrame(rows3, "Id long, Sentence string, Category string")
    ddl = "Id INT, Sentence VARCHAR(1024), Category VARCHAR(128)"
    intents.replace_table(df3, name, f"{tmp_dir}/t", ddl)
    df2 = spark.createDataFrame(rows3[:2], "Id long, Sentence string, Category string")
    intents.replace_table(df2, name, f"{tmp_dir}/t", ddl)
    back = intents.read_table_query(spark, name)
    assert sorted(tuple(r) for r in back.collect()) == [(1, "a", "PlayMusic"), (2, "b", "RateBook")]
    types = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE TABLE {name}").collect()}
    assert types["Id"] == "int" and types["Sentence"] == "varchar(1024)" and types["Category"] == "varchar(128)"
    assert spark.sql(f"SELECT Id FROM {name} WHERE Sentence = 'b'").first()[0] == 2
    too_long = spark.createDataFrame([(9, "x" * 1025, "A")], "Id long, Sentence string, Category string")
    with pytest.raises(Exception):
        intents.replace_table(too_long, name, f"{tmp_dir}/t2", ddl)


def test_table_holds_any_id_and_text(spark, tmp_dir):
    rows = [(3_000_000_000, "x" * 1500, "PlayMusic"), (1, None, None)]
    intents.replace_table(spark.createDataFrame(rows, "Id long, Sentence string, Category string"),
                          "intents_wide", f"{tmp_dir}/wide")
    assert sorted(map(tuple, intents.read_table_query(spark, "intents_wide").collect())) == sorted(rows)


def test_strict_rejects_malformed_rows(spark, tmp_dir):
    bad = _write(tmp_dir, b'Id,Sentence,Category\n1,"ok",PlayMusic\n2,"a","b",c,d\n', "bad.csv")
    with pytest.raises(Exception):
        csv_io.read_sentences(spark, bad, strict=True).collect()
    # lenience is about bytes: a row with too many fields fails here too
    with pytest.raises(Exception, match="more fields than the header"):
        csv_io.read_sentences(spark, bad).collect()


@pytest.mark.parametrize("multi_line", [True, False])
def test_surplus_fields_fail_and_short_rows_are_null(spark, tmp_dir, multi_line):
    shifted = _write(tmp_dir, b"Id,Sentence,Category\n1,hello, world,RateBook\n", "shifted.csv")
    with pytest.raises(Exception, match="more fields than the header"):
        csv_io.read_sentences(spark, shifted, multi_line=multi_line).count()
    short = _write(tmp_dir, b"Id,Sentence,Category\n1,hello\n2\n3,a,PlayMusic\n", "short.csv")
    got = csv_io.read_sentences(spark, short, multi_line=multi_line).collect()
    assert sorted(map(tuple, got), key=lambda r: r[0]) == [(1, "hello", None), (2, None, None), (3, "a", "PlayMusic")]


def test_single_line_mode_splits_large_files(spark, tmp_dir):
    rows = "".join(f"{i},sentence number {i},PlayMusic\n" for i in range(20000))
    path = _write(tmp_dir, ("Id,Sentence,Category\n" + rows).encode(), "big.csv")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        df = csv_io.read_sentences(spark, path, multi_line=False)
        assert df.rdd.getNumPartitions() > 1
        assert df.count() == 20000 and df.filter("Id = 19999").first()["Sentence"] == "sentence number 19999"
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_a_failed_write_leaves_the_old_table(spark, tmp_dir):
    name, ddl = "intents_atomic", "Id INT, Sentence VARCHAR(8), Category VARCHAR(8)"
    df = lambda rows: spark.createDataFrame(rows, "Id long, Sentence string, Category string")
    intents.replace_table(df([(1, "a", "x")]), name, f"{tmp_dir}/t", ddl)
    many = df([(i, "a" if i < 900 else "far too long", "x") for i in range(1000)]).repartition(20)  # fails half-way
    with pytest.raises(Exception):
        intents.replace_table(many, name, f"{tmp_dir}/t", ddl)
    read = lambda: sorted(map(tuple, intents.read_table_query(spark, name).collect()))
    assert read() == [(1, "a", "x")]
    intents.replace_table(intents.read_table_query(spark, name).selectExpr("Id + 1 AS Id", "Sentence", "Category"),
                          name, f"{tmp_dir}/t", ddl)  # from itself
    assert read() == [(2, "a", "x")]
    intents.replace_table(df([(3, "longer than before", "x")]), name, f"{tmp_dir}/t")  # other columns
    assert read() == [(3, "longer than before", "x")]
    assert [r[1] for r in spark.sql("SHOW TABLES LIKE 'intents_atomic*'").collect()] == [name]
