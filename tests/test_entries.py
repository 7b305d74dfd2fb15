import pytest
from weftline.functions import values as V
from weftline.operators import entries
from weftline.sources.lines import explode_lines, split_lines
from pyspark.sql import functions as F


def parse(spark, text, mode="true"):
    lines = explode_lines(spark.createDataFrame([("f", text)], "path string, text string"))
    return entries.parse_entries(lines, mode)


def as_map(spark, text, mode="true"):
    rows = entries.fail_on_error(parse(spark, text, mode))
    out = {}
    for r in entries.last_wins(rows).orderBy("seq").collect():
        v = r["value"]
        out[r["key"]] = {"bool": v["b"], "str": v["s"], "int": None if v["i"] is None else int(v["i"]), "float": v["n"]}[v["tag"]]
    return rows.count(), out


def test_lines_end_as_in_python(spark):
    texts = ["", "a", "a\n", "a\r\nb\rc", "a\x0bb\x0cc\x1cd\x1de\x1ef\x85g\u2028h\u2029i", "\n\n", "a\x1fb", "x\n\n"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", split_lines(F.col("t")).alias("x"))
    for t, x in df.collect():
        assert x == t.splitlines(), repr(t)


def test_presence_mode(spark):
    assert as_map(spark, "# top\nalpha    # trailing\n\n   \nbeta\nalpha\n") == (3, {"alpha": True, "beta": True})
    assert as_map(spark, "a b\nx#y\n\u00a0c\u00a0\nk=v\n") == (4, {"a b": True, "x#y": True, "c": True, "k=v": True})


def test_numbers(spark):
    assert as_map(spark, "alpha=1\nbeta=2\nalpha=3 # override", "=n") == (3, {"alpha": 3, "beta": 2})
    assert as_map(spark, "a=1.5\nb=2.25\nc=1_000\nd=-7\ne=1e3\nf=9007199254740993", "=n")[1] == {"a": 1.5, "b": 2.25, "c": 1000, "d": -7, "e": 1000.0, "f": 9007199254740993}


def test_strings(spark):
    text = 'a=bare\nb="with space"\nc="x\\"y"\nd="bad"inner"\ne=p=q\nf="\\u00e9"\n'
    assert as_map(spark, text, "=")[1] == {"a": "bare", "b": "with space", "c": 'x"y', "d": 'bad"inner', "e": "p=q", "f": "é"}


def test_booleans(spark):
    assert as_map(spark, "a=true\nb=FALSE\nc=True\nd=false", "=b")[1] == {"a": True, "b": False, "c": True, "d": False}


@pytest.mark.parametrize(("text", "mode"), [("maybe=perhaps", "=b"), ("alpha=abc", "=n"), ("alpha=1.5d", "=n"), ("alpha", "="), (" = 3", "=n")])
def test_errors_are_data_and_can_be_raised(spark, text, mode):
    rows = parse(spark, text, mode)
    assert rows.where("error is not null").count() == 1
    with pytest.raises(entries.EntryError):
        entries.fail_on_error(rows)


def test_mode_is_checked():
    with pytest.raises(entries.EntryError):
        entries.check_mode("=x")


def test_blank_lists_have_no_entries(spark):
    assert parse(spark, "\n  \n# only\n").count() == 0
    assert parse(spark, "").count() == 0


def test_inference_equality_rendering(spark):
    raw = [("true",), ("False",), ('"a"',), ("10",), ("10.0",), ("nan",), ("bare word",), ('"x" "y"',), ("1e16",), ('"é\\n"',), ("123456789012345678901234567890",)]
    got = spark.createDataFrame(raw, "r string").select("r", V.inferred_value(F.col("r")).alias("v"))
    got = {r["r"]: (r["t"], r["l"]) for r in got.select("r", F.col("v.tag").alias("t"), V.render_value(F.col("v")).alias("l")).collect()}
    assert got["true"] == ("bool", "true") and got["False"] == ("bool", "false") and got['"a"'] == ("str", '"a"')
    assert got["10"] == ("int", "10") and got["10.0"] == ("float", "10.0") and got["bare word"] == ("str", '"bare word"')
    assert got["1e16"] == ("float", "1e+16") and got['"é\\n"'] == ("str", '"\\u00e9\\n"') and got['"x" "y"'][0] == "str"
    assert got["123456789012345678901234567890"][0] == "int"

    pairs = [("10", "10.0", True), ("true", "1", True), ("nan", "nan", False), ("9007199254740993", "9007199254740992", True), ('"a"', "a", True), ("1", '"1"', False)]
    df = spark.createDataFrame(pairs, "a string, b string, same boolean").select("same", *[V.inferred_value(F.col(c)).alias(c) for c in "ab"])
    df = df.select("same", V.values_equal(F.col("a"), F.col("b")).alias("got"))
    assert all(r["same"] == r["got"] for r in df.collect())


def test_small_functions(spark):
    df = spark.range(1).select(
        V.version_of_tag(F.lit("v1.2")).alias("a"), V.style_of_repo(F.lit("x-vale")).alias("b"), V.style_of_repo(F.lit("-vale")).alias("c"),
        V.destination(F.lit("p.tengo")).alias("d"), V.destination(F.lit("p.tengo::m")).alias("e"), V.destination(F.lit("::m")).alias("f"), V.split_list(F.lit(" a, ,b,")).alias("g"),
    ).first()
    assert df["a"] == "1.2" and df["b"] == "x" and df["c"] == "-vale"
    assert tuple(df["d"]) == ("p.tengo", "allow") and tuple(df["e"]) == ("p.tengo", "m") and df["f"] is None and df["g"] == ["a", "b"]


def test_repo_references(spark):
    refs = ["owner/name", " owner / name-vale ", "owner", "a/b/c", "/name", "owner/", " / ", "", "//", "a//b"]
    got = [r[0] for r in spark.createDataFrame([(i, r) for i, r in enumerate(refs)], "i int, r string").orderBy("i").select(V.repo_reference(F.col("r"))).collect()]
    assert tuple(got[0]) == ("owner", "name", "name") and tuple(got[1]) == ("owner", "name-vale", "name") and got[2:] == [None] * 8
