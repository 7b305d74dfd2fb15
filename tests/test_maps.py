import pytest
from pyspark.sql import functions as F
from weftline.functions import values as V
from weftline.operators import allowlist, entries, mapmerge
from weftline.sources.lines import explode_lines


def merge(spark, text, pairs, name="allow"):
    script = spark.createDataFrame([("s", text, name)], "path string, text string, map_name string")
    new = spark.createDataFrame([("s", k, i, v) for i, (k, v) in enumerate(pairs)], "path string, key string, seq int, raw string").withColumn("value", V.inferred_value(F.col("raw")))
    return mapmerge.update_maps(script, new).first()


def test_update_in_place_and_append(spark):
    r = merge(spark, 'allow := {\n  "EXISTING": false,\n}\n', [("EXISTING", "true"), ("NEW", '"added"')])
    assert r["text"] == 'allow := {\n  "EXISTING": true,\n  "NEW": "added",\n}\n' and r["updated"] == 2 and r["changed"]


def test_equal_values_leave_text(spark):
    text = 'allow := {\n    "a": true,\n    "b": "x",\n    "c": 10,\n    "d": 2.5, // keep\n    "e": bare,\n}\n'
    r = merge(spark, text, [("a", "true"), ("b", '"x"'), ("c", "10.0"), ("d", "2.5"), ("e", '"bare"')])
    assert r["text"] == text and r["updated"] == 0 and not r["changed"]


def test_comment_and_indent_stay(spark):
    r = merge(spark, 'm := {\n\t"a": 1,  // one, two\n}\nrest\n', [("a", "2"), ("z", "nan")], "m")
    assert r["text"] == 'm := {\n\t"a": 2,  // one, two\n\t"z": nan,\n}\nrest\n'


def test_empty_map_indents_by_two(spark):
    assert merge(spark, "  allow := {\n  }\n", [("k", "true")])["text"] == '  allow := {\n    "k": true,\n  }\n'


def test_last_of_repeated_keys_is_updated(spark):
    assert merge(spark, 'allow := {\n"a": 1,\n"a": 2,\n}\n', [("a", "3")])["text"] == 'allow := {\n"a": 1,\n"a": 3,\n}\n'
    assert merge(spark, 'allow := {\n"a": 1,\n"a": 2,\n}\n', [("a", "2")])["updated"] == 0


def test_two_maps_nested_braces_and_line_ends(spark):
    text = 'allow := {\n  "a": true,\n}\nexceptions := {\n  "value": 10,\n  "n": {\n    "deep": 1,\n  },\n}\n'
    r = merge(spark, text, [("value", "10"), ("fresh", "3")], "exceptions")
    assert r["updated"] == 1 and r["text"].endswith('  },\n  "fresh": 3,\n}\n')
    r = merge(spark, 'allow := {\r\n"a": 1,\r\n}', [("a", "1")])
    assert r["updated"] == 0 and r["changed"] and r["text"] == 'allow := {\n"a": 1,\n}\n'


@pytest.mark.parametrize(("text", "name"), [("allow := {}\n", "missing"), ("allow := {}\n", "allow"), ("allow := {\n", "allow"), ("", "allow"), ("x", "")])
def test_map_errors(spark, text, name):
    with pytest.raises(entries.EntryError):
        merge(spark, text, [("a", "1")], name)


def test_many_scripts_at_once(spark):
    rows = [(f"s{i}", f'allow := {{\n  "k": {i},\n}}\n', "allow") for i in range(30)]
    scripts = spark.createDataFrame(rows, "path string, text string, map_name string")
    new = scripts.select("path", F.lit("k").alias("key"), F.lit(0).alias("seq"), V.inferred_value(F.lit("7")).alias("value"))
    got = mapmerge.update_maps(scripts, new)
    assert got.agg(F.sum("updated")).first()[0] == 29 and all('"k": 7,' in r["text"] for r in got.collect())


SCRIPT = f'allow := {{\n  "API": true,\n\n  {allowlist.ROMAN_MARKER}\n  "II": true,\n}}\n'


def words(spark, text):
    return allowlist.parse_acronyms(explode_lines(spark.createDataFrame([("s", text)], "path string, text string")))


def allow(spark, script, text):
    got = allowlist.update_allow_maps(spark.createDataFrame([("s", script)], "path string, text string"), allowlist.load_acronyms(explode_lines(spark.createDataFrame([("s", text)], "path string, text string"))))
    return got.first(), allowlist.report(got).first()["message"]


def test_acronyms(spark):
    assert [r["token"] for r in words(spark, "# list\nci\nCD\nCI\n\n OKR \n").orderBy("first_pos").collect()] == ["CI", "CD", "OKR"]
    bad = words(spark, "ok\nCI/CD\n").where("error is not null").first()
    assert "Line 2" in bad["error"] and "CI/CD" in bad["error"]
    with pytest.raises(allowlist.AllowlistError):
        allowlist.load_acronyms(explode_lines(spark.createDataFrame([("s", "a-b")], "path string, text string")))


def test_allow_block(spark):
    r, said = allow(spark, SCRIPT, "ci\napi\nokr\n")
    assert list(r["managed"]) == ["CI", "OKR"] and said.startswith("Updated 2 acronyms")
    assert r["text"] == f'allow := {{\n  "API": true,\n\n  {allowlist.MANAGED_COMMENT}\n  "CI": true,\n  "OKR": true,\n\n  {allowlist.ROMAN_MARKER}\n  "II": true,\n}}\n'
    again, said = allow(spark, r["text"], "ci\napi\nokr\n")
    assert not again["changed"] and again["text"] == r["text"] and said.startswith("Already present 2")
    gone, said = allow(spark, r["text"], "api\n")
    assert gone["text"] == SCRIPT and gone["changed"] and said == "No project-specific acronyms to inject."


def test_allow_block_before_brace_or_error(spark):
    r, _ = allow(spark, 'allow := {\n  "A": true,\n}\n', "b")
    assert r["text"] == f'allow := {{\n  "A": true,\n  {allowlist.MANAGED_COMMENT}\n  "B": true,\n\n}}\n'
    with pytest.raises(allowlist.AllowlistError):
        allow(spark, "nothing\n", "b")
