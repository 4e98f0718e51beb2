import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusgraph.functions import json_values, model_output, prompts, text


def test_strip_is_that_of_python(spark):
    values = ["  a ", "\x1c\x85a\xa0", "　b ", "", "​ x", None, "\t\n"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    found = {r.i: r.s for r in df.select("i", text.pystrip("v").alias("s")).collect()}
    assert found == {i: None if v is None else v.strip() for i, v in enumerate(values)}


def test_squeeze_and_blank(spark):
    df = spark.createDataFrame([(" a \n b ",), (None,), ("\xa0",)], "v string")
    assert [tuple(r) for r in df.select(text.squeeze("v"), text.is_blank("v")).collect()] == [("a b", False), (None, True), ("", True)]


@pytest.mark.parametrize(("value", "number"), [("PMID: 0012 ", 12), ("pmid 7", 7), ("007", 7), ("12a", None), ("", None), (None, None), ("12 13", None), ("\xa05\n", 5), ("0", 0)])
def test_pmid_number(spark, value, number):
    assert spark.createDataFrame([(value,)], "v string").select(text.pmid_number("v")).collect()[0][0] == number


def test_key_modes(spark):
    df = spark.createDataFrame([(None,), (" ",), (" 1 ",)], "v string")
    found = [tuple(r) for r in df.select(*[text.text_or_none(m, F.col("v")) for m in ("empty", "null", "literal")]).collect()]
    assert found == [("", None, "None"), ("", None, ""), ("1", "1", "1")]
    with pytest.raises(ValueError):
        text.text_or_none("other", F.col("v"))


def test_objects_as_python_reads_them(spark):
    lines = ['{"a": NaN, "b": []}', "[1]", "bad", " ", None, '{"a": 1, "a": null}', '{"a": 0} x', '{"a": false, "b": " "}']
    df = spark.createDataFrame([(i, v) for i, v in enumerate(lines)], "i int, v string")
    found = [r.o for r in df.select("i", json_values.read_object(F.col("v"), ["a", "b"]).alias("o")).orderBy("i").collect()]
    assert [o.status for o in found] == ["ok", "not_object", "invalid", "blank", "blank", "ok", "invalid", "ok"]
    assert (found[0].b.present, found[0].b.empty, found[5].a.kind, found[5].a.empty, found[5].b.present) == (True, True, "null", True, False)
    assert (found[7].a.empty, found[7].b.empty) == (False, True)


def test_rewrite_keeps_other_keys(spark):
    df = spark.createDataFrame([('{"x": 1.50, "y": "ü"}',), ("[]",)], "v string")
    found = [r[0] for r in df.select(json_values.rewrite_object(F.col("v"), lambda o: {"n": 1} | o)).collect()]
    assert found == ['{"n": 1, "x": 1.5, "y": "ü"}', None]


ANSWERS = [
    ('[{"a": 1}]', 1), ('```json\n[{"a": 1}, 2, "x"]\n```', 1), ('As asked: [{"a": "]"}, {"b": "\\"["}] done', 2), ("[]", 0),
    ('{"a": 1}', None), ("nothing", None), ('[{"a": 1}', None), (None, None), ("", None), ('see [1] and [{"a": 1}]', 0),
]


@pytest.mark.parametrize(("answer", "number"), ANSWERS)
def test_answers(spark, answer, number):
    found = spark.createDataFrame([(answer,)], "v string").select(model_output.parse_answer(F.col("v")).alias("p")).collect()[0].p
    assert (found.triples is None) == (number is None)
    assert number is None or len(found.triples) == number


@settings(max_examples=60, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers() | st.text(), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(max_size=3), x, max_size=3), max_leaves=12).map(lambda x: [x]), st.text(alphabet="abc{} \n", max_size=12))
def test_first_array_finds_any_array_in_prose(value, prose):
    body = json.dumps(value)
    assert model_output.first_array(prose + body + " ]" + prose) == body


def test_prompts(spark):
    raw = "Find triples.\n## input\ndraft"
    assert prompts.template(raw) == "Find triples." and prompts.template(" a ") == "a"
    assert prompts.system_prompt(raw) == "Find triples.\n" and "Hard constraints" in prompts.system_prompt(raw, hard=True)
    df = spark.createDataFrame([(" A ", None), (None, " b\n c ")], "t string, a string").select(prompts.input_text(F.col("t"), F.col("a")).alias("x"))
    assert [r.x for r in df.collect()] == ["A", "b c"]
    assert df.limit(1).select(prompts.user_prompt(F.col("x"))).collect()[0][0] == "## Input\n```\n{A}\n```\n"
