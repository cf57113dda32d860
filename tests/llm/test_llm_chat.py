"""Arguments of tool calls: one form for each number, nulls, ranges."""

import pytest

from meterlake.llm import chat

SCHEMAS = [("t", "limit", "BIGINT", True, 1.0, 100.0), ("t", "share", "DECIMAL", False, 0.0, 1.0), ("t", "word", "STRING", False, None, None)]


@pytest.mark.parametrize(("said", "written", "problems"), [
    ('{"limit": 10}', '{"limit":10}', []),
    ('{"limit": 1e1}', '{"limit":10.0}', ["type:limit"]),
    ('{"limit": 3.0}', '{"limit":3}', []),
    ('{"limit": 10.00}', '{"limit":10}', []),
    ('{"limit": 3.5}', '{"limit":3.5}', ["type:limit"]),
    ('{"limit": 12345678901234567890}', '{"limit":12345678901234567890}', ["range:limit"]),
    ('{"limit": 1e300}', '{"limit":1.0E300}', ["type:limit"]),
    ('{"limit": 101.0}', '{"limit":101}', ["range:limit"]),
    ('{"limit": null}', '{}', ["type:limit"]),
    ('{"word": null, "limit": 5, "share": 0.50}', '{"limit":5,"share":0.5}', ["type:word"]),
    ('{"word": "x\\"1e1", "limit": 5}', '{"limit":5,"word":"x\\"1e1"}', []),
    ('{"z": null, "limit": 5}', '{"limit":5}', ["unknown:z"]),
    ('{"limit": 5, "z": {"b": 1, "a": null}}', '{"limit":5,"z":{"a":null,"b":1}}', ["unknown:z"]),
    ('{"limit": "10"}', '{"limit":"10"}', ["type:limit"]),
    ('[1]', '[1]', ["json"]),
    ('{}', '{}', ["missing:limit"]),
    (None, None, ["json"]),
])
def test_arguments(spark, said, written, problems):
    schemas = spark.createDataFrame(SCHEMAS, "tool string, param string, type string, required boolean, low double, high double")
    calls = spark.createDataFrame([("c", "t", said)], "call_id string, name string, arguments string")
    got = chat.validated(calls, schemas).first()
    assert (got["arguments"], list(got["problems"])) == (written, problems)
