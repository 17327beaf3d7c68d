import base64

import pytest
from pyspark.sql import functions as F

from lexloom.functions import text as tx


def values(spark, column, *inputs):
    frame = spark.createDataFrame([(at, value) for at, value in enumerate(inputs)], "at int, c string")
    return [row[0] for row in frame.orderBy("at").select(column(F.col("c"))).collect()]


def test_base64_is_standard_and_on_one_line(spark):
    inputs = ["", "Hello, World!", "é" * 200, "https://x.example/" + "a" * 300]
    assert values(spark, tx.base64_text, *inputs) == [base64.b64encode(i.encode()).decode() for i in inputs]


def test_chunk_keys(spark):
    assert values(spark, tx.chunk_id_of_key, "b/chunk/1.2.3.txt", "b/chunk/4.12a.txt", "a.b/none", "x.txt", "") == [
        "1.2.3",
        "4.12a",
        "",
        "x",
        "",
    ]


def test_trim_takes_all_white_space(spark):
    assert values(spark, tx.trim_space, " \t a b  \n\u0085　", "​") == ["a b", "​"]


def test_caps(spark):
    assert values(spark, tx.is_all_caps, "ABC 1;", "", "Abc", "STRAßE", "ÉTÉ", "été", "OﬃCE") == [
        True,
        True,
        False,
        True,
        True,
        False,
        True,
    ]


@pytest.mark.parametrize(
    "url, expected",
    [
        ("http://localhost/a", True),
        ("https://localhost:8443", True),
        ("http://127.8.9.1:80/x", True),
        ("http://[::1]:8080/", True),
        ("http://[0:0:0:0:0:0:0:1]", True),
        ("https://example.com", False),
        ("http://localhost.example.com", False),
        ("http://128.0.0.1", False),
        ("http://127.0.0.256", False),
        ("http://[::2]", False),
        ("not a url", False),
    ],
)
def test_loopback(spark, url, expected):
    assert values(spark, tx.is_localhost_url, url) == [expected]
