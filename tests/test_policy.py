import pytest
from pyspark.sql import functions as F

from sealedspark import policy

CASES = [
    ("role:doctor", ["role:doctor"], True), ("Role : Doctor", ["role:doctor"], True), ("a:1 AND b:2", ["a:1"], False),
    ("a:1 OR b:2", ["b:2"], True), ("2-of(a:1, b:2, c:3)", ["a:1", "c:3"], True), ("2-of(a:1)", ["a:1"], False),
    ("2-OF((a:1) AND (b:2), c:3)", ["a:1", "b:2", "c:3"], True), ("2-of(a:1 AND b:2, c:3)", ["a:1", "c:3"], False),
    ('"dept:A OR B"', ["dept:a or b"], True), ("a:1", [], False), ("a:1 AND (b:2 OR c:3)", ["a:1", "c:3"], True),
]


def test_cases(spark):
    for text, attrs, want in CASES:
        df = spark.createDataFrame([(attrs,)], "attrs array<string>")
        assert df.select(policy.allows(text, F.col("attrs"))).first()[0] is want, text
    none = spark.createDataFrame([(None,)], "attrs array<string>")
    assert none.select(policy.allows("a:1", F.col("attrs"))).first()[0] is False
    assert none.select(policy.allows(None, F.col("attrs"))).first()[0] is False


@pytest.mark.parametrize("text", ["", " ", "a", "a:1 AND", "OR a:1", "()", "OR", "0-of(a:1)", "k-of(a:1)", "2-of(a:1,b:2) c:3 )", "a:1 and b:2", "(a:1"])
def test_errors(text):
    with pytest.raises(policy.PolicyError):
        policy.parse(text)


def test_min_attrs_and_builders():
    assert policy.parse("a:1 AND (b:2 OR c:3)").min_attrs() == 2
    assert policy.parse("3-of(a:1 AND b:2, c:3, d:4)").min_attrs() == 3
    assert (policy.Leaf("a:1") & policy.Leaf("b:2") | policy.Leaf("c:3")).min_attrs() == 1
