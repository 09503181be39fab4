from pyspark.sql import functions as F

from lexmill.functions import text as tx
from lexmill.operators.arena import START, rate
from lexmill.operators.resolve import jaro_winkler


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("x")).first().x


def test_slugify(spark):
    assert one(spark, "  Hello, World!  ", tx.slugify) == "hello-world"
    assert one(spark, "???", tx.slugify) == "section"
    assert one(spark, "Überschrift Eins", tx.slugify) == "überschrift-eins"


def test_tier_of(spark):
    assert one(spark, "aws-t3-001", tx.tier_of) == 3
    assert one(spark, "no-tier-in-id", tx.tier_of) == 0


def test_namespaces(spark):
    assert one(spark, "L0:doc::sec::0", tx.strip_namespace) == "doc::sec::0"
    assert one(spark, "foo:doc", tx.strip_namespace) == "foo:doc"


def test_json_and_fences(spark):
    assert one(spark, 'x {"a": 1} {"b": 2}', tx.first_json_object) == '{"a": 1}'
    assert one(spark, "x [1, [2]] y", tx.greedy_json_array) == "[1, [2]]"
    assert one(spark, "```json\n{}\n```", tx.strip_code_fences) == "{}"


def test_intents(spark):
    assert one(spark, "Compare a and b", tx.keyword_intent) == "comparison"
    assert one(spark, "advs", tx.keyword_intent) is None
    assert one(spark, "advs", tx.substring_intent) == "comparison"
    assert one(spark, "what is it", tx.substring_intent) == "factoid"


def test_selection(spark):
    frame = spark.createDataFrame([("1, 3,9,x", 4), ("none", 4), ("", 0)], "t string, n int")
    assert [r.x for r in frame.select(tx.selection(F.col("t"), F.col("n"), 3).alias("x")).collect()] == [[0, 2], [0, 1, 2], []]


def test_entity_mentions(spark):
    assert one(spark, 'use "My Thing" with os.path and re-try in CamelCase', tx.entity_mentions) == ["My Thing", "os.path", "re-try"]


def test_jaro_winkler():
    for a, b, want in (("MARTHA", "MARHTA", 0.9611), ("DWAYNE", "DUANE", 0.84), ("DIXON", "DICKSONX", 0.8133)):
        assert abs(jaro_winkler(a, b) - want) < 1e-4
    assert jaro_winkler("", "x") == 0


def test_elo():
    rating = {}
    rate(rating, "a", "b", "a")
    assert rating["a"] > START > rating["b"] and abs(sum(rating.values()) - 2 * START) < 1e-9
    equal = {}
    rate(equal, "a", "b", "tie")
    assert equal == {"a": START, "b": START}
