import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import text
from tessera.functions.filters import compile_filter, typed, variant
from tessera.operators.reads import find, find_json
import json

PRODUCTS = ['{"_id":"p1","name":"Laptop","category":"electronics","price":1200}', '{"_id":"p2","name":"Mouse"}', '{"_id":"p3","name":"Keyboard"}', "{broken"]
CASES = [
    ({"category": "electronics"}, ["p1"]),
    ({"price": {"$gt": 1000}}, ["p1"]),
    ({"price": {"$gt": "abc"}}, ["p1"]),
    ({"price": {"$gte": 1000}}, []),
    ({"price": "1200"}, []),
    ({"category": None}, ["p2", "p3"]),
    ({"category": {"$in": ["electronics", None]}}, ["p1", "p2", "p3"]),
    ({"category": {"$in": []}}, []),
    ({"category": {"$in": "electronics"}}, []),
    ({"price": {}}, ["p1", "p2", "p3"]),
    ({}, ["p1", "p2", "p3"]),
    (None, ["p1", "p2", "p3"]),
    ({"name": ["Mouse"]}, []),
    ({"price": {"$LT": 2000, "$Gt": 3}}, ["p1"]),
    ({"price": {"$gt": True}}, ["p1"]),
]


@pytest.mark.parametrize("filter_,want", CASES, ids=[str(c[0]) for c in CASES])
def test_both_modes(spark, filter_, want):
    rows = spark.createDataFrame([(d,) for d in PRODUCTS], "doc string")
    got = find_json(rows, "doc", filter_).collect()
    assert sorted(json.loads(r.doc)["_id"] for r in got) == want
    docs = spark.createDataFrame([("p1", "Laptop", "electronics", 1200.0), ("p2", "Mouse", None, None), ("p3", "Keyboard", None, None)], "_id string, name string, category string, price double")
    assert sorted(r._id for r in find(docs, filter_).collect()) == want


def kind(x):
    """A value as (kind, comparable); arrays and objects are like nothing, not even themselves."""
    if x is None or isinstance(x, (bool, str)):
        return type(x).__name__, x
    return ("number", float(x)) if isinstance(x, (int, float)) else ("other", object())


def number(x, otherwise=float("nan")):
    return kind(x)[1] if kind(x)[0] == "number" else otherwise


#: What each operator asks of (field, operand), case aside; those that aren't here hold for nothing.
OPERATORS = {
    "$gt": lambda v, x: number(v) > number(x, 0.0),
    "$lt": lambda v, x: number(v) < number(x, 0.0),
    "$in": lambda v, x: isinstance(x, list) and kind(v) in [kind(y) for y in x],
}


def matches(doc, filter_):
    """The language in plain Python: all terms as (key, operator, operand), each looked up in a table."""
    terms = [(k, op.lower(), x) for k, want in filter_.items() if isinstance(want, dict) for op, x in want.items()]
    terms += [(k, "$in", [want]) for k, want in filter_.items() if not isinstance(want, dict)]
    return all(OPERATORS.get(op, lambda *_: False)(doc.get(k), x) for k, op, x in terms)


def test_random_documents(spark):
    rng = random.Random(4)
    keys = ["x", "a.b", 'q"t', "it's", "both'\"", "", " s p", "é", "back\\slash"]
    values = [1, "1", True, False, None, 1.5, -2, 0, "", "x", [1], {"y": 1}, 2**53 + 1, "5", 1e3]
    docs = [{k: rng.choice(values) for k in rng.sample(keys, rng.randint(0, 5))} for _ in range(200)]
    flat = [v for v in values if not isinstance(v, dict)]
    rows = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "i int, doc string").withColumn("v", F.try_parse_json("doc")).cache()
    filters = []
    for _ in range(50):
        f = {}
        for k in rng.sample(keys, rng.randint(1, 2)):
            f[k] = rng.choice([rng.choice(flat), {rng.choice(["$gt", "$lt", "$GT", "$gte"]): rng.choice(values)}, {"$in": rng.sample(flat, 4)}, {}])
        filters.append(f)
    got = rows.select("i", *(compile_filter(f, variant(F.col("v"))).alias(f"f{n}") for n, f in enumerate(filters))).collect()
    for r in got:
        for n, f in enumerate(filters):
            assert bool(r[f"f{n}"]) == matches(docs[r.i], f), (docs[r.i], f)


def test_typed_pushdown_and_types(spark, tmp_path):
    spark.range(100).selectExpr("id", "cast(id as int) i", "cast(id as decimal(10,2)) d", "timestamp_ntz'2024-01-01 00:00:00' t", "id % 2 = 0 b").write.parquet(f"{tmp_path}/x")
    df = spark.read.parquet(f"{tmp_path}/x")
    for f, n in [({"i": 5}, 1), ({"i": 5.5}, 0), ({"i": {"$gt": 97.5}}, 2), ({"d": 7}, 1), ({"t": "2024-01-01T00:00:00"}, 100), ({"b": True}, 50), ({"b": 1}, 0), ({"id": {"$in": [1, 2, "3", None]}}, 2)]:
        assert find(df, f).count() == n, f
    plan = find(df, {"i": {"$gt": 5}})._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(i,5)" in plan
    assert isinstance(df.schema["d"].dataType, T.DecimalType) and find(df, {"i": {"$gte": 98}}, extended=True).count() == 2
    assert compile_filter({"i": {"$ne": 3}}, typed(df.schema), extended=True) is not None


def test_scalars(spark):
    r = spark.createDataFrame([("a:b:c", 1536), ("none", 0)], "k string, n long").select(
        text.key_collection(F.col("k")).alias("c"), text.key_id(F.col("k")).alias("i"), text.human_bytes(F.col("n")).alias("h"), text.percent_of(F.col("n"), 1000.0).alias("p"),
        text.run_level(text.run_file_name(F.lit(2), F.lit(17))).alias("l"), text.run_number(F.lit("L2_000017")).alias("u"), text.composite_key(F.lit("x"), F.lit("y")).alias("xy"),
    ).collect()
    assert tuple(r[0]) == ("a", "b:c", "1.5 KB", 100.0, 2, 17, "x:y") and tuple(r[1])[:3] == (None, None, "0.0 B")
    assert text.complete(["insertOne", "findOne"], "INS") == ["insertOne"]
