"""Many patterns by one automaton, as few of them by an expression."""

import random

from pyspark.sql import functions as F

from driftloom.operators import excludes


def test_automaton_as_contains(spark, monkeypatch):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abAB/é.") for _ in range(n))
    texts = [(k, word(rng.randint(0, 30))) for k in range(80)] + [(100, None), (101, "")]
    patterns = [word(rng.randint(1, 4)) for _ in range(60)] + ["", "a(b", "$"]
    df = spark.createDataFrame(texts, "id int, text string").withColumn("hit", F.lit(1)).drop("hit")
    want = {(k, p.lower()) for k, t in texts if t for p in patterns if p and p.lower() in t.lower()}
    table = spark.createDataFrame([(p,) for p in [*patterns, None]], "pattern string")
    assert {tuple(r) for r in excludes.contained(df, "id", "text", table).collect()} == want
    monkeypatch.setattr(excludes, "BYTES", 200)  # several passes
    found = [tuple(r) for r in excludes.contained(df, "id", "text", table).collect()]
    assert len(found) == len(set(found)) and set(found) == want
    monkeypatch.setattr(excludes, "BYTES", 1 << 20)
    for some in (patterns, patterns[:5], []):
        got = {r["id"]: r["x"] for r in excludes.flagged(df, "text", some, "x").collect()}
        assert got == {k: any(p and p.lower() in (t or "").lower() for p in some) for k, t in texts}
