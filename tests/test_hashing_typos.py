"""u01 parity with plain Python and keyboard typos against a replay."""
import hashlib

from pyspark.sql import functions as F

from moodframe.functions import hashing as hz
from moodframe.operators import augment as ag


def py_u01(key, seed=42, salt="", k=0):
    h = hashlib.md5(f"{key}:{seed}:{salt}:{k}".encode()).hexdigest()
    return int(h[:13], 16) / 2 ** 52


def test_u01_matches_python(spark):
    df = spark.createDataFrame([(i,) for i in range(50)], "id LONG")
    got = [r.u for r in df.select(hz.u01(F.col("id"), 42, "s", 3).alias("u")).orderBy("id").collect()]
    assert got == [py_u01(i, 42, "s", 3) for i in range(50)]


def py_typos(words, key):
    out = []
    for i, w in enumerate(words):
        if len(w) >= 4 and py_u01(key, 42, "g8", i) <= 0.3:
            pos = int(py_u01(key, 42, "g8p", i) * (len(w) - 1)) + 1
            c = ag.KEY_NEIGHBOURS.get(w[pos].lower())
            if c:
                ch = c[int(py_u01(key, 42, "g8c", i) * len(c))]
                w = w[:pos] + ch + w[pos + 1:]
        out.append(w)
    return out


def test_typos_match_replay(spark):
    rows = [(i, ["hello", "world", "abc", "Spark", "typing", "zzzz"]) for i in range(30)]
    df = spark.createDataFrame(rows, "id LONG, w ARRAY<STRING>")
    got = {r.id: r.t for r in df.select("id", ag.apply_typos(F.col("w"), F.col("id")).alias("t")).collect()}
    for i, w in rows:
        assert got[i] == py_typos(w, i), i
