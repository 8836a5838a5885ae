"""Small tables, and plain versions of what the operators compute."""

from __future__ import annotations

import random
import re
from collections import defaultdict

from pyspark.sql import types as T

SMALL = "/root/testdata/sf0.001"

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        # Names that the operators use for columns of their own.
        T.StructField("size", T.StringType()),
        T.StructField("score", T.StringType()),
        T.StructField("group", T.StringType()),
    ]
)


def docs(spark, rows, parts=3):
    """Documents from ``(doc_id, text[, lang[, source]])`` tuples."""
    whole = [(*row, *([None] * (4 - len(row))), "own size", "own score", "own group") for row in rows]
    return spark.createDataFrame(whole, DOCS).repartition(parts)


def labels(spark, rows, name):
    return spark.createDataFrame([(*r,) for r in rows], f"doc_id long, {name} int")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def sentence(rng, vocabulary, n):
    return " ".join(rng.choice(vocabulary) for _ in range(n))


def invented(seed, n=400):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(3, 9))) for _ in range(n)]


def groups(ids, links):
    """The smallest id that each id is connected with."""
    near = defaultdict(set)
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    top = {}
    for start in sorted(ids):
        if start in top:
            continue
        open_ids = [start]
        while open_ids:
            x = open_ids.pop()
            if x not in top:
                top[x] = start
                open_ids += near[x]
    return top
