"""Pipeline stages keep columns whose names clash with theirs."""

from functools import reduce

from pyspark.sql import functions as F

import corpus_pipeline
from cartwheel.llm import simhash, toxicity
from cartwheel.llm.common import fresh, quoted
from cartwheel.session import materialize

SF = "/root/testdata/sf0.001"


def test_fresh_names_clash_with_none(spark):
    df = spark.range(1).select(*[F.lit(1).alias(c) for c in ("_h", "__H", "a.b", "c`d")])
    assert fresh(df, "_h") == "___h" and fresh(df, "x") == "x"
    assert df.select(quoted(df)).columns == df.columns


def test_stages_keep_columns_of_clashing_names(spark):
    """A document column named like a stage's own stays as it was; dots in names do no harm."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = reduce(lambda d, c: d.withColumn(c, F.lit(f"mine {c}")), ["toxicity", "_h", "_rows", "a.b", "fp", "component_id"], docs)
    model = toxicity.Model({}, -3.0)
    scored = toxicity.score(odd, model, into=fresh(odd, "toxicity"))
    assert scored.columns == [*odd.columns, "_toxicity"]
    twice = materialize(odd.unionByName(odd))                  # every id leads twice at most
    kept = simhash.keep_one(twice, simhash.near_duplicates(twice))
    plain = simhash.keep_one(docs, simhash.near_duplicates(docs))
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in plain.collect())
    assert {r["toxicity"] for r in kept.collect()} == {"mine toxicity"} and {r["_h"] for r in kept.collect()} == {"mine _h"}
    left = corpus_pipeline.drop_toxic(spark, odd, SF)
    assert left.columns == odd.columns and {r["toxicity"] for r in left.collect()} == {"mine toxicity"}
    assert corpus_pipeline.drop_leaks(spark, odd, SF).columns == odd.columns
