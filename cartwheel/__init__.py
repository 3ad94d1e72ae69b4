"""cartwheel: batch product recommendation and customer analytics on Spark.

Every technique is a plain function ``DataFrame -> DataFrame`` that answers a
whole cohort (by default every customer) in one Catalyst plan:

* ``operators.basket``      market-basket confidence
* ``operators.similarity``  spend-weighted customer cosine over the purchase graph
* ``operators.segments``    K-means customer segments and segment spend
* ``operators.factors``     ALS collaborative filtering
* ``operators.features``    customer feature vectors and z-scores
* ``operators.postfilter``  recency / tag filters, de-duplication and top-k
* ``operators.evaluate``    offline relevance score
* ``operators.tune``        parameter sweeps scored with the relevance score

Sources live in ``sources`` (mart views, CSV and warehouse readers, sinks),
column expressions in ``functions``, the registered query catalog and its
DuckDB oracle SQL in ``plans``.
"""

__all__ = ["operators", "sources", "functions", "plans"]
