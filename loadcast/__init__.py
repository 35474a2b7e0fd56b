"""loadcast: utility consumption analytics, feature derivation, training and scoring on Spark.

Layout
------
functions/   pure Column expressions (features, request defaults, scoring maths) + fixed values
sources/     readers: energy CSV (header-aware union), station weather text, JSON requests,
             model package store, and the stand-in views over the benchmark tables
operators/   DataFrame -> DataFrame operators (aggregates, joins, quality filters, ranking,
             exact quantiles, ML preprocessing stages)
plans/       end-to-end jobs composed from operators (integrated annual table, training,
             batch scoring)
streaming/   Structured Streaming versions of request scoring and station-year weather
"""

__all__ = ["session"]
