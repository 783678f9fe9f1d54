"""clipsieve: timed-signal analytics on Spark.

Media inventories, transcripts, detector and model outputs come in as tables; ranked
moments, evaluation tables, edit plans and small inspectable models come out.  Every
operator is a ``DataFrame -> DataFrame`` function over Spark's public API.
"""
