"""The registered queries and their SQL counterparts.

Each module holds ``QUERIES``: name -> (callable(spark, sf_dir), SQL or None).
"""
