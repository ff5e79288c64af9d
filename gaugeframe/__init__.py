"""gaugeframe: PySpark operators for time-ordered measurement windows.

Every operator takes and returns DataFrames, so flows are built with
``df.transform(...)`` and Catalyst plans the whole of them.
"""
