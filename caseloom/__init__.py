"""Event-log performance analytics as PySpark DataFrame operators.

An event log is one table: ``case_id, pos, activity, ts`` and optional
``lifecycle, instance, resource, attrs`` columns; ``pos`` is the dense
1-based position of the event in its case.  Every operator takes and
returns DataFrames and stays lazy.
"""
