"""No streaming operators: every input of this library is a bounded table.

The daily aggregates are plain sums, so a stream can be folded into them with
``foreachBatch`` and :func:`shelfwise.operators.timeseries.daily_series`.
"""
