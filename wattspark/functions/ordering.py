"""A single sortable key for (timestamp, tie-breaker) order.

``min_by(x, struct(ts, id))`` gives the right answer but a struct ordering
buffer cannot live in Spark's hash aggregation, so the aggregate falls back to
a sort-based one that sorts every input row on the map side. Packing the
order into one ``decimal(38,0)`` (microseconds since 1970 from the wall-clock
fields, so time-zone free, then the id shifted to be non-negative) keeps the
aggregate hash-based with the same result.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ID_SPAN = "20000000000000000000"   # > 2^64: room for any long id
_ID_SHIFT = "9223372036854775808"   # 2^63: makes any long id non-negative


def _d(text: str) -> Column:
    return F.lit(text).cast("decimal(38,0)")


def order_key(ts: str = "timestamp", tie: str = "reading_id") -> Column:
    t = F.col(ts)
    seconds = (F.datediff(F.to_date(t), F.lit("1970-01-01").cast("date")).cast("decimal(38,0)") * _d("86400")
               + (F.hour(t) * 3600 + F.minute(t) * 60).cast("decimal(38,0)"))
    micros = seconds * _d("1000000") + (F.extract(F.lit("SECOND"), t) * 1000000).cast("decimal(38,0)")
    return micros * _d(_ID_SPAN) + (F.col(tie).cast("decimal(38,0)") + _d(_ID_SHIFT))
