"""Event-time dataflow and feature computation on Spark DataFrames.

Every record carries an event time; operators keep it. A pipeline is built from
``EventStream`` and ``KeyedStream``, which wrap DataFrames lazily: nothing runs
until a result is asked for.
"""

from eventide.operators.monoid import COUNT, LATEST, MAX, MIN, PREVIOUS, SUM, Monoid
from eventide.operators.windows import TrailingWindow
from eventide.stream import EventStream, KeyedStream

__all__ = ["COUNT", "LATEST", "MAX", "MIN", "PREVIOUS", "SUM", "EventStream", "KeyedStream", "Monoid", "TrailingWindow"]
