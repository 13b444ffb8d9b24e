"""Stateful processors of streams, sent whole."""

import spendlake
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor


def stateful(grouped, processor: StatefulProcessor, schema) -> DataFrame:
    """transformWithState of grouped rows in event time. The processor's classes go along by value: Spark sets it up in a process of the driver that doesn't see files added to the session."""
    cloudpickle.register_pickle_by_value(spendlake)
    try:
        return grouped.transformWithState(processor, schema, "Append", "EventTime")
    finally:
        cloudpickle.unregister_pickle_by_value(spendlake)
