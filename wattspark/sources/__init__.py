from wattspark.sources.readings import READINGS_SCHEMA, READING_COLUMNS, read_readings, readings_from
from wattspark.sources.adapters import orders_readings, events_readings, events_outage_schedule, requests_from_events

__all__ = [
    "READINGS_SCHEMA", "READING_COLUMNS", "read_readings", "readings_from",
    "orders_readings", "events_readings", "events_outage_schedule", "requests_from_events",
]
