"""Incremental and streaming refresh (INC-*)."""

from .incremental import (incremental_filter, latest_per_key, events_daily, stream_changes,  # noqa: F401
                          read_latest, stream_events_daily, stream_change_events)
