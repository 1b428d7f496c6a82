"""Sources and sinks."""

from eventide.sources.read import InMemorySource, Source, TableSource, TextSource, latest_daily_path
from eventide.sources.write import collect_events, debug_dump, print_events, write_events

__all__ = ["InMemorySource", "Source", "TableSource", "TextSource", "collect_events", "debug_dump", "latest_daily_path", "print_events", "write_events"]
