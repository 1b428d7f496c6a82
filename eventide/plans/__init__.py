"""Query rewriting and event-time plans."""
