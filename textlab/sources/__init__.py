"""Sources and sinks: driver tables, the canonical labelled input, CSV posts, JSON rules, stored tables."""
