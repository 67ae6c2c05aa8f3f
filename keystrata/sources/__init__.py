"""Tables: reading, writing and the history derived from event data."""
