"""Sources and sinks: test tables, the dirty-bookings projection, file readers and writers."""
