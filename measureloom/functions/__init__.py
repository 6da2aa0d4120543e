"""Column expressions: cleaning, calendar, direction, display and statistics helpers."""
