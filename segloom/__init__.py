"""Analytics on time-aligned speech and translation tables, as DataFrame functions."""
