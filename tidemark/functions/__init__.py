"""Column functions and driver-side helpers for times, durations and null-safe arithmetic."""
