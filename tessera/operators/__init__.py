"""Table operators: scenarios, lookups, exports and reports."""
