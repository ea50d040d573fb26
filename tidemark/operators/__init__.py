"""Windows, letters, assertions, set operations, temporal formulas, binding, synthetic events."""
