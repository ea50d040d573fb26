"""Column functions: level mappings, event-time helpers, three-valued logic, deterministic hashes."""
