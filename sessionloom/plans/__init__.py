"""Query registries: each maps a name to a plan builder and, where SQL can state it, to oracle SQL."""
