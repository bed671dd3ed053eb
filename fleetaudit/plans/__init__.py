"""Query plans: audit-shaped views over the given tables and the registered queries on top of them."""
