"""Query plans: end-to-end compositions of operators, and the registry of named queries."""
