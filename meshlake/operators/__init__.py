"""DataFrame operators, one module per analytics area."""
