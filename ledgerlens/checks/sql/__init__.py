"""Oracle SQL by analysis family; ``ledgerlens.checks.oracle`` merges them."""
