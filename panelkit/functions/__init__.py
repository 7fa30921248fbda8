"""Column-level helpers (null / rounding / ordering rules, text expressions, scalar statistics)."""
