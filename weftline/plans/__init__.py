"""Plan-level helpers: staged tables, iteration and session settings."""
