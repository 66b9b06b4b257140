"""Entity resolution for organization names on Spark."""
