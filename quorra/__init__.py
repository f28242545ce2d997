"""Bootstrap analytics of uncertain networks on Spark."""
