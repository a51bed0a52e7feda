"""Literature analytics as plain DataFrame-to-DataFrame operators on Spark."""
