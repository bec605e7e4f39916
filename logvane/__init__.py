"""logvane: security-log analytics as Spark DataFrame operators."""
