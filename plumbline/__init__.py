"""plumbline: uncertain entity-relationship models as Spark tables and Catalyst plans."""
