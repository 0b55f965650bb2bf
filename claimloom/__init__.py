"""Evidence analytics on PySpark: documents become claims, claims become determinations, rules turn them into findings."""
