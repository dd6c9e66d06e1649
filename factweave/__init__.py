"""Immutable facts on Spark: a SQL dialect and a datalog API over (entity, attribute, value, transaction, added)."""
