"""Bindings of the operators to the benchmark tables, each with an SQL twin where one exists."""
