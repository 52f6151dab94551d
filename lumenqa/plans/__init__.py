"""Bindings of the standard tables to the engine's records, the queries over them and their SQL."""
