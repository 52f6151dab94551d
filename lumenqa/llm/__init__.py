"""Training-data pipeline operators.

Nothing outside this subpackage imports it.  Each module holds one operator with a general
interface; :mod:`lumenqa.llm.catalogue` registers the thin queries over the standard tables.
"""
