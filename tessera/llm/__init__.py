"""Operators of a training-data pipeline over web-scale text.

One module per operator.  Each operator keeps its own general interface; the
registered queries (:mod:`tessera.llm.queries`) call it on the whole tables
and derive their digest columns from its output.  Nothing outside this
subpackage imports it.
"""
