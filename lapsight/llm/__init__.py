"""Operators for preparing large text corpora, one module each.

Nothing outside this folder imports it; :mod:`lapsight.llm.registry` lists the
queries and their SQL for the repository's entry module.
"""
