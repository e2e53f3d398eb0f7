"""Operators for preparing training corpora.

Ten operators, each in a module of its own with a general interface; the thin
queries that the entry point registers are in ``queries``. Nothing outside this
package imports it.
"""
