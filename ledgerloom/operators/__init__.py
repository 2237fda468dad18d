"""Relational operators: ``DataFrame -> DataFrame``, none of which collects."""
