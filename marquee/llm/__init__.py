"""Operators for a training-data pipeline.  Nothing outside this subpackage
imports it; ``marquee.llm.queries`` registers its queries."""
