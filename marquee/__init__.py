"""marquee — box-office analytics expressed as Spark DataFrame plans.

Layout:
  sources/    readers, schema registry, conformance, the driver-table adapter
  functions/  Column -> Column cleaners, the date dimension, string similarity
  operators/  reusable relational operators (surrogate keys, DQ rules,
              enrichment picks, fuzzy matching, measures, hierarchies)
  plans/      end-to-end plans: warehouse load, business questions,
              reports, tier model, pipeline glue
  streaming/  incremental daily append (batch and availableNow stream)
"""

__all__ = ["session"]
