"""outletiq — Spark-native analytics for consumer-goods distribution.

Sales growth, targets, field force, inventory, per-visit brand coverage and
data-quality builders, plus incremental loading and a read-only SQL entry
point. Every builder is a plain function ``DataFrame(s) + params -> DataFrame``
that stays lazy; Catalyst and adaptive execution choose the physical plan.
"""

__version__ = "0.1.0"
