"""cardlens: card-portfolio analytics as Spark DataFrame jobs.

Every public operator takes and returns DataFrames.  Work runs as Spark
expressions, joins, aggregations and windows; Python only assembles plans
(and, in the exact nearest-neighbour operator, runs numpy inside tasks).
"""

__all__ = ["session", "sources", "functions", "operators", "plans", "streaming"]
