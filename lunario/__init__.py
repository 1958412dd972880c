"""Monthly indicator series on Spark: report loading, period changes, rate and ratio views, KPIs."""
