"""Named plans: report loads, indicator views, measures, and their catalogue."""
