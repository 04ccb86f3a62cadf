"""Agent-activity analytics on Spark: sources, transforms, typed tables, views and queries."""
