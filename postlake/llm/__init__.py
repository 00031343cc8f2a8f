"""Training-data operators: tokenising, filtering, de-duplicating, scoring, sharding and searching at corpus scale."""
