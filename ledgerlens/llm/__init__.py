"""Training-data operators (secrets, sharding, dedup, joins, mixing, search,
licences, toxicity, decontamination, quality) and their queries.  Nothing else
in the library imports this subpackage."""
