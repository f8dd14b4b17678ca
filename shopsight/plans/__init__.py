"""Plans: end-to-end jobs and the query registry over the operators."""
