"""Training-data operators: filtering, near-duplicate removal, redaction and tokenising of document tables."""
