"""Training-data operators: deduplication, language, PII, mixing, decontamination,
licences, chat formatting and token output.  Nothing else in the library imports this."""
