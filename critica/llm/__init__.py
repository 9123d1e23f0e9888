"""Training-data operators: packing, WARC revisits, personal data, near-duplicates, benchmark
decontamination, quality rules, substring and line dedup, secret scans, language-model scores.

Nothing else in the library imports this subpackage."""
