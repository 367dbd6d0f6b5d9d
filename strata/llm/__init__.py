"""Training-data operators: quality rules, near-duplicate search, decontamination, secret
scans, packing, token counts, language-model scores, URL filters and binary token output.

Nothing else in the library imports this subpackage. ``registry`` lists the queries."""
