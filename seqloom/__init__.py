"""seqloom: a PySpark engine for preparing, auditing and scoring sequence corpora."""
