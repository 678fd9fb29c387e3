"""lavra: a PySpark engine that turns crawled pages and files into a clean, audited text corpus."""
