"""Document-to-table analytics on Spark: pure DataFrame-to-DataFrame stages keyed by (doc_id, page_number)."""
