"""The three jobs: pages to prompts, replies to records, records to one table."""
