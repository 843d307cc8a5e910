"""Write semantics: insert-if-new, upsert, partial update, delete and the import ledgers."""
