"""Reading entities, parameterised SQL, change extracts and measurement reports."""
