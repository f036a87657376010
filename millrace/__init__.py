"""millrace: relational operators over attributed entities, written for Spark."""
