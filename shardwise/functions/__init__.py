"""Column expressions and scalar rules; nothing here runs a job."""
