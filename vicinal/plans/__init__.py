"""Choice among equivalent plans by cost."""
