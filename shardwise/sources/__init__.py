"""Reading and writing observations, model state and round logs."""
