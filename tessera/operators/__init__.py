"""Data movement, data changes and checks as DataFrame plans."""
