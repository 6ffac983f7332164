"""Point-in-time features over event logs, as DataFrame plans."""
