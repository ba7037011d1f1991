"""Notice analytics and training-data preparation as DataFrame plans."""
