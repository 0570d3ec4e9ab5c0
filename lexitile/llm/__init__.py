"""Training-data operators on multilingual markup texts."""
