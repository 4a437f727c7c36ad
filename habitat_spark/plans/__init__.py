"""Configuration, models and the whole pipeline."""
