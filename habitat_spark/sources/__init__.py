"""Readers, generators and adapters that give stations and gridded fields."""
