"""Relational and modelling operators."""
