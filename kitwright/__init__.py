"""Kitwright: analytics for configurable products, as DataFrame operators on Spark."""
