"""Nutrition-diary analytics on Spark."""
