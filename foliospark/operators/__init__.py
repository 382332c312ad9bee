"""foliospark.operators"""
